"""Every gated claim is in a file or has a reason; restricted texts in files are found."""

import json

import pytest
from pyspark.sql import functions as F

from attesta import dims
from attesta.operators import extract_config
from attesta.plans import projection, quality

CLAIM = (
    "repo_id string, claim_id string, claim_type string, content string, scope string, source_authority string, risk_class string, "
    "applicability array<string>, confidence double, sensitivity string, authority_level int, review_state string"
)
AS_OF = "2024-01-01T00:00:00Z"


def claim(i, kind, text, scope="**", authority="executable-config", tags=("all",), sensitivity="public", confidence=1.0):
    return ("r", f"claim-{i:05d}", kind, text, scope, authority, "build", list(tags), confidence, sensitivity, 30, "approved")


@pytest.fixture(scope="module")
def projected(spark):
    rows = [claim(i, "validated-command", f"make t{i}") for i in range(120)]
    rows += [claim(200 + i, "always-on-rule", f"Use rule {i}", authority="inferred-high" if i % 2 else "inferred-low") for i in range(40)]
    rows += [claim(300 + i, "scoped-rule", f"Scoped {i}", scope=s) for i, s in enumerate(("src/a-b", "src/a/b", "src/c"))]
    rows += [claim(400, "skill-playbook", "Run the long check", tags=("test",)), claim(401, "skill-playbook", "Run the short check", tags=("test",)), claim(402, "skill-playbook", "alone", tags=("odd",), authority="inferred-low", confidence=0.5)]
    rows += [claim(500, "permission-restriction", "Command `rm -rf x` is destructive"), claim(501, "environment-prerequisite", "Python 3.12"), claim(502, "module-boundary", "Module 'm'"), claim(503, "validated-command", "npm install", tags=("setup",))]
    claims = spark.createDataFrame(rows, CLAIM)
    files, decisions = projection.project_with_decisions(claims, AS_OF)
    return claims, files.cache(), decisions.cache()


def test_every_claim_has_a_decision_and_every_inclusion_a_file(projected):
    claims, files, decisions = projected
    assert decisions.count() == claims.count() * len(dims.HOSTS)
    assert decisions.filter("reason IS NULL").isEmpty()
    paths = {(r["host"], r["path"]) for r in files.collect()}
    assert {(r["host"], r["path"]) for r in decisions.filter("included").select("host", "path").distinct().collect()} <= paths


def test_files_of_all_kinds(projected):
    files = {r["path"]: r["text"] for r in projected[1].collect()}
    assert {"AGENTS.md", "CLAUDE.md", ".github/copilot-instructions.md", ".claude/settings-snippet.json", ".github/workflows/copilot-setup-steps.yml"} <= set(files)
    assert any(p.startswith(".claude/skills/") for p in files)
    assert "validate-and-test" in files["CLAUDE.md"]
    assert "npm install" in files[".github/workflows/copilot-setup-steps.yml"]
    assert json.loads(files[".claude/settings-snippet.json"])["permissions"]["deny"]


def test_overflow_of_the_line_budget_goes_to_skills(projected):
    rows = projected[2].filter("host = 'claude' AND claim_id < 'claim-00120'").collect()
    assert {r["included"] for r in rows} == {True}
    assert any("/skills/" in r["path"] for r in rows) or sum(1 for r in rows) <= 185


def test_long_skill_files_are_whole_and_a_limit_gives_reasons(spark):
    rows = [claim(i, "skill-playbook", f"Step {i} " + "x" * 90, tags=("test",)) for i in range(400)]
    claims = spark.createDataFrame(rows, CLAIM)

    def skill(**limit):
        files, decisions = projection.project_with_decisions(claims, AS_OF, **limit)
        texts = [r["text"] for r in files.filter("path LIKE '.claude/skills/%'").collect()]
        return texts[0], decisions.filter("host = 'claude'").collect()

    text, decided = skill()
    assert all(f"- Step {i} {'x' * 90}\n" in text for i in range(400))
    assert {r["included"] for r in decided} == {True}
    text, decided = skill(skill_limit=1000)
    whole = {f"claim-{i:05d}" for i in range(400) if f"- Step {i} {'x' * 90}\n" in text}
    assert 0 < len(whole) < 400 and text.endswith("...\n")
    assert {r["claim_id"] for r in decided if r["included"]} == whole
    assert {r["reason"] for r in decided if not r["included"]} == {"beyond the limit of the skill file"}


def test_scopes_with_one_short_name_have_files_of_their_own(projected):
    rows = projected[2].filter("host = 'cursor' AND claim_id IN ('claim-00300', 'claim-00301')").collect()
    assert len({r["path"] for r in rows}) == 2
    for r in projected[1].filter("host = 'cursor' AND path LIKE '%src-a-b%'").collect():
        assert r["text"].count("globs: ") == 1


def test_small_skill_groups_have_a_reason(projected):
    row = projected[2].filter("host = 'claude' AND claim_id = 'claim-00402'").first()
    assert not row["included"] and row["reason"] == "skill group too small"


def test_low_confidence_has_a_reason(projected):
    rows = projection.project_with_decisions(projected[0], AS_OF, min_confidence=0.6)[1].filter("claim_id = 'claim-00402'").collect()
    assert {r["reason"] for r in rows} == {"confidence below the limit"}


def test_a_leak_before_the_gate_is_found(spark, projected):
    secret = spark.createDataFrame([claim(900, "validated-command", "make leak", sensitivity="local-only")], CLAIM)
    files = projection.project(projected[0].limit(10).unionByName(secret), AS_OF)
    found = quality.leakage_check(projected[0].unionByName(secret), quality.file_lines(files)).filter("leaked").collect()
    assert {r["sensitivity"] for r in found} == {"local-only"} and {"agents-md", "claude"} <= {r["host"] for r in found}


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("jobs: []", "no jobs"), ("jobs:\n  copilot-setup-steps: x", "the job is no mapping"), ("jobs:\n  copilot-setup-steps:\n    steps: x", "steps is no list"),
        ("jobs:\n  copilot-setup-steps:\n    steps: [x]", "step 0 is no mapping"), ("jobs:\n  copilot-setup-steps:\n    timeout-minutes: soon", "timeout-minutes is no number"),
        ("jobs:\n  a: {}\n  b: {}", "one job is wanted, there are 2"), ("- 1", "no jobs"),
    ],
)
def test_set_up_steps_are_checked(spark, text, error):
    files = spark.createDataFrame([("r", "copilot-setup-steps.yml", text)], "repo_id string, path string, content string")
    assert [r["error"] for r in extract_config.validate_setup_steps(files.withColumn("x", F.lit(1))).collect()] == [error]
