"""What large runs move and store: rows stay where they are unless a key has to bring them together."""

from attesta.operators import extract_config, security
from attesta.plans import runs
from attesta.sources import tables

FILES = "repo_id string, path string, content string, size bigint"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_the_security_scan_moves_no_claim(spark):
    token = "ghp_" + "a1B2" * 9
    texts = [
        f"use {token} or {token}", "<|im_start|> hi", "```\n<|im_start|> hi\n```", 'auth = "123e4567-e89b-12d3-a456-426614174000"', 'auth = "q8Zt-4vLx_0pKd7mWs2hYf9b"', "make test", "", None,
    ]
    rows = spark.createDataFrame([(i, t, "public", "unreviewed") for i, t in enumerate(texts)], "id int, content string, sensitivity string, review_state string")
    out = security.security_scan_claims(rows)
    assert "Exchange" not in plan(out)
    got = {r["id"]: (r["content"], r["sensitivity"], r["review_state"]) for r in out.collect()}
    assert got[0] == ("use ghp_...REDACTED or ghp_...REDACTED", "local-only", "unreviewed")
    assert got[1][1:] == ("public", "needs-declaration")
    assert got[4] == ('auth = "q8Zt...REDACTED"', "local-only", "unreviewed")
    assert all(got[i] == (texts[i], "public", "unreviewed") for i in (2, 3, 5, 6, 7))


def test_claims_of_a_run_are_read_from_compressed_tables(spark):
    files = spark.createDataFrame([("a", "Makefile", "test:\n\tpytest\ndeploy-clean:\n\trm -rf x\n", 40), ("b", "Makefile", "test:\n\tpytest\n", 15)], FILES)
    claims = runs.run_extraction(files)
    assert "ExistingRDD" not in plan(claims) and "Exchange" not in plan(claims)
    found = {(r["repo_id"], r["claim_type"], r["content"]) for r in claims.collect()}
    assert {("a", "validated-command", "make test"), ("b", "validated-command", "make test")} <= found
    assert any(kind == "permission-restriction" and "make deploy-clean" in text for _, kind, text in found)


def test_ci_lines_become_keys_that_commands_can_own(spark):
    """The letters beside a length leave out no key: every kind of match is found, with letters of any size."""
    config = [("r", 0, "t", "make test"), ("r", 1, "bau:größe", "größe prüfen"), ("r", 2, "x", "𝒂b run"), ("r", 3, "", ""), ("r", 4, "z", "pytest -q")]
    lines = {"make test > log": 0, "größe prüfen schnell": 1, "npm run bau:größe": 1, "𝒂b run now": 2, "cd a; pytest -q; b": 4, "ship": None, "makes test": None}
    out = extract_config.ci_match(
        spark.createDataFrame([("r", line) for line in lines], "repo_id string, command string"),
        spark.createDataFrame(config, "repo_id string, ordinal int, name string, command string"),
    )
    assert out.count() == len(lines)
    assert {r["ordinal"] for r in out.collect()} >= {0, 1, 2, 4}


def test_evidence_alone_is_that_of_the_whole_run(spark, monkeypatch):
    ci = "on: [push]\njobs:\n  t:\n    runs-on: ubuntu-latest\n    steps:\n      - run: make test\n"
    rows = [
        ("a", "Makefile", "test:\n\tpytest\ndeploy-clean:\n\trm -rf x\n"), ("a", "package.json", '{"scripts": {"build": "tsc"}}'), ("a", ".github/workflows/ci.yml", ci),
        ("a", "README.md", "```bash\nnpm test\n```\n"), ("b", "Makefile", "test:\n\tpytest\n"), ("b", "docker-compose.yml", "services:\n  db:\n    image: postgres:16\n"),
    ]
    files = spark.createDataFrame([(*r, len(r[2])) for r in rows], FILES)
    want = sorted(tuple(r) for r in runs.run_extraction_with_evidence(files)[1].collect())
    monkeypatch.setattr(runs, "_whole", None)  # claims are not made for it
    got = runs.run_evidence(files)
    assert sorted(tuple(r) for r in got.collect()) == want and {r[1] for r in want} >= {"Makefile", "package.json", "README.md"}


def test_evidence_moves_once_and_keeps_any_text(spark, tmp_path, monkeypatch):
    plans = []
    write = tables._write_sorted
    monkeypatch.setattr(tables, "_write_sorted", lambda rows, *more: (plans.append(rows), write(rows, *more)))
    texts = ["", None, "ab", "AB", "abc", "0f" * 32, "xyz", "ab\n", "\n", "claim-"]
    ids = [*(f"claim-{t}" for t in ("", "00ff", "00FF", "00f", "zz", "00ff\n")), "00ff", "Claim-00ff", ""]
    rows = [("r", c, f"f{i}.py", h, 5, 6, "discovered", "v1") for c in ids for i, h in enumerate(texts)]
    rows += [("r", ids[1], "f2.py", "aa", 4, 9, "discovered", "v1"), ("r", ids[1], "f2.py", "aa", 4, 8, "discovered", "v1"), ("r", ids[1], "f2.py", "ab", 5, 6, "discovered", "v2")]
    evidence = spark.createDataFrame(rows, "repo_id string, claim_id string, file_path string, file_hash string, line_start int, line_end int, evidence_level string, extraction_version string")
    tables.write_evidence(evidence, f"{tmp_path}/evidence")
    assert plan(plans[0]).split("== Physical Plan ==")[1].count("Exchange") == 1
    first = {}
    for r in sorted(rows, key=lambda r: (r[4], r[5])):
        first.setdefault((*r[:3], r[7]), r)
    got = tables.read_evidence(spark, f"{tmp_path}/evidence").select(*evidence.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, first.values()))
    assert sorted(map(repr, map(tuple, tables.unique_evidence(evidence).select(*evidence.columns).collect()))) == sorted(map(repr, first.values()))
