"""Stored runs: full claims, graph, profiles that outlive other runs, counters and warnings; imports with conflicts."""

import pytest
from pyspark.sql import functions as F

from attesta.plans import index, runs

FILES = "repo_id string, path string, content string"
CI = "on: [push]\njobs:\n  t:\n    runs-on: ubuntu-latest\n    steps:\n      - run: pip install x\n      - run: pytest\n"
STEPS = "jobs:\n  copilot-setup-steps:\n    runs-on: ubuntu-latest\n    env:\n      TOKEN: x\n    steps:\n      - run: npm ci\n"


def repo(name, python="3.12"):
    return [
        (name, "pyproject.toml", f'[project]\nname = "x"\nrequires-python = ">={python}"\n[tool.pytest]\n'), (name, "Makefile", "test:\n\tpytest\ntest:\n\tagain\n"),
        (name, "docker-compose.yml", "services:\n  db:\n    image: postgres:16\n    environment:\n      - PGDATA\n"), (name, ".github/workflows/ci.yml", CI),
        (name, "README.md", "# X\n\n```bash\nnpm test\n```\n"), (name, "src/app/__init__.py", ""), (name, "src/app/core/__init__.py", "import app\n"),
        (name, "src/app/bad.py", "def (:\n"), (name, "package.json", "{broken"), (name, "web/index.ts", "export const a = () => 1;\n"), (name, "data.bin", "x"),
    ]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("index") / "out")
    files = spark.createDataFrame(repo("a") + repo("b", "3.11"), FILES)
    heads = spark.createDataFrame([("a", "abc123")], "repo_id string, repo_head string")
    totals = index.index_repositories(files, target, "2024-01-01T00:00:00Z", "dev", heads)
    return files, target, totals


def test_claims_have_the_full_schema(spark, stored):
    claims = index.read(spark, stored[1], "claims")
    row = claims.filter("repo_id = 'a' AND content = 'make test'").first()
    assert (row["branch"], row["evidence"], row["provenance"]["repo_head"], row["provenance"]["branch"]) == ("dev", ["Makefile"], "abc123", "dev")
    assert row["created_at"] == row["updated_at"] and row["projection_targets"] == []
    assert claims.filter("repo_id = 'b' AND provenance.repo_head <> ''").isEmpty()
    assert claims.groupBy("repo_id", "claim_id").count().filter("count > 1").isEmpty()
    assert stored[2]["claims"] == claims.count() and stored[2]["conflicts"] == claims.filter("claim_type = 'conflict'").count()


def test_counters_and_warnings(spark, stored):
    claims, summary = index.read(spark, stored[1], "claims"), {r["repo_id"]: r for r in index.read(spark, stored[1], "summary").collect()}
    a = summary["a"]
    assert (a["files_parsed"], a["python_files_parsed"], a["js_files_parsed"], a["profiles_created"]) == (10, 3, 1, 1)
    assert a["claims_created"] + a["conflicts_detected"] == claims.filter("repo_id = 'a'").count()
    assert a["modules_detected"] == index.read(spark, stored[1], "modules").filter("repo_id = 'a'").count() == 3
    assert a["edges_created"] == index.read(spark, stored[1], "edges").filter("repo_id = 'a'").count() > 0
    assert a["docs_commands_found"] == 1 and a["prerequisites_extracted"] >= 4 and a["guardrails_extracted"] >= 1 and a["ci_commands_found"] >= 1
    assert a["claims_deduplicated"] >= 0 and "conventions_extracted" in a.asDict()
    assert a["warnings"] == ["not read as package_json: package.json", "not read as python: src/app/bad.py"]
    assert {r["repo_id"]: r["claim_count"] for r in index.read(spark, stored[1], "index").collect()}["a"] == claims.filter("repo_id = 'a'").count()


def test_profiles_of_other_repositories_stay(spark, stored):
    files, target, _ = stored
    before = {r["repo_id"]: r for r in index.read(spark, target, "profiles").collect()}
    assert before["a"]["runtime"] == "Python >=3.12" and before["a"]["services"] == ["postgres:16"] and before["a"]["setup_commands"] == ["pip install x"]
    assert "PGDATA" in before["a"]["env_vars"] and before["a"]["tools"] == []
    fresh = index.environment_profiles(
        spark.createDataFrame([("b", "Python >=3.13", 3), ("c", "Service: redis", 4)], "repo_id string, content string, place int"),
        spark.createDataFrame([], "repo_id string, path string, job_no int, step_no int, line_no int, command string"),
        spark.createDataFrame([("c", "ruff")], "repo_id string, tool string"),
    )
    index.upsert_profiles(fresh, f"{target}/profiles", F.lit("2024-02-01T00:00:00Z"))
    index.upsert_profiles(fresh.withColumn("runtime", F.lit("older")), f"{target}/profiles", F.lit("2023-01-01T00:00:00Z"))
    after = {r["repo_id"]: r for r in index.read(spark, target, "profiles").collect()}
    assert after["a"] == before["a"] and after["b"]["runtime"] == "Python >=3.13" and after["c"]["tools"] == ["ruff"] and after["c"]["runtime"] is None
    assert len(after) == 3


def test_imports_with_setup_steps_conflicts_and_artifacts(spark):
    rows = [("a", "AGENTS.md", "# A\n\n## Commands\n\n```bash\nnpm run gone\n```\n"), ("a", ".github/workflows/copilot-setup-steps.yml", STEPS)]
    files = spark.createDataFrame(rows, FILES)
    known = runs.run_extraction(spark.createDataFrame([("a", "package.json", '{"scripts": {"build": "tsc"}}')], FILES).withColumn("size", F.lit(1).cast("bigint")))
    claims, artifacts = index.import_instructions(files, known, "2024-01-01T00:00:00Z")
    found = {(r["claim_type"], r["content"]): r["source_authority"] for r in claims.collect()}
    assert found["validated-command", "npm run gone"] == found["validated-command", "npm ci"] == found["environment-prerequisite", "Environment variable: TOKEN"] == "declared-imported-unreviewed"
    assert any(kind == "conflict" and "npm run gone" in text for kind, text in found)
    assert {r["path"] for r in artifacts.collect()} == {"AGENTS.md"}
    again, _ = index.import_instructions(files, known.unionByName(claims.select(*known.columns)), "2024-01-01T00:00:00Z")
    assert again.filter("claim_type <> 'conflict'").isEmpty()
    assert {r["path"] for r in index.instruction_files(files).collect()} == {"AGENTS.md", ".github/workflows/copilot-setup-steps.yml"}
