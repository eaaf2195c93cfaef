"""A whole run over small repositories: every phase shows in the claims, and evidence names the files."""

import pytest
from pyspark.sql import functions as F

from attesta.functions.base import blob_id
from attesta.operators import freshness
from attesta.plans import runs

FILES = "repo_id string, path string, content string"


def python_file(i):
    return f"import os\n\n\ndef do_thing_{i}(a: int) -> int:\n    return a\n\n\ndef do_more_{i}(a: int) -> int:\n    return a\n"


@pytest.fixture(scope="module")
def run(spark):
    rows = [
        ("a", "pyproject.toml", '[project]\nname = "x"\nrequires-python = ">=3.12"\n[project.scripts]\nwipe-all = "app:wipe"\n[tool.ruff]\n[tool.bandit]\n[tool.pytest]\n'),
        ("a", "Makefile", "deploy-clean:\n\trm -rf x\ntest:\n\tpytest\n"), ("a", "docker-compose.yml", "services:\n  db:\n    image: postgres:16\n"),
        ("a", ".github/workflows/ci.yml", "on: [push]\njobs:\n  t:\n    runs-on: ubuntu-latest\n    steps:\n      - run: bandit -r src\n      - run: pytest\n"),
        ("a", "README.md", "# X\n\n```bash\nnpm test\n```\n\nRequires Python 3.9+\n"), ("a", "package.json", '{"scripts": {"build": "tsc"}}'),
        ("c", "README.md", "# C\n\n```bash\nnpm test\n```\n"), ("c", "package.json", '{"scripts": {"build": "tsc"}}'),
        ("b", "README.md", "# B\n\n```bash\npytest tests\n```\n"),
    ]
    rows += [("a", f"src/app/mod_{i}.py", python_file(i)) for i in range(15)] + [("b", f"src/app/mod_{i}.py", python_file(i)) for i in range(15)]
    script = "".join(f"export function doThing{{0}}{k}() {{{{}}}}\n" for k in range(2))
    rows += [("b", f"web/{i}.test.ts", "import { it } from 'vitest';\nit('x', () => {});\n" + script.format(i)) for i in range(22)]
    files = spark.createDataFrame(rows, FILES).withColumn("size", F.length("content").cast("long"))
    claims, evidence = runs.run_extraction_with_evidence(files, as_of="2024-01-01T00:00:00Z")
    return files, claims.cache(), evidence.cache()


def contents(claims, repo, kind=None):
    rows = claims.filter(F.col("repo_id") == repo) if kind is None else claims.filter((F.col("repo_id") == repo) & (F.col("claim_type") == kind))
    return {r["content"] for r in rows.collect()}


def test_guardrails_are_claims(run):
    found = contents(run[1], "a", "permission-restriction")
    assert any("requires services: postgres" in x for x in found)
    assert any(x.startswith("Security tooling configured: bandit") for x in found)
    assert any("security scan" in x for x in found)


def test_script_conventions_and_formatter(run):
    b, a = contents(run[1], "b"), contents(run[1], "a")
    assert "Test framework: Vitest" in b or any(x.startswith("Test framework: ") for x in b)
    assert any(x.startswith("Use camelCase for function names") for x in b)
    assert any(x.startswith("Use snake_case for function names") for x in b)
    assert not any(x.startswith("Use snake_case for function names") for x in a)
    assert any(x.startswith("TypeScript is the primary language") for x in b)


def test_conflicts_need_a_declaration(run):
    rows = run[1].filter("claim_type = 'conflict'").collect()
    assert any(r["repo_id"] == "c" and "npm test" in r["content"] for r in rows)
    assert {r["review_state"] for r in rows} == {"needs-declaration"}


def test_ids_are_unique_and_columns_serve_freshness(spark, run):
    files, claims, evidence = run
    assert claims.groupBy("repo_id", "claim_id").count().filter("count > 1").isEmpty()
    repos = claims.select("repo_id").distinct().select("repo_id", F.lit("main").alias("branch_at_index"), F.lit("main").alias("branch_now"))
    edited = F.concat("content", F.when(F.col("path") == "README.md", "!").otherwise(""))
    now = files.filter("path <> 'Makefile'").select("repo_id", "path", blob_id(edited).alias("blob_hash"))
    out = freshness.check_freshness(claims, evidence, now, repos, F.lit("2024-01-02").cast("timestamp"))
    stale = {r["trigger"] for r in out.filter("stale").collect()}
    assert {"evidence-deleted", "evidence-changed"} <= stale


def test_evidence_names_files(run):
    paths = {r["file_path"] for r in run[2].filter("repo_id = 'a'").collect()}
    assert {"Makefile", "pyproject.toml", "README.md"} <= paths
    assert run[2].filter("file_hash IS NULL").isEmpty()


def test_an_extractor_can_be_added(spark):
    """A role's files to rows with a type and a text, and nothing else in the library changes."""

    def todo(files):
        found = F.regexp_extract_all("content", F.lit(r"(?m)^# TODO: (.*)$"), F.lit(1))
        return files.select("repo_id", "path", F.explode(found).alias("content")).withColumn("claim_type", F.lit("always-on-rule")).withColumn("confidence", F.lit(0.5))

    files = spark.createDataFrame([("t", "Makefile", "# TODO: tidy up\ntest:\n\tpytest\n")], FILES).withColumn("size", F.length("content").cast("long"))
    runs.register_extractor("todo", "makefile", todo)
    try:
        claims, evidence = runs.run_extraction_with_evidence(files)
        row = claims.filter("content = 'tidy up'").first()
        assert (row["claim_type"], row["confidence"], row["review_state"], row["scope"]) == ("always-on-rule", 0.5, "unreviewed", "**")
        assert [r["file_path"] for r in evidence.filter(F.col("claim_id") == row["claim_id"]).collect()] == ["Makefile"]
    finally:
        runs._registered.clear()
    assert contents(runs.run_extraction(files), "t") & {"tidy up", "make test"} == {"make test"}
