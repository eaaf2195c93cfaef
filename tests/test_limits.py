"""Hostile files cost their own row only, and no size makes a result disappear."""

import json

import pytest

from attesta.functions import codecs
from attesta.operators import extract_config
from attesta.plans import projection

CLAIM = (
    "repo_id string, claim_id string, claim_type string, content string, scope string, source_authority string, risk_class string, "
    "applicability array<string>, confidence double, sensitivity string, authority_level int, review_state string"
)
BOMB = "a: &a [x, x, x, x, x, x, x, x, x]\n" + "".join(f"{b}: &{b} [*{a}, *{a}, *{a}, *{a}, *{a}, *{a}, *{a}, *{a}, *{a}]\n" for a, b in zip("abcdefgh", "bcdefghi", strict=True))
BAD_YAML = ["d: 2024-13-45\n", BOMB, "x: " + "[" * 20_000, "? {a: 1}\n: b\n", "\x00", "a: !!timestamp x"]


def test_bad_workflows_leave_the_others(spark):
    good = "on: [push]\njobs:\n  t:\n    steps:\n      - run: pytest\n"
    rows = [("r", f"{i}.yml", t) for i, t in enumerate([*BAD_YAML, good, None, ""])]
    docs = extract_config.workflow_documents(spark.createDataFrame(rows, "repo_id string, path string, content string")).collect()
    assert [json.loads(d["doc"])["jobs"]["t"]["steps"][0]["run"] for d in docs if "jobs" in d["doc"]] == ["pytest"]
    assert all(len(d["doc"]) < 10_000 for d in docs)


@pytest.mark.parametrize("text", ["-" * 50_000 + "1", "(" * 300, "x = " + "[" * 500, "def f(:\n", "a" + "+a" * 60_000, "\x00"])
def test_bad_python_is_an_error_row(text):
    found = json.loads(codecs._python(text))
    assert found["rows"] == [] and isinstance(found["errors"], bool)


def test_bad_toml_is_null():
    assert [codecs._toml(t) for t in ("a = [" + "[" * 5000, "a = 2024-13-45", "=", "\x00")] == [None] * 4


def test_yaml_is_refused_without_its_parser(monkeypatch):
    monkeypatch.setattr(codecs, "yaml", None)
    with pytest.raises(ImportError):
        codecs.yaml_to_json("content")


def _claims(spark, kind, texts, **more):
    rows = [
        ("r", f"claim-{i:07d}", kind, t, "**", "human-override", "build", more.get("tags", ["all"]), 1.0, "public", 10, "approved") for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, CLAIM)


def test_large_install_commands_all_reach_the_setup_file(spark):
    texts = [f"npm install {'x' * 400_000}{i}" for i in range(4)]
    doc = json.loads(projection.setup_steps(_claims(spark, "validated-command", texts)).first()["text"])
    steps = next(iter(doc["jobs"].values()))["steps"]
    assert [s["run"] for s in steps if "run" in s] == texts


def test_large_files_and_deny_lists_stay_whole(spark):
    texts = [f"rule {'y' * 30_000} {i}" for i in range(60)]
    lines = projection.scoped_lines(projection.route_claims(_claims(spark, "scoped-rule", texts).replace("**", "src/a", ["scope"])))
    for row in projection.assemble(lines, "2024-01-01T00:00:00Z").collect():
        assert all(f"y {i}\n" in row["text"] for i in range(60))


def test_greedy_takes_empty_items_and_skips_misfits(spark):
    rows = [("r", "a", 0), ("r", "b", 3), ("r", "c", 9), ("r", "d", 7), ("r", "e", 0), ("q", "a", 11)]
    items = spark.createDataFrame(rows, "repo_id string, id string, size int")
    kept = projection.greedy_fill(items, ["repo_id"], "size", ["id"], 10)
    assert sorted((r["repo_id"], r["id"]) for r in kept.collect()) == [("r", "a"), ("r", "b"), ("r", "d"), ("r", "e")]


def test_greedy_is_linear_in_the_items(spark):
    items = spark.range(100_000).selectExpr("'r' AS repo_id", "id", "1 AS size")
    assert projection.greedy_fill(items, ["repo_id"], "size", ["id"], 60_000).count() == 60_000


def test_ci_match_takes_long_lines(spark):
    words = " ".join(f"step{i}" for i in range(5_000))
    lines = [("r", f"{words} && pytest tests/unit -x; done"), ("r", "npm run build:all"), ("r", words)]
    config = [("r", 2, "unit", "pytest tests/unit"), ("r", 1, "none", "pytest tests/unit2"), ("r", 3, "build:all", "tsc -b"), ("r", 4, "", "")]
    out = extract_config.ci_match(
        spark.createDataFrame(lines, "repo_id string, command string"), spark.createDataFrame(config, "repo_id string, ordinal int, name string, command string")
    )
    assert sorted((len(r["ci_command"]) > 1000, r["ordinal"]) for r in out.collect() if r["ordinal"]) == [(False, 3), (True, 2)]


def test_commands_beyond_old_packing_keep_their_order(spark):
    scripts = "\n".join(f'[tool.hatch.envs.e{i}.scripts]\nt = "run {i}"' for i in range(1_200))
    docs = extract_config.pyproject_documents(spark.createDataFrame([("r", "pyproject.toml", f"{scripts}\n")], "repo_id string, path string, content string"))
    none = spark.createDataFrame([], "repo_id string, path string, ordinal int, name string, command string, risk_class string, confidence double")
    rows = extract_config.configured_commands(extract_config.pyproject_commands(docs), none, none).collect()
    assert len({r["ordinal"] for r in rows}) == 1_200
    assert [r["command"] for r in sorted(rows, key=lambda r: r["ordinal"])] == [f"run {i}" for i in range(1_200)]


def test_clean_texts_have_a_row_of_zeros(spark):
    from attesta.operators import security

    rows = spark.createDataFrame([(1, "nothing here"), (2, "<|im_start|> hi"), (3, None)], "id int, text string")
    assert sorted(tuple(r) for r in security.security_warnings(rows, ["id"]).collect()) == [(1, 0, 0), (2, 1, 0), (3, 0, 0)]


def test_argument_maps_are_fit_for_a_log(spark):
    from attesta.operators import security

    token = "ghp_" + "a1B2" * 9
    call = {"q": f"use {token} now", "ids": "[1, 2, 3]", "opts": '{"a": 1, "b": {}}', "long": "x" * 300, "broken": "[1,", "none": None}
    rows = spark.createDataFrame([(1, call), (2, {}), (3, None)], "id int, arguments map<string,string>")
    out = {r["id"]: r["arguments"] for r in security.sanitize_arguments(rows, ["id"]).collect()}
    assert out[1] == {"q": "use ghp_...REDACTED now", "ids": "[list of 3 items]", "opts": "{dict with 2 keys}", "long": "x" * 100 + "... (300 chars)", "broken": "[1,", "none": None}
    assert out[2] == out[3] == {}
