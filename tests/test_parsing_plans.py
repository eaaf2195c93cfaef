"""Where parsing and large joins stand in the plans: on the spread rows, once, and not through the driver."""

import pytest
from pyspark.sql import functions as F

import attesta.catalog  # noqa: F401  (registers the queries)
from attesta.catalog.registry import QUERIES, runner
from attesta.functions import codecs
from attesta.operators import extract_code
from attesta.operators import extract_config as config


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["import_edges", "dependencies", "dependents"])
def test_files_meet_their_modules_without_a_broadcast(spark, folder, name):
    assert "BroadcastExchange" not in planned(runner(QUERIES[name])(spark, folder))


@pytest.mark.parametrize("parse", [config.workflow_documents, config.pyproject_documents, config.compose_services, extract_code.js_symbols])
def test_a_file_is_parsed_once_and_behind_the_repartition(spark, parse):
    files = spark.range(3).select(F.lit("r").alias("repo_id"), F.lit("p").alias("path"), F.col("id").cast("string").alias("content")).repartition(2)
    plan = planned(parse(files))
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("ArrowEvalPython") < plan.index("REPARTITION_BY_NUM")


def test_variables_of_a_workflow_come_from_one_parse(spark, folder):
    assert "ArrowEvalPython" not in planned(runner(QUERIES["ci_env_names"])(spark, folder))


def test_copies_of_a_text_in_a_batch_are_parsed_once():
    import pandas as pd

    calls = []
    out = codecs._each_once(pd.Series(["a", None, "a", "b", None], dtype=object), lambda x: calls.append(x) or (x and x * 2))
    assert calls == ["a", None, "b"] and out.tolist() == ["aa", None, "aa", "bb", None]


def test_filters_on_generated_texts_stay_on_the_spread_rows(spark, folder):
    """What a query computes from the text of a file stands behind the repartition of the small table it is made from."""
    for name in ("naming_stats", "package_json_engines", "dockerfile_facts"):
        plan = planned(runner(QUERIES[name])(spark, folder))
        behind = plan[plan.index("REPARTITION_BY_NUM"):]
        assert "regexp_extract_all" not in behind and "try_parse_json" not in behind and "json" not in behind.lower()


@pytest.mark.parametrize("name", ["ci_match", "ci_claims"])
def test_commands_meet_their_lines_without_a_broadcast_or_a_second_parse(spark, folder, name):
    plan = planned(runner(QUERIES[name])(spark, folder))
    assert "BroadcastExchange" not in plan and "ArrowEvalPython" not in plan


def test_the_words_of_a_name_are_cut_once(spark):
    from attesta import dims
    from attesta.functions.commands import risk_by_name

    names = spark.createDataFrame([("unit-Test:ci",), ("pretest",), ("deploy_lint",), ("zzz",), ("",), (None,)], "name string")
    rows = names.repartition(2).select("name", risk_by_name(F.col("name"), dims.PACKAGE_RISK).alias("risk"))
    assert planned(rows).count("split(") == 1
    table = dims.PACKAGE_RISK

    def plain(name):
        import re

        words = re.split(r"[-_:.\s]+", (name or "").lower())
        return next((r for k, r in table.items() if k in words), next((r for k, r in table.items() if name and k in name.lower()), "build"))

    assert {r["name"]: r["risk"] for r in rows.collect()} == {n: plain(n) for n in ("unit-Test:ci", "pretest", "deploy_lint", "zzz", "", None)}


def test_names_are_classified_once_and_counted_without_a_sort(spark):
    from attesta.operators import conventions

    rows = [("r", "f", d, p, n) for d, p, n in ((1, 0, "fooBar"), (1, 1, "x"), (2, 0, "a_b"), (2, 5, "c_d"), (3, 0, "barBaz"))]
    names = spark.createDataFrame(rows, "repo_id string, kind string, doc_id int, pos int, name string").repartition(2)
    stats = conventions.naming_stats(names, ["repo_id", "kind"], ["doc_id", "pos"])
    lines = planned(stats).split("\n")
    assert not any("Filter" in x and "RLIKE" in x for x in lines)
    first = next(i for i, x in reversed(list(enumerate(lines))) if "Aggregate" in x)
    assert "HashAggregate" in lines[first] and "SortAggregate" not in lines[first]
    assert [tuple(r) for r in stats.collect()] == [("r", "f", 4, 2, "camelCase", 0.5)]


def test_symbols_of_a_script_are_read_from_their_json_once(spark):
    files = spark.range(3).select(F.lit("r").alias("repo_id"), F.lit("p.js").alias("path"), F.lit("import 'a';").alias("content")).repartition(2)
    lines = planned(extract_code.js_symbols(files)).split("\n")
    assert sum("from_json" in x for x in lines) == 1 and not any("Filter" in x and "from_json" in x for x in lines)
    assert extract_code.js_symbols(files).count() == 3


def test_scripts_are_parsed_before_their_imports_are_looked_up(spark, folder):
    assert "ArrowEvalPython" not in planned(runner(QUERIES["resolve_js_imports"])(spark, folder))


def test_owners_are_looked_up_per_folder(spark):
    from attesta.operators import graph

    modules = [("r", "a", "m.a"), ("r", "a/b", "m.b"), ("r", "a/b", "m.c"), ("r", "a/own", "m.own"), ("r", "", "root"), ("q", "a", "q.a")]
    paths = [("r", p) for p in ("a/x.py", "a/b/x.py", "a/b/c/y.py", "a/own", "ab/x.py", "x.py", "/a/x.py", "a/b")] + [("q", "a/b/x.py")]
    rows = graph.path_to_module(spark.createDataFrame(paths, "repo_id string, path string"), spark.createDataFrame(modules, "repo_id string, module_path string, module string"))
    assert {(r["repo_id"], r["path"]): r["module"] for r in rows.collect()} == {
        ("r", "a/x.py"): "m.a", ("r", "a/b/x.py"): "m.c", ("r", "a/b/c/y.py"): "m.c", ("r", "a/own"): "m.own", ("r", "a/b"): "m.c", ("r", "/a/x.py"): "root", ("q", "a/b/x.py"): "q.a",
    }


def test_the_files_of_a_graph_are_routed_once(spark, folder):
    """What is left to the plan of the edges reads kept rows only, no table of files."""
    assert "FileScan" not in planned(runner(QUERIES["run_graph"])(spark, folder))


def test_items_of_instruction_files_are_found_once(spark):
    from attesta.operators import extract_docs

    files = spark.createDataFrame([("r", "CLAUDE.md", "# Misc\n- Never push\nAlways test first\n")], "repo_id string, path string, content string")
    claims = extract_docs.instruction_claims(files.repartition(2))
    assert planned(claims).count("[-*+]") == 0
    assert "Never push" in [r["claim_text"] for r in claims.collect()]


YAML_TEXTS = (
    "on: push\nyes: 1\n1.0: b\n1: c", "a: [1, 0x1F, 014, 1_000, 1:30, .inf, 1e3, 08, ~, 'x', \"y\\n\"]\nb: |\n  t\n  u\nc: 2024-01-02", "a:\n? b", "[a, b]", "", "a: {",
    "a: &x {k: 1}\nb:\n  <<: *x\n  l: 2\nc: *x", "? [1]\n: 2", "a: !!str 1", "a: 2024-13-45", "=: a", "a: =", "---\na: 1\n---\nb: 2", "*x", "a: 1\na: 2", "x: [a: 1, b: 2]", "a: ! 1", "2024-01-02: a",
)


def test_yaml_texts_give_what_the_loader_gives():
    import json

    import pandas as pd
    import yaml

    def loaded(text):
        try:
            value = yaml.load(text, Loader=yaml.CSafeLoader)
            return json.dumps(value, default=str) if isinstance(value, dict) else None
        except (yaml.YAMLError, ValueError, TypeError):
            return None

    assert codecs._yaml_udf.func(pd.Series([*YAML_TEXTS, "a: !!int ", None], dtype=object)).tolist() == [*map(loaded, YAML_TEXTS), None, None]


def test_a_plain_yaml_text_is_read_without_a_tree_of_nodes(monkeypatch):
    import pandas as pd

    def load(text, Loader):
        raise AssertionError(text)

    monkeypatch.setattr(codecs.yaml, "load", load)
    assert codecs._yaml_udf.func(pd.Series(["jobs:\n  a: {steps: [{run: x}], n: 3}"])).tolist() == ['{"jobs": {"a": {"steps": [{"run": "x"}], "n": 3}}}']
