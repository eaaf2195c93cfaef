"""A cross-section of the registered queries against their check SQL on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from attesta.bindings import BASE
from check import _rows

NAMES = (
    "validated_commands", "dedup_first", "resolve_by_precedence", "page_by_precedence", "check_freshness", "state_timeline",
    "same_key_conflicts", "version_conflicts", "convention_topic_conflicts", "docs_commands", "bullet_items", "scan_injection",
    "scan_secrets", "package_json_commands", "dockerfile_facts", "ci_match", "runtime_prereqs", "naming_stats", "python_symbols",
    "js_symbols", "import_edges", "map_tests_to_modules", "route_claims", "budget_prefix", "budget_greedy", "line_budget_overflow",
    "workspace_budget", "shared_instruction_file", "stream_tool_sessions", "stream_review_state",
)


@pytest.fixture(scope="module")
def con(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, folder, con, name):
    df = entry.queries()[name](spark, folder)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, cur.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
