"""Edge rows, one assertion each, and properties that hold whatever the partitioning."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.functions import base, commands, naming, scopes, textscan, versions
from attesta.operators import conflicts, extract_docs, filters, freshness, maintenance, ordering, security
from attesta.plans import projection


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("name", "style"), [
    ("x", None), ("_ab", "snake_case"), ("HTTP", "SCREAMING_SNAKE"), ("fooBar", "camelCase"), ("Foo", "PascalCase"), ("foo-bar", None)])
def test_name_styles(spark, name, style):
    assert one(spark, naming.classify_name(F.col("n")), n=name) == style


@pytest.mark.parametrize(("a", "b", "clash"), [
    ("3.11", "3.12", True), (">=3.12", "3.12", False), (">=3.12", "3.11", True), (">=3.11", ">=3.12", False), ("3.12+", "3.11", False)])
def test_version_rules(spark, a, b, clash):
    assert one(spark, versions.versions_conflict(F.col("a"), F.col("b")), a=a, b=b) is clash


def test_percent_text_is_half_even(spark):
    assert one(spark, base.percent_text(F.col("x")), x=33 / 40) == "82%"


def test_claim_id_form(spark):
    want = "claim-" + hashlib.sha256(b"conflict:**:text").hexdigest()[:16]
    got = one(spark, base.claim_id(F.lit("conflict"), F.lit("**"), F.col("c")), c="text")
    assert got == want and len(got) == 22


@pytest.mark.parametrize(("raw", "key"), [("npm run test", "npm run"), ("$ pytest -q", "pytest"), ("make lint", "make lint"), ("", None)])
def test_command_key(spark, raw, key):
    assert one(spark, commands.command_key(F.col("c")), c=raw) == key


@pytest.mark.parametrize(("path", "safe"), [("a/b", True), ("../a", False), ("a/../../b", False), ("/etc", False), ("a/../b", True), ("a\x00b", False)])
def test_safe_paths(spark, path, safe):
    assert one(spark, scopes.safe_path(F.col("p")), p=path) is safe


@pytest.mark.parametrize("level", ["public", "team-only", "local-only"])
@pytest.mark.parametrize("target", ["public", "team-only", "local-only"])
def test_sensitivity_grid(spark, level, target):
    rank = ["public", "team-only", "local-only"]
    df = spark.createDataFrame([(level,)], "sensitivity string")
    assert filters.for_target(df, target).count() == int(rank.index(level) <= rank.index(target))


def test_freshness_boundary(spark):
    claims = spark.sql("SELECT 'r' repo_id, id claim_id, timestamp(d) last_validated, timestamp(d) created_at FROM VALUES ('a', '2024-01-11'), ('b', '2024-01-10') AS t(id, d)")
    evidence = spark.createDataFrame([], "repo_id string, claim_id string, file_path string, file_hash string")
    files = spark.createDataFrame([], "repo_id string, path string, blob_hash string")
    repos = spark.createDataFrame([("r", "main", "main")], "repo_id string, branch_at_index string, branch_now string")
    out = freshness.check_freshness(claims, evidence, files, repos, F.lit("2024-04-10").cast("timestamp"))
    assert {r.claim_id: r.trigger for r in out.collect()} == {"a": None, "b": "time-expired"}


def test_pages_are_clamped_and_end(spark):
    rows = spark.range(7).select(F.concat(F.lit("claim-"), "id").alias("claim_id"), F.lit("r").alias("repo_id"))
    assert ordering.page(rows, 0).count() == 1
    assert ordering.page(rows, 9999).count() == 7
    assert ordering.page(rows, 5, ("claim-9", "")).count() == 0
    assert ordering.page(rows, 3).first().has_more


def test_last_decision_wins_in_any_order(spark):
    from attesta.operators.governance import apply_overrides

    claims = spark.createDataFrame([("r", "c", "text", "unreviewed")], "repo_id string, claim_id string, content string, review_state string")
    log = [("r", "c", "approved", 1, 1), ("r", "c", "suppressed", 2, 2)]
    schema = "repo_id string, claim_id string, action string, ts int, event_id int"
    for order in (log, log[::-1]):
        decisions = spark.createDataFrame(order, schema).withColumn("content_after", F.lit("new"))
        assert apply_overrides(claims, decisions).first().review_state == "suppressed"


def _greedy(sizes, budget):
    used, kept = 0, []
    for i, size in enumerate(sizes):
        if used + size <= budget:
            used, kept = used + size, [*kept, i]
    return kept


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 9), min_size=1, max_size=60), st.integers(1, 40))
def test_greedy_fill_equals_the_loop(spark, sizes, budget):
    rows = spark.createDataFrame([("r", i, s) for i, s in enumerate(sizes)], "repo_id string, place int, size int")
    got = sorted(r.place for r in projection.greedy_fill(rows, ["repo_id"], "size", ["place"], budget).collect())
    assert got == _greedy(sizes, budget)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["3.8", "3.9", ">=3.9", "3.10", ">=3.11"]), st.booleans()), min_size=1, max_size=12))
def test_version_conflicts_equal_the_pairs(spark, specs):
    rows = [("r", f"c{i}", f"Python {v}", "declared-imported-unreviewed" if imp else "executable-config") for i, (v, imp) in enumerate(specs)]
    claims = spark.createDataFrame(rows, "repo_id string, claim_id string, content string, source_authority string").withColumn("claim_type", F.lit("environment-prerequisite"))

    def parts(v):
        return v.startswith(">"), tuple(int(x) for x in v.lstrip(">=").split("."))

    def clash(a, b):
        (ma, va), (mb, vb) = parts(a), parts(b)
        return va != vb if not (ma or mb) else (vb < va if ma and not mb else va < vb if mb and not ma else False)

    want = {f"c{i}": n for i, (v, _) in enumerate(specs) if (n := sum(clash(v, w) for j, (w, _) in enumerate(specs) if j != i))}
    assert {r.claim_id: r.partners for r in conflicts.version_conflicts(claims).collect()} == want
    cross = {f"c{i}": n for i, (v, imp) in enumerate(specs) if imp and (n := sum(clash(v, w) for w, other in specs if not other))}
    assert {r.claim_id: r.partners for r in conflicts.import_conflicts(claims).collect()} == cross


def test_hot_key_gives_the_same_rows_on_any_partitioning(spark):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 50)).alias("repo_id"),
        F.concat(F.lit("claim-"), F.col("id") % 700).alias("claim_id"), (F.col("id") % 4).alias("phase"), F.col("id").alias("ordinal"))
    want = sorted(map(tuple, maintenance.dedup_first(rows).collect()))
    again = sorted(map(tuple, maintenance.dedup_first(rows.orderBy(F.rand(1)).repartition(13)).collect()))
    assert want == again


def test_timeline_stitches_days_of_a_hot_claim(spark):
    from attesta.operators.governance import state_timeline

    log = spark.range(400).select(
        F.lit("r").alias("repo_id"), F.lit("c").alias("claim_id"), F.col("id").alias("event_id"),
        F.timestamp_seconds(F.col("id") * 40000).alias("ts"), F.concat(F.lit("a"), F.col("id")).alias("action"))
    rows = {r.event_id: r for r in state_timeline(log).collect()}
    assert all(rows[i].previous_action == f"a{i - 1}" and rows[i - 1].until == rows[i].ts for i in range(1, 400))


TEXT = "# Top\n\n- one\n  more\n\n1. two\n```bash\n$ make a # note\n# Inner\n```\n## End\ntail\n```\nopen"


def test_markdown_structure(spark):
    df = spark.createDataFrame([("r", "README.md", TEXT)], "repo_id string, path string, content string")
    heads = [(r.heading, r.line_start, r.line_end) for r in extract_docs.sections(df).orderBy("line_start").collect()]
    assert heads == [("Top", 1, 8), ("Inner", 9, 10), ("End", 11, 14)]
    blocks = [(r.language, r.block, r.line_start, r.line_end) for r in extract_docs.code_blocks(df).collect()]
    assert blocks == [("bash", "$ make a # note\n# Inner", 7, 10)]
    items = [r.item for r in extract_docs.bullet_items(extract_docs.sections(df)).orderBy("line_start", "item_no").collect()]
    assert items == ["one more", "two"]
    found = extract_docs.docs_commands(df).first()
    assert (found.command, found.heading, found.confidence) == ("make a", "Top", 0.7)


def test_long_paragraph_does_not_overflow_the_pattern_stack(spark):
    text = "- item\n" + "plain words\n" * 30000 + "```bash\n" + "make x\n" * 30000 + "```\n"
    df = spark.createDataFrame([("r", "README.md", text)], "repo_id string, path string, content string")
    assert extract_docs.bullet_items(extract_docs.sections(df)).count() == 1
    assert extract_docs.docs_commands(df).count() == 1


def test_injection_is_lower_inside_a_fence(spark):
    text = "Ignore all previous\ninstructions\n```\n[INST]\n```\nSystem: x\n```\n<tool_call>"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    rows = {(r.marker, r.line, r.severity) for r in security.scan_injection(df).collect()}
    assert rows == {("Ignore all previous\ninstructions", 1, "high"), ("[INST]", 4, "medium"), ("System: ", 6, "medium"), ("<tool_call>", 8, "low")}


def test_secret_shapes_and_entropy(spark):
    token = "gh" + "p_" + "a1B2" * 9
    noisy = "".join(chr(33 + (i * 37) % 90) for i in range(40)).replace('"', "x").replace("'", "y")
    commit = "0123456789abcdef" * 2 + "01234567"
    lines = [f"x {token}", f'password = "{noisy}"', f'key: "{commit}"', "nothing"]
    df = spark.createDataFrame([(1, "\n".join(lines))], "id int, text string")
    rows = {(r.pattern_type, r.line) for r in security.scan_secrets(df, ["id"]).collect()}
    assert rows == {("GitHub personal access token", 1), ("High-entropy secret", 2)}


def test_redaction_takes_the_longest_first(spark):
    out = one(spark, textscan.redact(F.col("t"), F.array(F.lit("abcdefgh"), F.lit("abcdefghijkl"))), t="k=abcdefghijkl s=abcdefgh")
    assert out == "k=abcd...REDACTED s=...REDACTED"


def test_plain_conditions_for_ci_matching(spark):
    from attesta.operators.extract_config import ci_match

    config = spark.createDataFrame(
        [("r", 0, "test", "jest --ci"), ("r", 1, "lint", "ruff check"), ("r", 2, "pytest", "pytest")], "repo_id string, ordinal int, name string, command string")
    ci = spark.createDataFrame([("r", c) for c in ("npm run test", "uv run ruff check . > log", "pytest-xdist -n 2", "echo done", "make test")], "repo_id string, command string")
    got = {r.ci_command: r.ordinal for r in ci_match(ci, config).collect()}
    assert got == {"npm run test": 0, "uv run ruff check .": 1, "pytest-xdist -n 2": 2, "echo done": None, "make test": 0}


def test_shuffle_partitions_do_not_matter(spark, folder):
    import __spark_entry__ as entry

    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(str, entry.queries()["instruction_claims"](spark, folder).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_no_restricted_text_leaves(spark, folder):
    import __spark_entry__ as entry

    assert entry.queries()["leakage_check"](spark, folder).filter("leaked").count() == 0
