"""Streams over several batches: refresh with emptied and deleted files, late rows, repeated batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import attesta.catalog  # noqa: F401  (registers the queries)
from attesta.catalog.registry import QUERIES, runner
from attesta.operators import extract_docs
from attesta.streaming import jobs, refresh, review

FILES = "repo_id string, path string, content string"


def doc(command):
    return f"# R\n\n```bash\n{command}\n```\n"


@pytest.fixture
def folders(tmp_path):
    return {name: str(tmp_path / name) for name in ("in", "out", "marks")}


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_refresh_follows_changes_and_deletions(spark, folders):
    def step(rows):
        put(spark, rows, FILES, folders["in"])
        files = spark.readStream.schema(FILES).parquet(folders["in"])
        jobs.refresh(files, folders["out"], extract_docs.docs_commands, folders["marks"]).awaitTermination()
        return {(r["path"], r["command"]) for r in jobs.current_claims(spark, folders["out"]).collect()}

    assert step([("r", f"docs/{n}.md", doc(f"make {n}")) for n in "abcd"]) == {(f"docs/{n}.md", f"make {n}") for n in "abcd"}
    assert step([("r", "docs/a.md", doc("make new")), ("r", "docs/b.md", "nothing left"), ("r", "docs/c.md", None)]) == {("docs/a.md", "make new"), ("docs/d.md", "make d")}
    assert step([("r", "docs/c.md", doc("make again"))]) == {("docs/a.md", "make new"), ("docs/c.md", "make again"), ("docs/d.md", "make d")}


def test_a_batch_that_runs_again_replaces_its_rows(spark, folders):
    put(spark, [("r", "docs/a.md", doc("make a"))], FILES, folders["in"])
    for marks in ("marks", "out-marks"):  # a lost checkpoint: batch 0 runs twice into one target
        files = spark.readStream.schema(FILES).parquet(folders["in"])
        jobs.refresh(files, folders["out"], extract_docs.docs_commands, folders["marks"] + marks).awaitTermination()
    assert jobs.current_claims(spark, folders["out"]).count() == 1


def test_refresh_takes_the_newest_version_of_a_batch(spark, folders):
    schema = FILES + ", version long"
    put(spark, [("r", "docs/a.md", doc("make new"), 2), ("r", "docs/a.md", doc("make old"), 1), ("r", "docs/b.md", doc("make b"), 5), ("r", "docs/b.md", None, 6)], schema, folders["in"])
    jobs.refresh(spark.readStream.schema(schema).parquet(folders["in"]), folders["out"], extract_docs.docs_commands, folders["marks"]).awaitTermination()
    assert [r["command"] for r in jobs.current_claims(spark, folders["out"]).collect()] == ["make new"]


VERSIONS = FILES + ", version long"


def refresh_step(spark, folders, rows, **given):
    put(spark, rows, VERSIONS, folders["in"])
    refresh.refresh(spark.readStream.schema(VERSIONS).parquet(folders["in"]), folders["out"], folders["marks"], **given).awaitTermination()
    claims = {(r["repo_id"], r["content"]): r for r in refresh.current(spark, folders["out"], "claims").collect()}
    log = refresh.changes(spark, folders["out"])
    last = log.agg(F.max("batch")).first()[0]
    names = {r["claim_id"]: r["content"] for r in spark.read.parquet(f"{folders['out']}/claims/batch=*").select("claim_id", "content").collect()}
    return claims, {(r["repo_id"], names[r["claim_id"]]): r["change"] for r in log.filter(F.col("batch") == last).collect()}


def test_whole_refresh_counts_support_and_keeps_decisions(spark, folders):
    prose = "# A\n\nRequires Python 3.9+\n"
    variable = ("a", "Python 3.9")

    def named(claims, part):
        return [r for (repo, content), r in claims.items() if repo == "a" and part in content]

    claims, change = refresh_step(spark, folders, [
        ("a", "Makefile", "test:\n\tpytest\nold:\n\tx\n", 1), ("a", "Makefile", "test:\n\tpytest\nlint:\n\truff\n", 2),
        ("a", "README.md", prose, 1), ("a", "docs/setup.md", prose, 1), ("b", "Makefile", "all:\n\tgo\n", 1),
    ])
    assert ("a", "make lint") in claims and ("a", "make old") not in claims and ("b", "make all") in claims
    assert set(change.values()) == {"new"}
    (both,) = named(claims, variable[1])
    assert both["support"] == 2
    # a decision is taken on the stored claims, an older version comes late, one of two supporting files goes
    path = f"{folders['out']}/claims/batch=0"
    decided = spark.read.parquet(path).withColumn("review_state", F.when(F.col("content") == "make test", "approved").otherwise(F.col("review_state")))
    rows = decided.collect()
    spark.createDataFrame(rows, decided.schema).write.mode("overwrite").parquet(path)
    claims, change = refresh_step(spark, folders, [("a", "Makefile", "old:\n\tx\n", 1), ("a", "docs/setup.md", None, 2)])
    assert ("a", "make lint") in claims and ("a", "make old") not in claims
    (one,) = named(claims, variable[1])
    assert one["support"] == 1 and claims["a", "make test"]["review_state"] == "approved"
    assert change["a", one["content"]] == "stale" and change["a", "make lint"] == "stable"
    # the last supporting file goes, and batches are compacted
    claims, change = refresh_step(spark, folders, [("a", "README.md", None, 2), ("a", "Makefile", "test:\n\tpytest\n", 3)], compact_every=3)
    assert not named(claims, variable[1]) and change["a", "make lint"] == "removed" and change["a", one["content"]] == "removed"
    assert ("b", "make all") in claims and claims["a", "make test"]["review_state"] == "approved"
    base = spark.read.parquet(f"{folders['out']}/repos/batch=2").filter("compacted").select("repo_id").collect()
    assert {r["repo_id"] for r in base} == {"a", "b"}
    # nothing changed: no repository is looked at again
    claims, change = refresh_step(spark, folders, [("b", "Makefile", "all:\n\tgo\n", 2)], compact_every=3)
    assert ("b", "make all") in claims and refresh.changes(spark, folders["out"]).filter("batch = 3").isEmpty()


def test_a_refresh_batch_may_run_twice(spark, folders):
    rows = spark.createDataFrame([("a", "Makefile", "test:\n\tpytest\n", 1)], VERSIONS)
    more = spark.createDataFrame([("a", "Makefile", "lint:\n\truff\n", 2), ("b", "Makefile", "all:\n\tgo\n", 1)], VERSIONS)
    from attesta.plans import runs

    for frame, batch in ((rows, 0), (more, 1), (more, 1)):
        refresh.apply_batch(frame, batch, folders["out"], runs.run_extraction_with_evidence, 2)
    found = {(r["repo_id"], r["content"]) for r in refresh.current(spark, folders["out"], "claims").filter("claim_type = 'validated-command'").collect()}
    assert found == {("a", "make lint"), ("b", "make all")}
    log = refresh.changes(spark, folders["out"]).filter("batch = 1").groupBy("change").count().collect()
    assert {r["change"]: r["count"] for r in log} == {"new": 2, "removed": 1}


EVENTS = "ts timestamp, action string"


def test_windows_come_once_and_late_rows_are_dropped(spark, folders):
    at = lambda hour, minute=0: dt.datetime(2024, 1, 1, hour, minute)

    def step(rows):
        put(spark, rows, EVENTS, folders["in"])
        counts = jobs.history_counts(spark.readStream.schema(EVENTS).parquet(folders["in"]))
        writer = counts.writeStream.format("parquet").option("path", folders["out"]).option("checkpointLocation", folders["marks"])
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["hour"].hour, r["decisions"]) for r in spark.read.parquet(folders["out"]).collect())

    assert step([(at(1), "a"), (at(1, 30), "a"), (at(4), "a")]) == [(1, 2)]
    assert step([(at(1, 5), "a"), (at(4, 10), "a"), (at(9), "a")]) == [(1, 2), (4, 2)]


DECISIONS = "repo_id string, claim_id string, action string, ts timestamp, event_id long"


def day(d, hour=0):
    return dt.datetime(2024, 1, d, hour)


def review_step(spark, folders, rows, **given):
    """One more batch of decisions into the same checkpoint; the newest verdict of every decision so far."""
    if rows:
        put(spark, rows, DECISIONS, folders["in"])
    stream = review.review_moves(spark.readStream.schema(DECISIONS).parquet(folders["in"]), **given)

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folders['out']}/batch={batch_id}")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", folders["marks"]).trigger(availableNow=True).start().awaitTermination()
    found = review.newest_verdicts(spark.read.parquet(f"{folders['out']}/batch=*").drop("batch"))
    return {r["event_id"]: (r["from_state"], r["to_state"], r["legal"], r["revision"]) for r in found.collect()} if rows is not None else found


def test_every_illegal_move_is_flagged_over_batches_and_restarts(spark, folders):
    first = review_step(spark, folders, [("r", "c1", "approved", day(1), 1), ("r", "c2", "tombstoned", day(1), 2), ("r", "c3", "declared", day(1), 3)])
    assert first == {1: ("unreviewed", "approved", True, 0), 2: ("unreviewed", "tombstoned", True, 0), 3: ("unreviewed", "approved", False, 0)}
    # each call is a restart from the checkpoint
    second = review_step(spark, folders, [("r", "c1", "edited", day(2), 4), ("r", "c2", "approved", day(2), 5), ("r", "c1", "suppressed", day(3), 6), ("r", "c1", "approved", day(1), 1)])
    assert second == first | {4: ("approved", "edited", False, 0), 5: ("tombstoned", "approved", False, 0), 6: ("edited", "suppressed", False, 0)}
    state = review.review_state(review_step(spark, folders, None)).collect()
    assert sorted((r["claim_id"], r["state"], r["decisions"], r["illegal"]) for r in state) == [("c1", "suppressed", 3, 2), ("c2", "approved", 2, 1), ("c3", "approved", 1, 1)]


def test_a_late_decision_is_put_in_its_place_and_its_successor_judged_again(spark, folders):
    moves = (("unreviewed", "suppressed"), ("suppressed", "approved"), ("approved", "tombstoned"))
    first = review_step(spark, folders, [("r", "c", "approved", day(1, 12), 1), ("r", "c", "tombstoned", day(2, 12), 2)], moves=moves, lateness="3 days")
    assert first == {1: ("unreviewed", "approved", False, 0), 2: ("approved", "tombstoned", True, 0)}
    second = review_step(spark, folders, [("r", "c", "suppressed", day(1, 6), 3)], moves=moves, lateness="3 days")
    assert second == {3: ("unreviewed", "suppressed", True, 0), 1: ("suppressed", "approved", True, 1), 2: ("approved", "tombstoned", True, 0)}


def test_state_folds_behind_the_watermark_and_ends_when_idle(spark, folders):
    def kept():
        rows = spark.read.format("statestore").load(folders["marks"]).selectExpr("key.*", "value.*").collect()
        return {r["claim_id"]: len(r["groupState"]["ids"]) if "groupState" in r else None for r in rows}

    given = {"lateness": "1 hour", "idle": "5 days"}
    review_step(spark, folders, [("r", "old", "approved", day(1), 1), ("r", "busy", "approved", day(1), 2)], **given)
    review_step(spark, folders, [("r", "busy", "edited", day(3), 3)], **given)
    review_step(spark, folders, [("r", "busy", "suppressed", day(4), 4)], **given)
    assert kept()["busy"] <= 2 and "old" in kept()
    review_step(spark, folders, [("r", "other", "approved", day(9), 5)], **given)
    review_step(spark, folders, [("r", "other", "edited", day(9, 2), 6)], **given)
    assert set(kept()) == {"other"}
    # a claim that comes back goes on from what the table knows
    rows = spark.createDataFrame([("r", "old", "edited", day(10), 7, "approved")], DECISIONS + ", known_state string")
    rows.coalesce(1).write.mode("append").parquet(folders["in"] + "2")
    stream = review.review_moves(spark.readStream.schema(rows.schema).parquet(folders["in"] + "2"))
    out = jobs.run_to_end(stream, "review-known", mode="update", keys=[*jobs.CLAIM_KEY, "event_id"]).collect()
    assert [(r["from_state"], r["legal"]) for r in out] == [("approved", False)]


def test_sessions_close_behind_the_watermark(spark, folders):
    schema = "ts timestamp, session_id string, response_size_bytes long, duration_ms double"
    rows = [(dt.datetime(2024, 1, 1, 1, m), "s", 1, 2.0) for m in (0, 10, 40)] + [(dt.datetime(2024, 1, 1, 5), "s", 1, 2.0)]
    put(spark, rows, schema, folders["in"])
    out = jobs.run_to_end(jobs.tool_sessions(spark.readStream.schema(schema).parquet(folders["in"])), "sessions-test")
    assert sorted(r["calls"] for r in out.withColumn("x", F.lit(1)).collect()) == [1, 2]


def test_session_sketches_merge_within_their_error(spark, folders):
    import random

    r = random.Random(3)
    schema = "ts timestamp, session_id string, response_size_bytes long, duration_ms double"
    rows = [(dt.datetime(2024, 1, 1, 1) + dt.timedelta(seconds=i), f"s{i % 7}", 1, r.expovariate(1)) for i in range(30_000)]
    rows += [(dt.datetime(2024, 1, 2), "end", 1, 1.0)]
    put(spark, rows, schema, folders["in"])
    sessions = jobs.run_to_end(jobs.tool_sessions(spark.readStream.schema(schema).parquet(folders["in"])), "sketch-test")
    by_session = {f"s{k}": sorted(d for _, s, _, d in rows if s == f"s{k}") for k in range(7)}
    for row in sessions.collect():
        values = by_session[row["session_id"]]
        assert abs(sum(v <= row["p95_ms"] for v in values) / len(values) - 0.95) < 4 / jobs.SKETCH_K
    (whole,) = jobs.merged_latency(sessions.withColumn("all", F.lit(1)), ["all"]).collect()
    values = sorted(d for _, s, _, d in rows if s != "end")
    assert whole["calls"] == 30_000
    for rank, value in ((0.5, whole["p50_ms"]), (0.95, whole["p95_ms"])):
        assert abs(sum(v <= value for v in values) / len(values) - rank) < 4 / jobs.SKETCH_K


def as_folder(spark, folder, tmp_path, table):
    """The same table as a folder of part files."""
    spark.read.parquet(f"{folder}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    return str(tmp_path)


def test_refresh_reads_a_table_kept_as_a_folder(spark, folder, tmp_path):
    many = as_folder(spark, folder, tmp_path, "documents")
    one, same = (sorted(runner(QUERIES["stream_refresh"])(spark, f).collect()) for f in (folder, many))
    assert same == one and len(one) == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_alerts_read_a_table_kept_as_a_folder(spark, folder, tmp_path):
    many = as_folder(spark, folder, tmp_path, "documents")
    one, same = (sorted(runner(QUERIES["stream_secret_alerts"])(spark, f).collect()) for f in (folder, many))
    assert one and same == one
