"""Sources, sinks, whole pipelines and streams."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from attesta import dims
from attesta.catalog.registry import query
from attesta.catalog.text import CONFIG_TEXT, _config_texts, _secret_rows
from attesta.operators import extract_docs, graph
from attesta.plans import runs
from attesta.session import shared_folder
from attesta.sources import files, tables
from attesta.streaming import jobs, refresh, review

TOOL = "CASE event_type WHEN 'view' THEN 'get_conventions' WHEN 'click' THEN 'get_claim' WHEN 'signup' THEN 'get_prerequisites' WHEN 'error' THEN 'get_conflicts' ELSE 'get_validated_commands' END"
ACTION = "CASE event_type WHEN 'view' THEN 'approved' WHEN 'click' THEN 'edited' WHEN 'signup' THEN 'suppressed' WHEN 'error' THEN 'tombstoned' ELSE 'declared' END"


def _events(t):
    """The event log as a stream of calls and decisions."""
    raw = jobs.source(t.spark, t.folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return raw.selectExpr(
        "event_id", "ts", f"{TOOL} AS tool_name", f"{ACTION} AS action", "concat('session-', user_id) AS session_id", "value AS duration_ms",
        "length(props) * 10 + event_id % 1000 AS response_size_bytes", "concat('repo-', user_id % 20) AS repo_id", "concat('claim-', user_id) AS claim_id")


# ---- sources and sinks -----------------------------------------------------------------


@query("claims_table_round_trip", "SELECT repo_id, claim_id, content, confidence FROM unique_claims_v")
def _(t):
    from attesta.operators.maintenance import dedup_first

    path = shared_folder(t.spark, "claims")
    tables.write_claims(dedup_first(t.claims), path)
    one, others = tables.read_table(t.spark, path, "repo-7"), tables.read_table(t.spark, path).filter("repo_id <> 'repo-7'")
    return one.unionByName(others).select("repo_id", "claim_id", "content", "confidence")


@query("duplicate_claim_ids", "SELECT repo_id, claim_id, count(*) AS copies FROM claims_v GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return tables.duplicate_ids(t.claims)


@query("unique_evidence", """
SELECT repo_id, claim_id, file_path, extraction_version, file_hash, line_start, line_end, evidence_level FROM evidence_v
QUALIFY row_number() OVER (PARTITION BY repo_id, claim_id, file_path, extraction_version ORDER BY line_start, line_end, file_hash, evidence_level) = 1""")
def _(t):
    return tables.unique_evidence(t.evidence)


@query("evidence_round_trip", """
SELECT repo_id, claim_id, file_path, file_hash, line_start, line_end FROM evidence_v
QUALIFY row_number() OVER (PARTITION BY repo_id, claim_id, file_path, extraction_version ORDER BY line_start, line_end, file_hash, evidence_level) = 1""")
def _(t):
    path = shared_folder(t.spark, "evidence")
    tables.write_evidence(t.evidence, path)
    one, others = tables.read_evidence(t.spark, path, "repo-3"), tables.read_evidence(t.spark, path).filter("repo_id <> 'repo-3'")
    return one.unionByName(others).select("repo_id", "claim_id", "file_path", "file_hash", "line_start", "line_end")


@query("artifacts_round_trip", "SELECT repo_id, path, sha256(text) AS text_hash FROM disk_v")
def _(t):
    path = shared_folder(t.spark, "artifacts")
    host = F.regexp_extract("path", r"^\.(\w+)/", 1)
    tables.write_artifacts(t.disk.withColumn("host", host), path)
    return t.spark.read.parquet(path).select("repo_id", "path", F.sha2("text", 256).alias("text_hash"))


@query("report_round_trip", "SELECT tool_name, count(*) AS calls, count(*) FILTER (response_status = 'error') AS errors, count(DISTINCT session_id) AS sessions FROM traces_v GROUP BY tool_name")
def _(t):
    from attesta.plans import quality

    path = shared_folder(t.spark, "report")
    tables.write_report(quality.trace_stats(t.traces), path)
    return t.spark.read.json(path).select("tool_name", "calls", "errors", "sessions")


@query("append_history", "SELECT repo_id, claim_id, action, ts, actor, sha256(concat_ws(':', repo_id, claim_id, action, ts::VARCHAR, actor)) AS event_key FROM history_v")
def _(t):
    path = shared_folder(t.spark, "history")
    rows = t.history.select("repo_id", "claim_id", "action", "ts", "actor")
    tables.append_history(rows.filter("action = 'edited'"), path)
    tables.append_history(rows.filter("action <> 'edited'"), path)
    return t.spark.read.parquet(path).select("repo_id", "claim_id", "action", "ts", "actor", "event_key")


@query("decision_files", f"SELECT event_id, {ACTION} AS action, concat('claim-', user_id) AS claim_id, event_type <> 'purchase' AS valid FROM events")
def _(t):
    path = shared_folder(t.spark, "decisions")
    action = F.expr(f"CASE WHEN event_type = 'purchase' THEN 'unheard' ELSE {ACTION} END")
    doc = t.events.select(F.concat("event_id", F.lit("")).alias("actor"), action.alias("action"), F.concat(F.lit("claim-"), "user_id").alias("claim_id"))
    doc.write.json(path)
    read = tables.read_decisions(t.spark, path)
    return read.select(F.col("actor").cast("bigint").alias("event_id"), F.when(F.col("action") == "unheard", "declared").otherwise(F.col("action")).alias("action"), "claim_id", "valid")


@query("trace_files", f"SELECT {TOOL} AS tool_name, value AS duration_ms, concat('session-', user_id) AS session_id, props AS argument FROM events")
def _(t):
    path = shared_folder(t.spark, "traces")
    t.traces.select("tool_name", "duration_ms", "session_id", F.create_map(F.lit("q"), "props").alias("arguments")).write.json(path)
    return tables.read_traces(t.spark, path).select("tool_name", "duration_ms", "session_id", F.try_element_at("arguments", F.lit("q")).alias("argument"))


@query("expected_claim_files", "SELECT brand AS repo_id, CAST(row_number() OVER (PARTITION BY brand ORDER BY kind) - 1 AS INT) AS no, 'validated-command' AS claim_type, concat('make ', kind) AS pattern, true AS required FROM (SELECT DISTINCT replace(p_brand, '#', '') AS brand, p_type AS kind FROM part) AS x")
def _(t):
    path = shared_folder(t.spark, "expected")
    kinds = t.part.select(F.replace("p_brand", F.lit("#"), F.lit("")).alias("brand"), "p_type").distinct()
    # six part types exist: one small document per brand
    docs = kinds.groupBy("brand").agg(F.array_sort(F.collect_list("p_type")).alias("types")).select(
        "brand", F.transform("types", lambda k: F.struct(F.lit("validated-command").alias("claim_type"), F.concat(F.lit("make "), k).alias("content_pattern"))).alias("claims"))
    docs.write.partitionBy("brand").json(path)
    read = tables.read_expected(t.spark, path)
    return read.select(F.replace("repo_id", F.lit("brand="), F.lit("")).alias("repo_id"), "no", "claim_type", "pattern", "required")


@query("replace_repo_edges", """
SELECT repo_id, source, target FROM (SELECT concat('repo-', l_suppkey % 20) AS repo_id, concat('m', l_partkey % 50) AS source, concat('m', l_suppkey % 50) AS target, l_linestatus FROM lineitem) AS e
WHERE l_linestatus = 'O' OR repo_id NOT IN (SELECT concat('repo-', l_suppkey % 20) FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 49) GROUP BY ALL""")
def _(t):
    edge = t.lineitem.selectExpr("concat('repo-', l_suppkey % 20) AS repo_id", "concat('m', l_partkey % 50) AS source", "concat('m', l_suppkey % 50) AS target", "l_linestatus", "l_quantity")
    fresh = edge.filter("l_linestatus = 'O'")
    touched = fresh.filter("l_quantity > 49").select("repo_id").distinct()
    kept = tables.replace_repo_edges(edge.drop("l_linestatus", "l_quantity").distinct(), fresh.join(touched, "repo_id", "left_semi").drop("l_linestatus", "l_quantity").distinct())
    return kept.unionByName(fresh.drop("l_linestatus", "l_quantity").distinct()).distinct()


@query("scan_files", """
SELECT concat('brand-', replace(lower(p_brand), '#', '')) AS repo_id, CAST(sum(length(concat(p_name, chr(10)))) AS BIGINT) AS bytes, count(*) AS lines FROM part GROUP BY ALL""")
def _(t):
    root = shared_folder(t.spark, "checkout")
    rows = t.part.select(F.concat(F.lit("brand-"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit(""))).alias("r"), "p_name")
    rows.write.partitionBy("r").text(root)
    found = files.scan_files(t.spark, root, "*.txt").filter("error IS NULL")
    return found.groupBy(F.replace("repo_id", F.lit("r="), F.lit("")).alias("repo_id")).agg(
        F.sum(F.length("content")).cast("bigint").alias("bytes"), F.sum(F.size(F.split("content", "\n")) - 1).cast("bigint").alias("lines"))


# ---- pipelines -------------------------------------------------------------------------


def _corpus(t):
    parts = (t.package_json, t.pyproject, t.makefile, t.dockerfile, t.compose, t.version_file, t.workflow)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("size", F.length("content").cast("bigint"))


@query("run_extraction")
def _(t):
    return runs.run_extraction(_corpus(t)).withColumn("applicability", F.array_join("applicability", "|"))


@query("run_extraction_code")
def _(t):
    corpus = t.python_code.drop("p_partkey").unionByName(t.init_files.withColumn("content", F.lit(""))).unionByName(t.js_code.drop("p_partkey"))
    return runs.run_extraction(corpus.withColumn("size", F.length("content").cast("bigint"))).withColumn("applicability", F.array_join("applicability", "|"))


@query("run_evidence", """
SELECT repo_id, path, count(*) AS claims FROM (
  SELECT DISTINCT concat('repo-c', c_custkey) AS repo_id, 'Makefile' AS path, t FROM customer, LATERAL (VALUES ('test'), (concat('lint-', lower(c_mktsegment))), ('release_all'), (concat('docs', c_nationkey))) AS u(t)) AS m GROUP BY ALL""")
def _(t):
    evidence = runs.run_evidence(_corpus(t)).filter("file_path = 'Makefile'")
    return evidence.groupBy("repo_id", F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("claims"))


@query("run_import")
def _(t):
    corpus = t.markdown.withColumn("repo_id", F.concat_ws("#", "repo_id", "doc_id")).select("repo_id", "path", "content")
    return runs.run_import(corpus).withColumn("applicability", F.array_join("applicability", "|"))


@query("imported_artifacts", """
SELECT DISTINCT concat(repo_id, '#', doc_id) AS repo_id, path, CASE WHEN regexp_matches(path, 'AGENTS[.]md$') THEN 'codex' WHEN path = 'CLAUDE.md' THEN 'claude' ELSE 'cursor' END AS target_host, 'imported-human-owned' AS ownership_mode
FROM markdown_v WHERE regexp_matches(path, '(AGENTS|CLAUDE)[.]md$|^[.]cursor/rules/')""")
def _(t):
    corpus = t.markdown.withColumn("repo_id", F.concat_ws("#", "repo_id", "doc_id")).select("repo_id", "path", "content")
    return runs.imported_artifacts(corpus).select("repo_id", "path", "target_host", "ownership_mode")


@query("conflict_claims")
def _(t):
    from attesta.operators.maintenance import dedup_first

    return runs.conflict_claims(dedup_first(t.claims))


@query("dependency_reach", """
WITH e AS (SELECT DISTINCT concat('repo-', l_suppkey % 20) AS repo_id, l_partkey % 50 AS source, l_suppkey % 50 AS target FROM lineitem),
p AS (SELECT repo_id, source, target, 1 AS distance FROM e WHERE source <> target UNION ALL SELECT a.repo_id, a.source, b.target, 2 FROM e a JOIN e b ON a.repo_id = b.repo_id AND a.target = b.source WHERE a.source <> a.target AND a.source <> b.target),
m AS (SELECT repo_id, source, target, min(distance) AS distance FROM p GROUP BY ALL)
SELECT repo_id, distance, count(*) AS pairs FROM m GROUP BY ALL""")
def _(t):
    edges = t.lineitem.selectExpr("concat('repo-', l_suppkey % 20) AS repo_id", "l_partkey % 50 AS source", "l_suppkey % 50 AS target", "'imports' AS edge_type")
    return graph.dependency_closure(edges, depth=2).groupBy("repo_id", "distance").agg(F.count(F.lit(1)).alias("pairs"))


REACHED = """
WITH RECURSIVE e AS (SELECT DISTINCT concat('repo-', l_suppkey % 20) AS repo_id, concat('m', l_partkey % 400) AS a, concat('m', (l_partkey * 7 + l_suppkey) % 400) AS b FROM lineitem WHERE l_quantity < 6),
s AS (SELECT DISTINCT repo_id, a AS module FROM e WHERE a IN ('m3', 'm140', 'm399')),
r AS (SELECT repo_id, module AS start, module, 0 AS distance FROM s UNION SELECT r.repo_id, r.start, e.{to}, r.distance + 1 FROM r JOIN e ON e.repo_id = r.repo_id AND e.{at} = r.module WHERE r.distance < {depth})
SELECT repo_id, start, module, min(distance)::INTEGER AS distance FROM r GROUP BY ALL HAVING min(distance) > 0"""


def _module_edges(t):
    edges = t.lineitem.filter("l_quantity < 6").selectExpr(
        "concat('repo-', l_suppkey % 20) AS repo_id", "concat('m', l_partkey % 400) AS source", "concat('m', (l_partkey * 7 + l_suppkey) % 400) AS target", "'imports' AS edge_type")
    return edges, edges.filter("source IN ('m3', 'm140', 'm399')").select("repo_id", F.col("source").alias("module"))


@query("reachable_modules", REACHED.format(at="a", to="b", depth=6))
def _(t):
    return graph.reachable(*_module_edges(t), depth=6)


@query("dependent_modules", REACHED.format(at="b", to="a", depth=4))
def _(t):
    return graph.reachable(*_module_edges(t), depth=4, reverse=True)


# ---- streams ---------------------------------------------------------------------------


#: where the watermark stands at the end: an hour before the last event
PASSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("stream_history_counts", f"SELECT * FROM (SELECT date_trunc('hour', ts) AS hour, {ACTION} AS action, count(*) AS decisions FROM events GROUP BY ALL) AS h WHERE hour + INTERVAL 1 HOUR <= {PASSED}")
def _(t):
    return jobs.run_to_end(jobs.history_counts(_events(t)), "history-counts")


@query("stream_sliding_latency", f"""
SELECT started, tool_name, count(*) AS calls, round(CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) / count(*), 6) AS mean_ms, max(value) AS max_ms FROM (SELECT {TOOL} AS tool_name, value, unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS started FROM events) AS e GROUP BY ALL HAVING started + INTERVAL 10 MINUTE <= {PASSED}""")
def _(t):
    return jobs.run_to_end(jobs.sliding_latency(_events(t)), "latency")


@query("stream_tool_sessions", f"""
WITH g AS (SELECT *, concat('session-', user_id) AS session_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g)
SELECT session_id, min(ts) AS started, max(ts) + INTERVAL 15 MINUTE AS ended, count(*) AS calls, CAST(sum(length(props) * 10 + event_id % 1000) AS BIGINT) AS bytes, max(value) AS slowest_ms, quantile_disc(value, 0.95) AS p95_ms FROM s GROUP BY session_id, no HAVING max(ts) + INTERVAL 15 MINUTE <= {PASSED}""")
def _(t):
    return jobs.run_to_end(jobs.tool_sessions(_events(t)), "sessions").drop("latencies")


@query("session_latency", f"""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g),
e AS (SELECT user_id, no, min(ts) AS started FROM s GROUP BY user_id, no HAVING max(ts) + INTERVAL 15 MINUTE <= {PASSED})
SELECT date_trunc('day', e.started) AS day, s.user_id % 100 AS slice, count(*) AS calls, quantile_disc(s.value, 0.5) AS p50_ms, quantile_disc(s.value, 0.95) AS p95_ms FROM s JOIN e USING (user_id, no) GROUP BY ALL""")
def _(t):
    sessions = jobs.run_to_end(jobs.tool_sessions(_events(t), k=4000), "sessions")
    user = F.split_part("session_id", F.lit("-"), F.lit(2)).cast("bigint")
    return jobs.merged_latency(sessions.withColumn("day", F.date_trunc("day", "started")).withColumn("slice", user % 100), ["day", "slice"])


MOVES = ", ".join(f"('{a}', '{b}')" for a, b in dims.REVIEW_MOVES)
JUDGED = f"""
d AS (SELECT event_id, ts, concat('repo-', user_id % 20) AS repo_id, concat('claim-', user_id) AS claim_id, {ACTION} AS action FROM events),
a AS (SELECT *, CASE action WHEN 'declared' THEN 'approved' ELSE action END AS to_state FROM d),
f AS (SELECT *, coalesce(lag(to_state) OVER (PARTITION BY repo_id, claim_id ORDER BY ts, event_id), 'unreviewed') AS from_state FROM a),
v AS (SELECT *, (from_state, action) IN ({MOVES}) AS legal FROM f)"""


def _verdicts(t):
    return jobs.run_to_end(review.review_moves(_events(t)), "review-moves", mode="update", keys=[*jobs.CLAIM_KEY, "event_id"])


@query("stream_review_moves", f"WITH {JUDGED} SELECT repo_id, claim_id, event_id, ts, action, from_state, to_state, legal FROM v")
def _(t):
    return _verdicts(t).drop("revision")


@query("stream_review_state", f"""
WITH {JUDGED} SELECT repo_id, claim_id, arg_max(to_state, (ts, event_id)) AS state, count(*) AS decisions, count(*) FILTER (NOT legal) AS illegal FROM v GROUP BY ALL""")
def _(t):
    return review.review_state(_verdicts(t))


@query("stream_dedup_claims", "SELECT DISTINCT concat('repo-', user_id % 20) AS repo_id, concat('claim-', user_id) AS claim_id FROM events")
def _(t):
    return jobs.run_to_end(jobs.dedup_claims(_events(t), "40 days"), "dedup").select("repo_id", "claim_id")


@query("stream_secret_alerts", f"WITH {_secret_rows(src=CONFIG_TEXT, key='doc_id')} SELECT doc_id, label AS pattern_type, line, sha256(val) AS value_hash FROM g3")
def _(t):
    texts = _config_texts(SimpleNamespace(documents=jobs.source(t.spark, t.folder, "documents")))
    return jobs.run_to_end(jobs.secret_alerts(texts, "doc_id"), "alerts").select("doc_id", "pattern_type", "line", "value_hash")


@query("stream_refresh", """
SELECT concat(source, '#', doc_id) AS repo_id, 'README.md' AS path, concat('make m', n_chars % 9) AS command, 'Commands' AS heading, 'safe-mutating' AS risk_class, 0.9::DOUBLE AS confidence FROM documents""")
def _(t):
    docs = jobs.source(t.spark, t.folder, "documents")
    wrapped = docs.select(
        F.concat_ws("#", "source", "doc_id").alias("repo_id"), F.lit("README.md").alias("path"),
        F.concat(F.lit("## Commands\n```bash\nmake m"), F.col("n_chars") % 9, F.lit("\n```\n"), "text").alias("content"))
    target, marks = shared_folder(t.spark, "refresh"), shared_folder(t.spark, "refresh-marks")
    jobs.refresh(wrapped, target, extract_docs.docs_commands, marks).awaitTermination()
    return jobs.current_claims(t.spark, target).select("repo_id", "path", "command", "heading", "risk_class", F.round("confidence", 6).alias("confidence"))


@query("stream_refresh_runs", """
SELECT DISTINCT concat('repo-c', c_custkey) AS repo_id, concat('make ', t) AS content, 'validated-command' AS claim_type, CAST(1 AS BIGINT) AS support, 'new' AS change
FROM customer, LATERAL (VALUES ('test'), (concat('lint-', lower(c_mktsegment))), ('release_all'), (concat('docs', c_nationkey))) AS u(t)""")
def _(t):
    arrived, target, marks = (shared_folder(t.spark, n) for n in ("arrived", "refresh-runs", "refresh-runs-marks"))
    old = t.makefile.select("repo_id", "path", F.lit("old:\n\tx\n").alias("content"), F.lit(1).cast("bigint").alias("version"))
    gone = t.makefile.select("repo_id", F.lit("Dockerfile").alias("path"), F.lit("FROM python:3.11\n").alias("content"), F.lit(1).cast("bigint").alias("version"))
    late = gone.withColumn("content", F.lit(None).cast("string")).withColumn("version", F.lit(2).cast("bigint"))
    rows = t.makefile.withColumn("version", F.lit(2).cast("bigint")).unionByName(old).unionByName(gone).unionByName(late)
    rows.write.parquet(arrived)
    refresh.refresh(t.spark.readStream.schema(rows.schema).parquet(arrived), target, marks).awaitTermination()
    claims = refresh.current(t.spark, target, "claims").filter("claim_type NOT IN ('permission-restriction', 'conflict')")
    change = refresh.changes(t.spark, target).select("repo_id", "claim_id", "change")
    return claims.join(change, ["repo_id", "claim_id"]).select("repo_id", "content", "claim_type", "support", "change")
