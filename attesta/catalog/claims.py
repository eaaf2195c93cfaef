"""Filters, orders, pages, deduplication and maintenance over the claims table."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta import dims
from attesta.catalog.registry import query
from attesta.functions import base
from attesta.operators import filters, maintenance, ordering

KEY = ["repo_id", "claim_id", "ordinal"]
HIDDEN = "('suppressed', 'tombstoned')"
GATE = f"review_state NOT IN {HIDDEN} AND sensitivity = 'public'"


@query("list_claims", "SELECT repo_id, claim_id, ordinal FROM claims_v WHERE claim_type = 'validated-command' AND review_state = 'edited' AND scope = '**'")
def _(t):
    return filters.list_claims(t.claims, scope="**", claim_type="validated-command", review_state="edited").select(*KEY)


@query("list_claims_of_repo", "SELECT repo_id, claim_id, ordinal FROM claims_v WHERE repo_id = 'repo-3' AND claim_type = 'scoped-rule'")
def _(t):
    return filters.list_claims(t.claims, claim_type="scoped-rule", repo_id="repo-3").select(*KEY)


@query("claim_lookup_status", f"""
SELECT w.repo_id, w.claim_id, c.content, CASE WHEN c.claim_id IS NULL THEN 'not-found' WHEN review_state IN {HIDDEN} THEN 'hidden'
  WHEN source_authority IN ('inferred-low') THEN 'not-allowlisted' WHEN sensitivity = 'local-only' THEN 'local-only' ELSE 'ok' END AS status
FROM (SELECT DISTINCT CASE WHEN l_returnflag = 'R' THEN concat(repo_id, '-gone') ELSE repo_id END AS repo_id, claim_id FROM lineitem JOIN claims_v ON l_orderkey = ordinal) AS w
LEFT JOIN unique_claims_v c ON c.repo_id = w.repo_id AND c.claim_id = w.claim_id""")
def _(t):
    wanted = t.lineitem.join(t.claims, F.col("l_orderkey") == F.col("ordinal")).select(
        F.when(F.col("l_returnflag") == "R", F.concat("repo_id", F.lit("-gone"))).otherwise(F.col("repo_id")).alias("repo_id"), "claim_id",
    ).distinct()
    trusted = tuple(s for s in dims.TRUSTED_SOURCES if s != "inferred-low")
    return filters.get_claim(maintenance.dedup_first(t.claims), wanted, trusted)


@query("scope_filter", "SELECT repo_id, claim_id, ordinal FROM claims_v WHERE scope IN ('src/m7', '**')")
def _(t):
    return filters.scope_filter(t.claims, "src/m7").select(*KEY)


@query("scope_prefix_filter", "SELECT repo_id, claim_id, ordinal FROM claims_v WHERE starts_with(scope, 'src/m1')")
def _(t):
    return filters.scope_prefix_filter(t.claims, "src/m1").select(*KEY)


@query("task_filter", "SELECT repo_id, claim_id, ordinal FROM claims_v WHERE list_has_any(applicability, ['all', 'release'])")
def _(t):
    return filters.task_filter(t.claims, "release").select(*KEY)


@query("visible_claims", f"SELECT repo_id, claim_id, ordinal FROM claims_v WHERE review_state NOT IN {HIDDEN}")
def _(t):
    return filters.visible(t.claims).select(*KEY)


@query("sensitivity_verdicts", """
SELECT repo_id, claim_id, ordinal, sensitivity <> 'local-only' AS included,
  CASE WHEN sensitivity = 'local-only' THEN 'sensitivity local-only exceeds target team-only' END AS reason FROM claims_v""")
def _(t):
    return filters.sensitivity_verdict(t.claims, "team-only").select(*KEY, "included", "reason")


@query("source_allowlist", """
WITH flags AS (SELECT repo_id, claim_id, bool_or(regexp_matches(file_path, '^src/m[12].*[.]py$') OR regexp_matches(file_path, '^src/m4./.*$')) AS ok FROM evidence_v GROUP BY ALL)
SELECT c.repo_id, c.claim_id, c.ordinal FROM claims_v c LEFT JOIN flags f ON f.repo_id = c.repo_id AND f.claim_id = c.claim_id
WHERE source_authority NOT IN ('inferred-low', 'checked-in-docs') AND coalesce(ok, true)""")
def _(t):
    trusted = tuple(s for s in dims.TRUSTED_SOURCES if s not in ("inferred-low", "checked-in-docs"))
    return filters.allowlist(t.claims, trusted, ("src/m1*.py", "src/m2*.py", "src/m4?/*"), t.evidence).select(*KEY)


@query("output_gate", f"SELECT repo_id, claim_id, ordinal FROM claims_v WHERE {GATE}")
def _(t):
    return filters.output_gate(t.claims).select(*KEY)


@query("confidence_verdicts", """
SELECT repo_id, claim_id, ordinal, confidence >= 0.5 AS included,
  CASE WHEN confidence < 0.5 THEN concat('confidence ', printf('%.2f', confidence), ' below 0.50') END AS reason FROM claims_v""")
def _(t):
    return filters.confidence_verdict(t.claims, 0.5).select(*KEY, "included", "reason")


@query("approved_claims", "SELECT repo_id, claim_id, ordinal FROM claims_v WHERE review_state IN ('approved', 'edited')")
def _(t):
    return filters.approved_only(t.claims).select(*KEY)


@query("review_queue", """
SELECT repo_id, claim_id, ordinal, review_state, confidence,
  row_number() OVER (PARTITION BY repo_id ORDER BY CASE review_state WHEN 'needs-declaration' THEN 0 ELSE 1 END, confidence DESC, claim_id, ordinal) AS place
FROM claims_v WHERE review_state IN ('unreviewed', 'needs-declaration') AND starts_with(scope, 'src/')""")
def _(t):
    queue = filters.review_queue(t.claims, scope_prefix="src/")
    ranked = ordering.placed(queue, ["repo_id"], [*ordering.review_order(), F.col("ordinal")])
    return ranked.select(*KEY, "review_state", "confidence", F.col("rank").cast("bigint").alias("place"))


@query("batch_approve", """
SELECT repo_id, claim_id, 'approved' AS action, 'human' AS actor FROM unique_claims_v
WHERE confidence >= 0.95 AND review_state = 'unreviewed' AND source_authority IN ('human-override', 'declared-reviewed', 'executable-config', 'ci-observed')""")
def _(t):
    return filters.batch_approve(maintenance.dedup_first(t.claims), F.lit("2001-08-01").cast("timestamp")).drop("ts")


@query("high_authority_flag", "SELECT repo_id, claim_id, ordinal, source_authority IN ('human-override', 'declared-reviewed', 'executable-config', 'ci-observed', 'inferred-high') AS high_authority FROM claims_v")
def _(t):
    return filters.with_high_authority(t.claims).select(*KEY, "high_authority")


@query("enforceable_restrictions", """
SELECT repo_id, claim_id, ordinal, f AS enforceable, CASE WHEN f THEN 'claude|copilot' ELSE '' END AS hosts,
  CASE WHEN f THEN 'settings.json permissions.deny' ELSE 'advisory text only' END AS mechanism
FROM (SELECT *, claim_type = 'permission-restriction' AND confidence >= 0.95 AND (contains(lower(content), 'destructive') OR contains(lower(content), 'require explicit confirmation')) AS f FROM claims_v) AS x""")
def _(t):
    return filters.with_enforcement(t.claims).select(*KEY, "enforceable", F.array_join("enforceable_on", "|").alias("hosts"), "mechanism")


@query("render_terse", "SELECT repo_id, claim_id, substr(content, 1, 100) AS content_preview, claim_type, confidence FROM claims_v")
def _(t):
    return filters.render_claims(t.claims, "terse")


@query("render_detailed", """
SELECT repo_id, claim_id, content, claim_type, source_authority, confidence, scope, array_to_string(applicability, '|') AS applicability, review_state, risk_class, stale, last_validated,
  CASE WHEN stale THEN round(confidence * 0.8, 6) END AS effective_confidence FROM claims_v""")
def _(t):
    return filters.render_claims(t.claims, "detailed").withColumn("applicability", F.array_join("applicability", "|")).withColumn("effective_confidence", F.round("effective_confidence", 6))


@query("effective_confidence", "SELECT repo_id, claim_id, ordinal, round(CASE WHEN stale THEN confidence * 0.8 ELSE confidence END, 6) AS effective FROM claims_v")
def _(t):
    return t.claims.select(*KEY, F.round(base.effective_confidence(F.col("confidence"), F.col("stale")), 6).alias("effective"))


@query("valid_claim_ids", """
SELECT event_id, raw_id, regexp_matches(raw_id, '^[a-zA-Z0-9][a-zA-Z0-9_-]*$') AND NOT contains(raw_id, '..') AS valid
FROM (SELECT event_id, CASE action WHEN 'edited' THEN concat('../', claim_id) WHEN 'suppressed' THEN concat(claim_id, '/x') ELSE claim_id END AS raw_id FROM history_v) AS h""")
def _(t):
    raw = F.when(F.col("action") == "edited", F.concat(F.lit("../"), "claim_id")).when(F.col("action") == "suppressed", F.concat("claim_id", F.lit("/x"))).otherwise(F.col("claim_id"))
    return filters.split_valid_ids(t.history.select("event_id", raw.alias("raw_id")), "raw_id")


@query("claim_ids", "SELECT ordinal, claim_id, concat('claim-', substr(sha256(concat_ws(':', claim_type, scope, content)), 1, 16)) AS rebuilt FROM claims_v")
def _(t):
    return t.claims.select("ordinal", "claim_id", base.claim_id(F.col("claim_type"), F.col("scope"), F.col("content")).alias("rebuilt"))


@query("authority_levels", "SELECT ordinal, authority_level AS level FROM claims_v")
def _(t):
    return t.claims.select("ordinal", base.authority_level(F.col("source_authority")).alias("level"))


@query("days_since_validation", "SELECT ordinal, CAST(floor((epoch(TIMESTAMP '2001-08-01 06:00:00') - epoch(coalesce(last_validated, created_at))) / 86400) AS BIGINT) AS days FROM claims_v")
def _(t):
    now = F.lit("2001-08-01 06:00:00").cast("timestamp")
    return t.claims.select("ordinal", base.days_between(now, F.coalesce("last_validated", "created_at")).alias("days"))


# ---- deduplication, precedence, pages --------------------------------------------------


@query("dedup_first", "SELECT repo_id, claim_id, ordinal, phase FROM unique_claims_v")
def _(t):
    return maintenance.dedup_first(t.claims).select(*KEY, "phase")


@query("resolve_by_precedence", """
SELECT repo_id, claim_type, scope, claim_id, confidence FROM unique_claims_v
QUALIFY row_number() OVER (PARTITION BY repo_id, claim_type, scope ORDER BY authority_level, confidence DESC, claim_id) = 1""")
def _(t):
    best = maintenance.resolve_by_precedence(maintenance.dedup_first(t.claims))
    return best.select("repo_id", "claim_type", "scope", "claim_id", "confidence")


@query("dedup_against_existing", """
WITH fresh AS (SELECT * FROM claims_v WHERE branch = 'main'), known AS (SELECT DISTINCT repo_id, claim_id FROM claims_v WHERE branch = 'dev')
SELECT f.repo_id, f.claim_id, f.ordinal, k.claim_id IS NOT NULL OR row_number() OVER (PARTITION BY f.repo_id, f.claim_id ORDER BY phase, ordinal) > 1 AS duplicate
FROM fresh f LEFT JOIN known k ON f.repo_id = k.repo_id AND f.claim_id = k.claim_id""")
def _(t):
    fresh, known = t.claims.filter("branch = 'main'"), t.claims.filter("branch = 'dev'")
    return maintenance.split_duplicates(fresh, known).select(*KEY, "duplicate")


@query("stable_order", """
SELECT repo_id, claim_id, row_number() OVER (PARTITION BY repo_id ORDER BY authority_level, scope, claim_type, claim_id) AS place FROM unique_claims_v""")
def _(t):
    ranked = ordering.placed(maintenance.dedup_first(t.claims), ["repo_id"], [F.col(c).asc() for c in ordering.STABLE])
    return ranked.select("repo_id", "claim_id", F.col("rank").cast("bigint").alias("place"))


@query("prioritize", """
SELECT repo_id, claim_id, row_number() OVER (PARTITION BY repo_id ORDER BY authority_level, confidence DESC, claim_id) AS place FROM unique_claims_v""")
def _(t):
    ranked = ordering.placed(maintenance.dedup_first(t.claims), ["repo_id"], ordering.priority())
    return ranked.select("repo_id", "claim_id", F.col("rank").cast("bigint").alias("place"))


PAGE = "SELECT {cols}, row_number() OVER (ORDER BY {keys}) AS position, (SELECT count(*) FROM unique_claims_v) AS total, (SELECT count(*) FROM unique_claims_v WHERE {after}) > 50 AS has_more FROM unique_claims_v WHERE {after} ORDER BY {keys} LIMIT 50"


@query("page_by_id", PAGE.format(cols="repo_id, claim_id", keys="claim_id, repo_id", after="(claim_id, repo_id) > ('claim-8', '')"))
def _(t):
    out = ordering.page(maintenance.dedup_first(t.claims), 50, ("claim-8", ""))
    return out.select("repo_id", "claim_id", F.col("position").cast("bigint").alias("position"), "total", "has_more")


@query("page_by_precedence", PAGE.format(cols="repo_id, claim_id, authority_level", keys="authority_level, claim_id, repo_id", after="(authority_level, claim_id, repo_id) > (30, 'claim-f', '')"))
def _(t):
    out = ordering.page_by_precedence(maintenance.dedup_first(t.claims), 50, (30, "claim-f", ""))
    return out.select("repo_id", "claim_id", "authority_level", F.col("position").cast("bigint").alias("position"), "total", "has_more")


@query("recent_history", "SELECT event_id, repo_id, claim_id, action, ts FROM history_v WHERE action = 'edited' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 100")
def _(t):
    since = F.lit("2024-01-10").cast("timestamp")
    return ordering.recent_history(t.history, 100, action="edited", since=since).select("event_id", "repo_id", "claim_id", "action", "ts")


@query("top_evidence_per_repo", """
SELECT repo_id, file_path, uses, row_number() OVER (PARTITION BY repo_id ORDER BY uses DESC, file_path) AS place
FROM (SELECT repo_id, file_path, count(*) AS uses FROM evidence_v GROUP BY ALL) AS e QUALIFY place <= 10""")
def _(t):
    uses = t.evidence.groupBy("repo_id", "file_path").agg(F.count(F.lit(1)).alias("uses"))
    ranked = ordering.top_k(uses, ["repo_id"], [F.col("uses").desc(), F.col("file_path")], 10)
    return ranked.select("repo_id", "file_path", "uses", F.col("rank").cast("bigint").alias("place"))


# ---- set operations and table maintenance ----------------------------------------------


@query("assemble_claims", """
SELECT phase, repo_id, claim_id FROM (
  SELECT 0 AS phase, repo_id, claim_id FROM claims_v WHERE claim_type = 'validated-command' UNION ALL
  SELECT 1, repo_id, claim_id FROM claims_v WHERE claim_type = 'environment-prerequisite' UNION ALL
  SELECT 2, repo_id, claim_id FROM claims_v WHERE claim_type IN ('always-on-rule', 'scoped-rule') UNION ALL
  SELECT 3, repo_id, claim_id FROM claims_v WHERE claim_type NOT IN ('validated-command', 'environment-prerequisite', 'always-on-rule', 'scoped-rule')) AS u""")
def _(t):
    c = t.claims.select("repo_id", "claim_id", "claim_type")
    kinds = (("validated-command",), ("environment-prerequisite",), ("always-on-rule", "scoped-rule"))
    parts = [c.filter(F.col("claim_type").isin(*k)) for k in kinds] + [c.filter(~F.col("claim_type").isin(*[x for k in kinds for x in k]))]
    return maintenance.assemble_claims(parts).select("phase", "repo_id", "claim_id")


BEFORE_AFTER = """
WITH b AS (SELECT repo_id, claim_id, min(content) AS content FROM claims_v WHERE branch = 'main' GROUP BY ALL),
a AS (SELECT repo_id, claim_id, max(CASE WHEN stale THEN concat(content, ' *') ELSE content END) AS content FROM claims_v WHERE created_at >= TIMESTAMP '1996-01-01' GROUP BY ALL)"""


def _before_after(t):
    before = t.claims.filter("branch = 'main'").groupBy("repo_id", "claim_id").agg(F.min("content").alias("content"))
    changed = F.when(F.col("stale"), F.concat("content", F.lit(" *"))).otherwise(F.col("content"))
    after = t.claims.filter(F.col("created_at") >= F.lit("1996-01-01").cast("timestamp")).groupBy("repo_id", "claim_id").agg(F.max(changed).alias("content"))
    return before, after


@query("id_diff", BEFORE_AFTER + """
SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.claim_id, b.claim_id) AS claim_id,
  CASE WHEN b.claim_id IS NULL THEN 'new' WHEN a.claim_id IS NULL THEN 'removed' ELSE 'common' END AS change
FROM a FULL JOIN b ON a.repo_id = b.repo_id AND a.claim_id = b.claim_id""")
def _(t):
    return maintenance.id_diff(*_before_after(t))


@query("refresh_diff", BEFORE_AFTER + """, s AS (SELECT DISTINCT repo_id, claim_id FROM claims_v WHERE confidence < 0.3)
SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.claim_id, b.claim_id) AS claim_id,
  CASE WHEN b.claim_id IS NULL THEN 'new' WHEN a.claim_id IS NULL THEN 'removed' WHEN a.content <> b.content THEN 'updated'
    WHEN s.claim_id IS NOT NULL THEN 'stale' ELSE 'stable' END AS change
FROM a FULL JOIN b ON a.repo_id = b.repo_id AND a.claim_id = b.claim_id
LEFT JOIN s ON s.repo_id = coalesce(a.repo_id, b.repo_id) AND s.claim_id = coalesce(a.claim_id, b.claim_id)""")
def _(t):
    before, after = _before_after(t)
    return maintenance.refresh_diff(before, after, t.claims.filter("confidence < 0.3"))


RANKED = "list_position(['discovered', 'prerequisites-extracted', 'ci-evidenced', 'environment-profiled', 'sandbox-verified'], {})"


@query("merge_claims", f"""
WITH pick AS (SELECT *, row_number() OVER (PARTITION BY repo_id, claim_id, branch ORDER BY ordinal) AS rn FROM claims_v),
o AS (SELECT * FROM pick WHERE branch = 'main' AND rn = 1), n AS (SELECT * FROM pick WHERE branch = 'dev' AND rn = 1)
SELECT coalesce(o.repo_id, n.repo_id) AS repo_id, coalesce(o.claim_id, n.claim_id) AS claim_id, coalesce(n.content, o.content) AS content,
  coalesce(n.source_authority, o.source_authority) AS source_authority, greatest(n.confidence, o.confidence) AS confidence,
  CASE WHEN coalesce({RANKED.format('n.evidence_level')}, 0) >= coalesce({RANKED.format('o.evidence_level')}, 0) THEN n.evidence_level ELSE o.evidence_level END AS evidence_level,
  CASE WHEN n.content IS NOT NULL THEN false ELSE o.stale END AS stale
FROM o FULL JOIN n ON o.repo_id = n.repo_id AND o.claim_id = n.claim_id""")
def _(t):
    order = [F.col("ordinal")]
    key = ["repo_id", "claim_id"]
    old = maintenance.first_by(t.claims.filter("branch = 'main'"), key, order)
    return maintenance.merge_claims(old, maintenance.first_by(t.claims.filter("branch = 'dev'"), key, order))


@query("purge_tombstoned", """
WITH gone AS (SELECT DISTINCT repo_id, claim_id FROM unique_claims_v WHERE review_state = 'tombstoned'),
e AS (SELECT 'evidence' AS tbl, repo_id, claim_id FROM evidence_v UNION ALL SELECT 'history', repo_id, claim_id FROM history_v UNION ALL SELECT 'claims', repo_id, claim_id FROM unique_claims_v)
SELECT tbl, e.repo_id, count(*) AS rows_kept FROM e ANTI JOIN gone g ON g.repo_id = e.repo_id AND g.claim_id = e.claim_id GROUP BY ALL""")
def _(t):
    kept, _log = maintenance.purge_tombstoned(maintenance.dedup_first(t.claims), {"evidence": t.evidence, "history": t.history})
    parts = [df.groupBy("repo_id").agg(F.count(F.lit(1)).alias("rows_kept")).select(F.lit(name).alias("tbl"), "repo_id", "rows_kept") for name, df in kept.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("purge_log", "SELECT DISTINCT 'purge' AS event_type, repo_id, claim_id FROM unique_claims_v WHERE review_state = 'tombstoned'")
def _(t):
    return maintenance.purge_tombstoned(maintenance.dedup_first(t.claims), {})[1].drop("session_id")


@query("distinct_tools", "SELECT DISTINCT repo_id, split_part(content, ' ', 1) AS tool FROM claims_v WHERE claim_type = 'validated-command'")
def _(t):
    tool = F.split_part("content", F.lit(" "), F.lit(1)).alias("tool")
    return t.claims.filter("claim_type = 'validated-command'").select("repo_id", tool).distinct()


@query("upsert_index_metadata", """
SELECT repo_id, arg_max(branch, created_at + to_microseconds(ordinal)) AS branch, max(created_at + to_microseconds(ordinal)) AS last_indexed FROM claims_v GROUP BY repo_id""")
def _(t):
    stamp = F.timestamp_micros(F.unix_micros(F.col("created_at").cast("timestamp")) + F.col("ordinal"))
    rows = t.claims.select("repo_id", "branch", stamp.alias("last_indexed"))
    return maintenance.upsert(rows.filter("branch = 'main'"), rows.filter("branch = 'dev'"), ["repo_id"], "last_indexed")


@query("upsert_artifacts", """
SELECT repo_id, path, target_host, expected_hash FROM artifacts_v WHERE target_host <> 'windsurf'
UNION ALL SELECT repo_id, path, target_host, sha256(concat(expected_hash, ':2')) FROM artifacts_v WHERE target_host = 'windsurf'""")
def _(t):
    current = t.artifacts.select("repo_id", "path", "target_host", "expected_hash", F.lit(1).alias("version"))
    update = current.filter("target_host = 'windsurf'").withColumn("version", F.lit(2)).withColumn("expected_hash", F.sha2(F.concat("expected_hash", F.lit(":2")), 256))
    return maintenance.upsert(current, update, ["repo_id", "path"], "version").drop("version")


@query("delete_artifacts", "SELECT repo_id, path, target_host FROM artifacts_v WHERE ownership_mode <> 'imported-human-owned'")
def _(t):
    gone = t.artifacts.filter("ownership_mode = 'imported-human-owned'")
    return maintenance.delete_keys(t.artifacts, gone, ["repo_id", "path"]).select("repo_id", "path", "target_host")
