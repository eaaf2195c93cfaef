"""Decisions, freshness, drift, conflicts and the read reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.catalog.claims import GATE
from attesta.catalog.registry import query
from attesta.functions.base import content_hash
from attesta.operators import conflicts, filters, freshness, governance, maintenance
from attesta.plans import reports

KEY = ["repo_id", "claim_id"]


def _now():
    return F.lit("2001-08-01").cast("timestamp")


def _claims(t):
    return maintenance.dedup_first(t.claims)


# ---- decisions -------------------------------------------------------------------------


@query("last_decision", "SELECT repo_id, claim_id, action, event_id FROM history_v WHERE action <> 'declared' QUALIFY row_number() OVER (PARTITION BY repo_id, claim_id ORDER BY ts DESC, event_id DESC) = 1")
def _(t):
    return governance.last_decision(t.history).select(*KEY, "action", "event_id")


@query("apply_overrides", """
WITH last AS (SELECT * FROM history_v WHERE action <> 'declared' QUALIFY row_number() OVER (PARTITION BY repo_id, claim_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT c.repo_id, c.claim_id, coalesce(l.action, c.review_state) AS review_state, CASE WHEN l.action = 'edited' THEN l.content_after ELSE c.content END AS content
FROM unique_claims_v c LEFT JOIN last l ON c.repo_id = l.repo_id AND c.claim_id = l.claim_id""")
def _(t):
    return governance.apply_overrides(_claims(t), t.history).select(*KEY, "review_state", "content")


@query("skipped_decisions", """
WITH last AS (SELECT * FROM history_v WHERE action <> 'declared' QUALIFY row_number() OVER (PARTITION BY repo_id, claim_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT repo_id, claim_id, action FROM last l WHERE NOT EXISTS (SELECT 1 FROM claims_v c WHERE c.repo_id = l.repo_id AND c.claim_id = l.claim_id AND c.branch = 'dev')""")
def _(t):
    return governance.skipped_decisions(t.claims.filter("branch = 'dev'"), t.history).select(*KEY, "action")


@query("declared_claims", """
SELECT repo_id, claim_id, content, claim_type, scope, 'declared-reviewed' AS source_authority, 'approved' AS review_state, CAST(1.0 AS DOUBLE) AS confidence
FROM history_v WHERE action = 'declared' QUALIFY row_number() OVER (PARTITION BY repo_id, claim_id ORDER BY ts DESC, event_id DESC) = 1""")
def _(t):
    return governance.declared_claims(t.history)


@query("state_timeline", """
SELECT repo_id, claim_id, event_id, action, ts, lag(action) OVER w AS previous_action, lead(ts) OVER w AS until, coalesce(lag(action) OVER w = 'tombstoned', false) AS illegal
FROM history_v WINDOW w AS (PARTITION BY repo_id, claim_id ORDER BY ts, event_id)""")
def _(t):
    return governance.state_timeline(t.history)


@query("history_by_scope", """
SELECT h.event_id, h.repo_id, h.claim_id, h.action, c.scope AS claim_scope FROM history_v h
JOIN unique_claims_v c ON h.repo_id = c.repo_id AND h.claim_id = c.claim_id WHERE starts_with(c.scope, 'src/m1') OR c.scope = '**'""")
def _(t):
    return reports.history_by_scope(t.history, _claims(t), "src/m1").select("event_id", *KEY, "action", "claim_scope")


@query("audit_log", """
SELECT event_id, repo_id, claim_id, action, ts FROM history_v h WHERE action = 'approved' AND ts >= TIMESTAMP '2024-01-05'
  AND EXISTS (SELECT 1 FROM unique_claims_v c WHERE c.repo_id = h.repo_id AND c.claim_id = h.claim_id AND (starts_with(c.scope, 'src/') OR c.scope = '**'))
ORDER BY ts DESC, event_id DESC LIMIT 50""")
def _(t):
    since = F.lit("2024-01-05").cast("timestamp")
    return reports.audit(t.history, _claims(t), "src/", action="approved", since=since).select("event_id", *KEY, "action", "ts")


# ---- freshness and drift ---------------------------------------------------------------

EVIDENCE_STATE = """
SELECT e.repo_id, e.claim_id, e.file_path, e.line_start, CASE WHEN s.path IS NULL THEN 'deleted' WHEN e.file_hash <> '' AND e.file_hash <> s.blob_hash THEN 'changed' ELSE 'current' END AS state
FROM evidence_v e LEFT JOIN snapshot_v s ON s.repo_id = e.repo_id AND s.path = e.file_path"""
FRESH = f"""
st AS ({EVIDENCE_STATE}),
fl AS (SELECT repo_id, claim_id, count(*) FILTER (state = 'deleted') AS gone, count(*) FILTER (state = 'changed') AS moved FROM st GROUP BY ALL),
fresh AS (SELECT c.repo_id, c.claim_id, CAST(floor((epoch(TIMESTAMP '2001-08-01') - epoch(coalesce(last_validated, created_at))) / 86400) AS BIGINT) AS days_since,
  CASE WHEN floor((epoch(TIMESTAMP '2001-08-01') - epoch(coalesce(last_validated, created_at))) / 86400) > 1200 THEN 'time-expired'
    WHEN r.branch_at_index <> r.branch_now THEN 'branch-changed' WHEN gone > 0 THEN 'evidence-deleted' WHEN moved > 0 THEN 'evidence-changed' END AS trigger
  FROM unique_claims_v c LEFT JOIN fl ON fl.repo_id = c.repo_id AND fl.claim_id = c.claim_id LEFT JOIN repos_v r ON r.repo_id = c.repo_id)"""


def _fresh(t):
    return freshness.check_freshness(_claims(t), t.evidence, t.snapshot, t.repos, _now(), window_days=1200)


@query("evidence_state", EVIDENCE_STATE)
def _(t):
    return freshness.evidence_state(t.evidence, t.snapshot).select(*KEY, "file_path", "line_start", "state")


@query("changed_files", """
SELECT coalesce(o.repo_id, n.repo_id) AS repo_id, coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM snapshot_old_v o FULL JOIN snapshot_v n ON o.repo_id = n.repo_id AND o.path = n.path WHERE o.blob_hash IS DISTINCT FROM n.blob_hash""")
def _(t):
    return freshness.changed_files(t.snapshot_old, t.snapshot)


@query("check_freshness", f"WITH {FRESH} SELECT *, trigger IS NOT NULL AS stale FROM fresh")
def _(t):
    return _fresh(t)


@query("freshness_report", f"""
WITH {FRESH} SELECT f.repo_id, count(*) AS total, count(trigger) AS stale, count(*) - count(trigger) AS fresh,
  count(*) FILTER (trigger = 'time-expired') AS n_time_expired, count(*) FILTER (trigger = 'branch-changed') AS n_branch_changed,
  count(*) FILTER (trigger = 'evidence-deleted') AS n_evidence_deleted, count(*) FILTER (trigger = 'evidence-changed') AS n_evidence_changed,
  any_value(branch_at_index <> branch_now) AS branch_changed, any_value(head_at_index <> head_now) AS head_changed
FROM fresh f JOIN repos_v r ON r.repo_id = f.repo_id GROUP BY f.repo_id""")
def _(t):
    return freshness.freshness_report(_fresh(t), t.repos)


@query("mark_stale", f"""
WITH {FRESH} SELECT c.repo_id, c.claim_id, c.stale OR f.trigger IS NOT NULL AS stale, f.trigger AS revalidation_trigger
FROM unique_claims_v c JOIN fresh f ON c.repo_id = f.repo_id AND c.claim_id = f.claim_id""")
def _(t):
    return maintenance.mark_stale(_claims(t), _fresh(t)).select(*KEY, "stale", "revalidation_trigger")


@query("revalidate", """
SELECT c.repo_id, c.claim_id, c.stale AND a.claim_id IS NULL AS stale, CASE WHEN c.stale AND a.claim_id IS NOT NULL THEN TIMESTAMP '2001-08-01' ELSE c.last_validated END AS last_validated
FROM unique_claims_v c LEFT JOIN (SELECT DISTINCT repo_id, claim_id FROM claims_v WHERE branch = 'main') a ON a.repo_id = c.repo_id AND a.claim_id = c.claim_id""")
def _(t):
    out = maintenance.revalidate(_claims(t), t.claims.filter("branch = 'main'"), _now())
    return out.select(*KEY, "stale", "last_validated")


@query("stale_audit_rows", f"WITH {FRESH} SELECT repo_id, claim_id, 'stale' AS action, trigger AS reason FROM fresh WHERE trigger IS NOT NULL")
def _(t):
    return maintenance.audit_rows(_fresh(t), _now()).select(*KEY, "action", "reason")


DRIFT = """
SELECT coalesce(a.repo_id, d.repo_id) AS repo_id, coalesce(a.path, d.path) AS path,
  CASE WHEN a.path IS NULL THEN 'unmanaged' WHEN d.path IS NULL THEN 'missing' WHEN a.expected_hash <> d.h THEN 'drifted' ELSE 'clean' END AS status
FROM artifacts_v a FULL JOIN (SELECT repo_id, path, sha256(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\v\\r]+(\\n|$)', '\\1', 'g')) AS h FROM disk_v) d ON a.repo_id = d.repo_id AND a.path = d.path"""


@query("artifact_drift", DRIFT)
def _(t):
    disk = t.disk.select("repo_id", "path", content_hash(F.col("text")).alias("disk_hash"))
    return freshness.drift(t.artifacts, disk).select("repo_id", "path", "status")


@query("drift_accuracy", f"""
WITH d AS ({DRIFT}), e AS (SELECT repo_id, count(*) FILTER (expected_hash <> sha256(text)) AS expected FROM artifacts_v JOIN (SELECT repo_id, path, text FROM disk_v) x USING (repo_id, path) GROUP BY repo_id),
g AS (SELECT repo_id, count(*) FILTER (status = 'drifted') AS detected FROM d GROUP BY repo_id)
SELECT repo_id, coalesce(expected, 0) AS expected, detected, greatest(detected - coalesce(expected, 0), 0) AS false_positives, greatest(coalesce(expected, 0) - detected, 0) AS false_negatives FROM g LEFT JOIN e USING (repo_id)""")
def _(t):
    from attesta.plans.quality import drift_accuracy

    disk = t.disk.select("repo_id", "path", content_hash(F.col("text")).alias("disk_hash"))
    found = freshness.drift(t.artifacts, disk)
    plain = t.disk.select("repo_id", "path", F.sha2("text", 256).alias("raw"))
    expected = t.artifacts.join(plain, ["repo_id", "path"]).groupBy("repo_id").agg(F.count_if(F.col("raw") != F.col("expected_hash")).alias("expected"))
    return drift_accuracy(found, expected)


@query("ownership_guard", "SELECT d.repo_id, d.path FROM disk_v d WHERE NOT EXISTS (SELECT 1 FROM artifacts_v a WHERE a.repo_id = d.repo_id AND a.path = d.path AND a.ownership_mode = 'imported-human-owned')")
def _(t):
    owned = t.artifacts.filter("ownership_mode = 'imported-human-owned'")
    return maintenance.delete_keys(t.disk.select("repo_id", "path"), owned, ["repo_id", "path"])


@query("content_hashes", "SELECT text_id, sha256(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\v\\r]+(\\n|$)', '\\1', 'g')) AS content_hash FROM texts_v")
def _(t):
    return t.texts.select("text_id", content_hash(F.col("text")).alias("content_hash"))


# ---- conflicts -------------------------------------------------------------------------


@query("same_key_conflicts", """
WITH u AS (SELECT * FROM unique_claims_v)
SELECT a.repo_id, a.claim_id, count(*) AS partners, min(b.content) AS rival FROM u a JOIN u b ON a.repo_id = b.repo_id AND a.claim_type = b.claim_type AND a.scope = b.scope AND a.content <> b.content GROUP BY a.repo_id, a.claim_id""")
def _(t):
    return conflicts.same_key_conflicts(_claims(t)).select(*KEY, "partners", "rival")


VERSIONS = """
v AS (SELECT repo_id, claim_id, content, source_authority, kind, runtime, ver FROM (SELECT *, CASE WHEN contains(content, '>') THEN 'minimum' WHEN contains(content, '+') THEN 'range' ELSE 'exact' END AS kind,
  CASE WHEN contains(lower(content), 'python') THEN 'python' WHEN contains(lower(content), 'node') THEN 'node' WHEN contains(lower(content), 'go') THEN 'go' WHEN contains(lower(content), 'ruby') THEN 'ruby' WHEN regexp_matches(lower(content), 'java|jdk') THEN 'java' WHEN contains(lower(content), 'rust') THEN 'rust' END AS runtime,
  list_transform(string_split(regexp_extract(content, '(\\d+(?:\\.\\d+)*)', 1), '.'), lambda x: try_cast(x AS INT)) AS ver
  FROM unique_claims_v WHERE claim_type = 'environment-prerequisite') AS s WHERE runtime IS NOT NULL AND regexp_matches(content, '\\d') AND kind <> 'range')"""
CLASH = "((a.kind = 'exact' AND b.kind = 'exact' AND a.ver <> b.ver) OR (a.kind = 'minimum' AND b.kind = 'exact' AND b.ver < a.ver) OR (b.kind = 'minimum' AND a.kind = 'exact' AND a.ver < b.ver))"


@query("version_conflicts", f"""
WITH {VERSIONS} SELECT a.repo_id, a.claim_id, a.runtime, count(*) AS partners, 'version' AS conflict_type FROM v a JOIN v b ON a.repo_id = b.repo_id AND a.runtime = b.runtime AND {CLASH} GROUP BY ALL""")
def _(t):
    return conflicts.version_conflicts(_claims(t)).select(*KEY, "runtime", "partners", "conflict_type")


@query("import_vs_extracted_conflicts", f"""
WITH {VERSIONS} SELECT a.repo_id, a.claim_id, a.runtime, count(*) AS partners, 'import-vs-extraction' AS conflict_type FROM v a JOIN v b ON a.repo_id = b.repo_id AND a.runtime = b.runtime AND {CLASH}
WHERE a.source_authority = 'declared-imported-unreviewed' AND b.source_authority <> 'declared-imported-unreviewed' GROUP BY ALL""")
def _(t):
    return conflicts.import_conflicts(_claims(t)).select(*KEY, "runtime", "partners", "conflict_type")


@query("docs_command_conflicts", """
WITH cfg AS (SELECT CASE WHEN branch = 'dev' AND stale THEN repo_id ELSE concat(repo_id, '-main') END AS repo_id, bool_or(contains(lower(content), 'test')) AS has_test FROM claims_v WHERE claim_type = 'validated-command' AND source_authority IN ('executable-config', 'ci-observed') GROUP BY ALL)
SELECT c.repo_id, c.claim_id, c.ordinal FROM claims_v c JOIN cfg ON cfg.repo_id = c.repo_id AND NOT has_test
WHERE claim_type = 'validated-command' AND source_authority = 'checked-in-docs' AND (content = 'npm test' OR starts_with(content, 'npm run ') OR starts_with(content, 'yarn test'))""")
def _(t):
    docs = t.claims.filter("source_authority = 'checked-in-docs'")
    config = t.claims.filter("source_authority <> 'checked-in-docs'").withColumn("repo_id", F.when(F.expr("branch = 'dev' AND stale"), F.col("repo_id")).otherwise(F.concat("repo_id", F.lit("-main"))))
    return conflicts.docs_command_conflicts(docs.unionByName(config)).select(*KEY, "ordinal")


@query("stale_import_conflicts", """
WITH cfg AS (SELECT repo_id, content, CASE WHEN split_part(content, ' ', 1) IN ('npm', 'yarn', 'pnpm', 'make', 'docker') THEN concat(split_part(content, ' ', 1), ' ', split_part(content, ' ', 2)) ELSE split_part(content, ' ', 1) END AS k FROM claims_v WHERE claim_type = 'validated-command' AND source_authority IN ('executable-config', 'ci-observed')),
imp AS (SELECT *, CASE WHEN split_part(content, ' ', 1) IN ('npm', 'yarn', 'pnpm', 'make', 'docker') THEN concat(split_part(content, ' ', 1), ' ', split_part(content, ' ', 2)) ELSE split_part(content, ' ', 1) END AS k FROM claims_v WHERE claim_type = 'validated-command' AND source_authority = 'declared-imported-unreviewed')
SELECT repo_id, claim_id, ordinal FROM imp WHERE EXISTS (SELECT 1 FROM cfg WHERE cfg.repo_id = imp.repo_id) AND NOT EXISTS (SELECT 1 FROM cfg WHERE cfg.repo_id = imp.repo_id AND cfg.k = imp.k)
  AND NOT EXISTS (SELECT 1 FROM cfg WHERE cfg.repo_id = imp.repo_id AND lower(cfg.content) = lower(imp.content))""")
def _(t):
    return conflicts.stale_import_conflicts(t.claims).select(*KEY, "ordinal")


TOPIC = """CASE WHEN regexp_matches(lower(content), 'function name|naming') THEN 'function naming' WHEN contains(lower(content), 'class name') THEN 'class naming' WHEN contains(lower(content), 'import') THEN 'import style'
  WHEN contains(lower(content), 'docstring') THEN 'docstrings' WHEN regexp_matches(lower(content), 'type annotation|return type') THEN 'type annotations' WHEN contains(lower(content), 'test') AND contains(lower(content), 'place') THEN 'test placement'
  WHEN contains(lower(content), 'test framework') THEN 'test framework' WHEN contains(lower(content), 'lint') THEN 'linting' WHEN contains(lower(content), 'format') THEN 'formatting' END"""
STYLES = "list_filter(['snake_case', 'camelCase', 'PascalCase', 'SCREAMING_SNAKE', 'prefer absolute', 'prefer relative'], lambda s: contains(content, s) OR (starts_with(s, 'prefer') AND contains(lower(content), s)))"


@query("convention_topics", f"SELECT ordinal, {TOPIC} AS topic, replace(replace(array_to_string({STYLES}, '|'), 'prefer absolute', 'absolute_imports'), 'prefer relative', 'relative_imports') AS styles FROM claims_v WHERE claim_type IN ('always-on-rule', 'scoped-rule')")
def _(t):
    rules = t.claims.filter(F.col("claim_type").isin("always-on-rule", "scoped-rule"))
    return rules.select("ordinal", conflicts.topic(F.col("content")).alias("topic"), F.array_join(conflicts.styles(F.col("content")), "|").alias("styles"))


@query("convention_topic_conflicts", f"""
WITH r AS (SELECT *, {TOPIC} AS topic, {STYLES} AS st FROM unique_claims_v WHERE claim_type IN ('always-on-rule', 'scoped-rule')),
g AS (SELECT repo_id, topic, min(authority_level) AS authority_level, count(DISTINCT content) AS contents FROM r WHERE topic IS NOT NULL GROUP BY ALL),
s AS (SELECT repo_id, topic, count(DISTINCT style) AS styles FROM (SELECT repo_id, topic, unnest(st) AS style FROM r) AS x GROUP BY ALL),
f AS (SELECT repo_id, topic, string_agg(concat('''', content, ''''), ' vs ' ORDER BY ordinal) AS said FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY repo_id, topic ORDER BY ordinal) <= 3) AS y GROUP BY ALL)
SELECT g.repo_id, g.topic, CAST(styles AS INT) AS styles, authority_level, concat('Convention conflict on ''', g.topic, ''': ', said) AS content FROM g JOIN s USING (repo_id, topic) JOIN f USING (repo_id, topic) WHERE contents > 1 AND styles > 1""")
def _(t):
    return conflicts.topic_conflicts(_claims(t))


@query("highest_authority", "SELECT repo_id, claim_type, arg_min(source_authority, (authority_level, source_authority)) AS authority FROM claims_v GROUP BY ALL")
def _(t):
    return conflicts.highest_authority(t.claims, ["repo_id", "claim_type"])


# ---- read reports ----------------------------------------------------------------------

PAGE_HEAD = "SELECT repo_id, claim_id, content, row_number() OVER (ORDER BY {keys}) AS position, (SELECT count(*) FROM unique_claims_v WHERE {w}) AS total FROM unique_claims_v WHERE {w} ORDER BY {keys} LIMIT 50"


@query("validated_commands", PAGE_HEAD.format(keys="claim_id, repo_id", w=f"claim_type = 'validated-command' AND {GATE}"))
def _(t):
    return reports.validated_commands(_claims(t)).select(*KEY, "content", F.col("position").cast("bigint").alias("position"), "total")


@query("conventions", PAGE_HEAD.format(keys="authority_level, claim_id, repo_id", w=f"claim_type IN ('always-on-rule', 'scoped-rule') AND scope IN ('src/m3', '**') AND list_has_any(applicability, ['all', 'test']) AND {GATE}"))
def _(t):
    return reports.conventions(_claims(t), "src/m3", "test").select(*KEY, "content", F.col("position").cast("bigint").alias("position"), "total")


PROFILES = "p AS (SELECT repo_id, min(content) FILTER (starts_with(content, 'Python')) AS runtime, count(*) FILTER (starts_with(content, 'Service:')) AS services FROM unique_claims_v WHERE claim_type = 'environment-prerequisite' GROUP BY repo_id)"


@query("prerequisites", f"WITH {PROFILES} SELECT c.repo_id, c.claim_id, c.content, p.runtime, p.services FROM unique_claims_v c LEFT JOIN p ON p.repo_id = c.repo_id WHERE claim_type = 'environment-prerequisite' AND {GATE} AND scope IN ('src/m4', '**')")
def _(t):
    claims = _claims(t)
    text = F.col("content")
    profiles = claims.filter("claim_type = 'environment-prerequisite'").groupBy("repo_id").agg(
        F.min(F.when(text.startswith("Python"), text)).alias("runtime"), F.count_if(text.startswith("Service:")).alias("services"))
    return reports.prerequisites(claims, profiles, "src/m4").select(*KEY, "content", "runtime", "services")


@query("conflict_report", f"SELECT repo_id, claim_id, content, 'Review and resolve the conflicting claims' AS suggested_resolution FROM unique_claims_v WHERE claim_type = 'conflict' AND {GATE}")
def _(t):
    return reports.conflicts(_claims(t)).select(*KEY, "content", "suggested_resolution")


@query("guardrail_report", f"""
SELECT repo_id, claim_id, content, CASE WHEN confidence >= 0.95 AND contains(lower(content), 'destructive') THEN 'tool-allowlist' ELSE 'advisory text only' END AS mechanism
FROM unique_claims_v WHERE claim_type = 'permission-restriction' AND {GATE}""")
def _(t):
    return reports.guardrails(_claims(t), host="copilot").select(*KEY, "content", "mechanism")


RULE = "(claim_type IN ('always-on-rule', 'scoped-rule') AND list_has_any(applicability, ['all', 'test']))"


@query("preflight", f"""
SELECT repo_id, count(*) FILTER ({RULE}) AS rules, count(*) FILTER (claim_type = 'validated-command') AS commands, count(*) FILTER (claim_type = 'permission-restriction') AS guardrails,
  count(*) FILTER (({RULE} OR claim_type = 'validated-command') AND stale) AS stale_claims, count(*) FILTER (claim_type = 'conflict') AS open_conflicts
FROM unique_claims_v WHERE {GATE} AND scope IN ('src/m3', '**') GROUP BY repo_id""")
def _(t):
    return reports.preflight(_claims(t), "src/m3", "test")


@query("preflight_items", f"""
SELECT repo_id, claim_id, CASE WHEN {RULE} THEN 'rule' WHEN claim_type = 'validated-command' THEN 'command' WHEN claim_type = 'permission-restriction' THEN 'guardrail' WHEN claim_type = 'conflict' THEN 'conflict' END AS bucket
FROM unique_claims_v WHERE {GATE} AND scope IN ('src/m3', '**') AND bucket IS NOT NULL""")
def _(t):
    return reports.preflight_items(_claims(t), "src/m3", "test").select(*KEY, "bucket")


@query("response_freshness", f"""
SELECT r.repo_id, s.stale_in_response, CAST(epoch(TIMESTAMP '2001-08-01') - epoch(last_indexed) AS BIGINT) AS index_age_seconds, head_at_index = head_now AS head_current
FROM (SELECT repo_id, count(*) FILTER (stale) AS stale_in_response FROM unique_claims_v WHERE {GATE} GROUP BY repo_id) s JOIN repos_v r ON r.repo_id = s.repo_id""")
def _(t):
    return reports.response_freshness(filters.output_gate(_claims(t)), t.repos, _now())


@query("claim_with_chain", """
WITH e AS (SELECT repo_id, claim_id, count(*) AS n, count(DISTINCT file_path) AS f, min(file_path) AS first_file FROM evidence_v GROUP BY ALL),
h AS (SELECT repo_id, claim_id, count(*) AS n, arg_max(action, (ts, event_id)) AS last_action FROM history_v GROUP BY ALL)
SELECT c.repo_id, c.claim_id, coalesce(e.n, 0) AS evidence_rows, coalesce(e.f, 0) AS evidence_files, e.first_file, coalesce(h.n, 0) AS decisions, h.last_action
FROM unique_claims_v c LEFT JOIN e ON e.repo_id = c.repo_id AND e.claim_id = c.claim_id LEFT JOIN h ON h.repo_id = c.repo_id AND h.claim_id = c.claim_id""")
def _(t):
    out = reports.claim_with_chain(_claims(t), t.evidence, t.history)
    return out.select(*KEY, "evidence_rows", "evidence_files", "first_file", "decisions", "last_action")


@query("claim_chain_rows", """
SELECT x.* FROM (SELECT repo_id, claim_id, 'evidence' AS part, concat_ws(':', file_path, line_start, line_end) AS item FROM evidence_v
  UNION ALL SELECT repo_id, claim_id, 'history', concat_ws(':', action, actor, lpad(event_id::varchar, 12, '0')) FROM history_v) AS x
WHERE EXISTS (SELECT 1 FROM unique_claims_v c WHERE c.repo_id = x.repo_id AND c.claim_id = x.claim_id AND c.claim_type = 'conflict')""")
def _(t):
    wanted = _claims(t).filter("claim_type = 'conflict'")
    return reports.claim_chain_rows(wanted, t.evidence, t.history)


@query("repo_overview", f"""
WITH s AS (SELECT * FROM unique_claims_v WHERE {GATE}),
f AS (SELECT repo_id, count(*) AS indexed_files, 'Python' AS languages FROM (SELECT DISTINCT e.repo_id, e.file_path FROM evidence_v e JOIN s ON s.repo_id = e.repo_id AND s.claim_id = e.claim_id) AS d GROUP BY repo_id)
SELECT s.repo_id, count(*) AS total, {", ".join(f"count(*) FILTER (claim_type = '{c}') AS n_{c.replace('-', '_')}" for c in ('always-on-rule', 'scoped-rule', 'skill-playbook', 'environment-prerequisite', 'validated-command', 'permission-restriction', 'module-boundary', 'conflict'))},
  {", ".join(f"count(*) FILTER (review_state = '{c}') AS n_{c.replace('-', '_')}" for c in ('unreviewed', 'needs-declaration', 'approved', 'edited'))}, any_value(indexed_files) AS indexed_files, any_value(languages) AS languages
FROM s LEFT JOIN f ON f.repo_id = s.repo_id GROUP BY s.repo_id""")
def _(t):
    return reports.repo_overview(_claims(t), t.evidence)


@query("repo_entrypoints", f"SELECT DISTINCT repo_id, content AS command FROM unique_claims_v WHERE claim_type = 'validated-command' AND {GATE}")
def _(t):
    return reports.entrypoints(_claims(t))


@query("status_rollup", "SELECT repo_id, claim_type, review_state, count(*) AS claims, round(CAST(sum(CAST(confidence AS DECIMAL(18, 6))) AS DOUBLE) / count(*), 6) AS mean_confidence FROM unique_claims_v GROUP BY GROUPING SETS ((repo_id, claim_type), (repo_id, review_state), (repo_id))")
def _(t):
    return reports.status_rollup(_claims(t))
