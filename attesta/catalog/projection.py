"""Routing, budgets, rendering and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.catalog.claims import GATE
from attesta.catalog.registry import query
from attesta.functions.base import content_hash
from attesta.operators import filters, freshness, maintenance
from attesta.plans import projection, quality
from attesta.session import checkpointed

AS_OF = "2001-08-01T00:00:00Z"
KEY = ["repo_id", "claim_id"]
HIGH = "source_authority IN ('human-override', 'declared-reviewed', 'executable-config', 'ci-observed', 'inferred-high')"
RULE = "claim_type IN ('always-on-rule', 'scoped-rule')"
SLUG = "CASE WHEN scope = '**' THEN 'general' ELSE replace(scope, '/', '-') END"
BROAD = "(len(applicability) = 0 OR list_contains(applicability, 'all'))"
ROUTED = f"""
g AS (SELECT * FROM unique_claims_v WHERE {GATE}), hosts AS (SELECT unnest(['agents-md', 'claude', 'copilot', 'cursor', 'windsurf']) AS host),
sec AS (SELECT *, CASE
  WHEN host = 'agents-md' THEN CASE WHEN claim_type = 'validated-command' THEN 'commands' WHEN {RULE} AND {HIGH} THEN 'conventions' END
  WHEN host = 'claude' THEN CASE WHEN scope <> '**' AND ({RULE} OR claim_type = 'permission-restriction') THEN 'scoped' WHEN claim_type = 'skill-playbook' THEN 'skills' WHEN claim_type = 'scoped-rule' AND NOT {BROAD} THEN 'skills'
    WHEN {RULE} AND NOT {HIGH} THEN 'skills' WHEN {RULE} THEN 'conventions' WHEN claim_type = 'validated-command' THEN 'commands' WHEN claim_type = 'permission-restriction' THEN 'guardrails' END
  ELSE CASE WHEN scope <> '**' AND {RULE} THEN 'scoped' WHEN claim_type = 'skill-playbook' THEN CASE host WHEN 'windsurf' THEN 'excluded' WHEN 'cursor' THEN 'skills' END WHEN claim_type = 'environment-prerequisite' THEN 'setup' WHEN claim_type = 'validated-command' THEN 'commands'
    WHEN {RULE} THEN CASE WHEN {HIGH} THEN 'conventions' ELSE 'excluded' END WHEN claim_type = 'permission-restriction' THEN 'guardrails' END END AS section FROM g CROSS JOIN hosts),
routed AS (SELECT *, CASE WHEN section = 'excluded' THEN 'excluded' WHEN host = 'agents-md' THEN 'AGENTS.md' WHEN section = 'scoped' THEN CASE host WHEN 'claude' THEN concat('rules/', scope) WHEN 'copilot' THEN concat('instructions/', scope) ELSE concat('rules/managed-', {SLUG}) END
  WHEN host = 'claude' AND section = 'skills' THEN 'skills' WHEN host = 'copilot' AND section = 'setup' THEN 'setup-steps' WHEN host = 'claude' THEN 'claude.md' WHEN host = 'copilot' THEN 'copilot-instructions.md' ELSE 'rules' END AS destination FROM sec WHERE section IS NOT NULL)"""


def _gated(t):
    return filters.output_gate(maintenance.dedup_first(t.claims))


def _routed(t):
    return projection.route_claims(_gated(t))


def _files(t):
    return projection.project(_gated(t), AS_OF)


@query("route_claims", f"WITH {ROUTED} SELECT repo_id, claim_id, host, section, destination FROM routed")
def _(t):
    return _routed(t).select(*KEY, "host", "section", "destination")


@query("budget_prefix", f"""
WITH {ROUTED}, a AS (SELECT *, CASE section WHEN 'commands' THEN 0 ELSE 1 END AS s, CASE WHEN section = 'commands' THEN coalesce(risk_class, 'build') END AS r FROM routed WHERE host = 'agents-md'),
o AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY s, authority_level, scope, claim_type, claim_id) AS n FROM a),
c AS (SELECT *, octet_length(encode(content)) + CASE s WHEN 0 THEN 5 ELSE 3 END
  + CASE WHEN s = 0 AND row_number() OVER (PARTITION BY repo_id, s, r ORDER BY n) = 1 THEN 7 + CASE r WHEN 'safe-readonly' THEN 16 WHEN 'safe-mutating' THEN 15 WHEN 'test-execution' THEN 7 WHEN 'build' THEN 5 ELSE 11 END ELSE 0 END
  + CASE WHEN row_number() OVER (PARTITION BY repo_id, s ORDER BY n) = 1 THEN CASE s WHEN 0 THEN 12 ELSE 16 END ELSE 0 END AS cost FROM o)
SELECT repo_id, claim_id, section, 100 + sum(cost) OVER (PARTITION BY repo_id ORDER BY n) <= 1500 AS included FROM c""")
def _(t):
    routed = _routed(t)
    kept = projection.budget_prefix(routed, header_bytes=100, budget=1500)
    return projection.with_verdict(routed.filter("host = 'agents-md'"), kept, KEY).select(*KEY, "section", "included")


def _greedy(source: str, keys: str, order: str, size: str, extra: str, budget: int, start: int, state: str) -> str:
    """Check SQL of a greedy fill: one recursion step per rank, all groups at once."""
    return f"""
q AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rk FROM {source}),
f AS (SELECT DISTINCT {keys}, CAST(0 AS BIGINT) AS rk, CAST({start} AS BIGINT) AS used, '' AS opened, false AS took FROM q
  UNION ALL SELECT {", ".join("q." + k for k in keys.split(", "))}, q.rk, CASE WHEN f.used + {size} + {extra} <= {budget} THEN f.used + {size} + {extra} ELSE f.used END,
    CASE WHEN f.used + {size} + {extra} <= {budget} THEN {state} ELSE f.opened END, f.used + {size} + {extra} <= {budget} FROM f JOIN q ON {" AND ".join(f"q.{k} = f.{k}" for k in keys.split(", "))} AND q.rk = f.rk + 1)"""


@query("budget_greedy", f"""
WITH RECURSIVE {ROUTED}, w AS (SELECT *, octet_length(encode(content)) AS bytes FROM routed WHERE host = 'windsurf' AND section <> 'excluded'),
{_greedy('w', 'repo_id', 'authority_level, confidence DESC, claim_id', 'q.bytes', '0', 2000, 0, "''")}
SELECT q.repo_id, q.claim_id, f.took AS included, CASE WHEN f.took THEN 'within budget' ELSE 'exceeded hard budget' END AS budget_reason FROM q JOIN f ON f.repo_id = q.repo_id AND f.rk = q.rk""")
def _(t):
    return projection.budget_greedy(_routed(t), 2000).select(*KEY, "included", "budget_reason")


OPENS = "CASE WHEN contains(f.opened, q.section) THEN 0 ELSE 3 END"


@query("line_budget_overflow", f"""
WITH RECURSIVE {ROUTED}, w AS (SELECT *, CASE section WHEN 'commands' THEN 0 WHEN 'conventions' THEN 1 ELSE 2 END AS s FROM routed WHERE host = 'claude' AND section IN ('commands', 'conventions', 'guardrails')),
{_greedy('w', 'repo_id', 's, authority_level, scope, claim_type, claim_id', '2', OPENS, 45, 3, "concat(f.opened, '|', q.section)")}
SELECT q.repo_id, q.claim_id, f.took AS included, CASE WHEN f.took THEN 'claude.md' ELSE 'skills' END AS destination FROM q JOIN f ON f.repo_id = q.repo_id AND f.rk = q.rk""")
def _(t):
    return projection.line_budget_overflow(_routed(t), soft_lines=60).select(*KEY, "included", "destination")


FILES = f"""
fs AS (SELECT repo_id, host, concat('.', host, '/rules/managed-', section, '.md') AS path, CASE section WHEN 'guardrails' THEN 0 WHEN 'commands' THEN 1 WHEN 'setup' THEN 2 WHEN 'conventions' THEN 3 ELSE 4 END AS priority,
  CAST(sum(length(content) + CASE section WHEN 'commands' THEN 5 ELSE 3 END) AS BIGINT) AS chars FROM routed WHERE host IN ('cursor', 'windsurf') AND section IN ('guardrails', 'commands', 'setup', 'conventions', 'skills') GROUP BY ALL)"""


@query("rule_file_sizes", f"WITH {ROUTED}, {FILES} SELECT * FROM fs")
def _(t):
    return projection.rule_file_sizes(projection.rule_files(_routed(t)))


@query("workspace_budget", f"""
WITH RECURSIVE {ROUTED}, {FILES}, w AS (SELECT * FROM fs WHERE host = 'windsurf' AND chars <= 900),
{_greedy('w', 'repo_id', 'priority, path', 'q.chars', '0', 1500, 0, "''")}
SELECT x.repo_id, x.path, coalesce(f.took, false) AS included, CASE WHEN f.took THEN 'included' WHEN chars > 900 THEN 'file exceeds per-file limit' ELSE 'workspace budget exceeded' END AS reason
FROM fs x LEFT JOIN (SELECT q.repo_id, q.path, f.took FROM q JOIN f ON f.repo_id = q.repo_id AND f.rk = q.rk) f ON f.repo_id = x.repo_id AND f.path = x.path WHERE x.host = 'windsurf'""")
def _(t):
    sizes = projection.rule_file_sizes(projection.rule_files(_routed(t))).filter("host = 'windsurf'").drop("host")
    return projection.workspace_budget(sizes, 900, 1500).select("repo_id", "path", "included", "reason")


@query("overflow_report", f"""
WITH RECURSIVE {ROUTED}, w AS (SELECT *, octet_length(encode(content)) AS bytes FROM routed WHERE host = 'windsurf' AND section <> 'excluded'),
{_greedy('w', 'repo_id', 'authority_level, confidence DESC, claim_id', 'q.bytes', '0', 2000, 0, "''")}
SELECT q.repo_id, 'windsurf' AS host, count(*) FILTER (took) AS included, count(*) FILTER (NOT took) AS omitted, CAST(coalesce(sum(bytes) FILTER (took), 0) AS BIGINT) AS used_bytes, count(*) FILTER (took) AS used_lines FROM q JOIN f ON f.repo_id = q.repo_id AND f.rk = q.rk GROUP BY q.repo_id""")
def _(t):
    return projection.overflow_report(projection.budget_greedy(_routed(t), 2000))


@query("without_shared_claims", f"""
WITH {ROUTED} SELECT repo_id, claim_id, section FROM routed r WHERE host = 'windsurf' AND NOT EXISTS (SELECT 1 FROM routed a WHERE a.host = 'agents-md' AND a.repo_id = r.repo_id AND a.claim_id = r.claim_id)""")
def _(t):
    routed = _routed(t)
    return projection.without_shared(routed.filter("host = 'windsurf'"), routed.filter("host = 'agents-md'")).select(*KEY, "section")


# ---- rendering -------------------------------------------------------------------------

AGENT_LINES = f"""
al AS (SELECT repo_id, CASE section WHEN 'commands' THEN 0 ELSE 1 END AS s, CASE section WHEN 'commands' THEN CASE coalesce(risk_class, 'build') WHEN 'safe-readonly' THEN 0 WHEN 'safe-mutating' THEN 1 WHEN 'test-execution' THEN 2 WHEN 'build' THEN 3 ELSE 4 END ELSE 0 END AS grp, 1 AS k, authority_level, scope, claim_type, claim_id,
  CASE section WHEN 'commands' THEN concat('- `', content, '`') ELSE concat('- ', content) END AS text FROM routed WHERE host = 'agents-md'),
hd AS (SELECT DISTINCT repo_id, s, -1 AS grp, 0 AS k, 0 AS authority_level, '' AS scope, '' AS claim_type, '' AS claim_id, CASE s WHEN 0 THEN '## Commands' ELSE '## Conventions' END AS text FROM al
  UNION ALL SELECT DISTINCT repo_id, s, grp, 0, 0, '', '', '', ['### Safe (read-only)', '### Safe (mutating)', '### Testing', '### Build', '### Destructive'][grp + 1] FROM al WHERE s = 0)"""


@query("always_on_lines", f"WITH {ROUTED}, {AGENT_LINES} SELECT repo_id, s AS section_no, grp AS group_no, text FROM (SELECT * FROM al UNION ALL SELECT * FROM hd) AS x")
def _(t):
    shared = projection.budget_prefix(_routed(t))
    return projection.always_on_lines(shared).select("repo_id", "section_no", "group_no", "text")


@query("shared_instruction_file", f"""
WITH {ROUTED}, {AGENT_LINES} SELECT repo_id, 'AGENTS.md' AS path, concat('<!-- Generated from claims | repo: ', repo_id, ' | timestamp: {AS_OF} | DO NOT EDIT -->', chr(10), chr(10), string_agg(text, chr(10) ORDER BY s, grp, k, authority_level, scope, claim_type, claim_id), chr(10)) AS text
FROM (SELECT * FROM al UNION ALL SELECT * FROM hd) AS x GROUP BY repo_id""")
def _(t):
    shared = projection.budget_prefix(_routed(t))
    return projection.assemble(projection.always_on_lines(shared), AS_OF).select("repo_id", "path", "text")


@query("thin_instruction_lines", f"""
WITH {ROUTED}, c AS (SELECT * FROM routed WHERE host = 'copilot'),
l AS (SELECT repo_id, 0 AS s, CASE WHEN contains(lower(content), 'destructive') THEN concat('- **WARNING**: ', content) ELSE concat('- ', content) END AS text FROM c WHERE section = 'guardrails'
  UNION ALL SELECT repo_id, 1, concat('- `', content, '`') FROM c WHERE section = 'commands' AND (risk_class IN ('test-execution', 'safe-readonly') OR list_has_any(applicability, ['test', 'lint', 'build']))
  UNION ALL SELECT repo_id, 2, concat('- ', content) FROM (SELECT * FROM c WHERE section = 'conventions' QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY authority_level, scope, claim_type, claim_id) <= 10) AS x
  UNION ALL SELECT repo_id, 3, concat('- ', content) FROM (SELECT * FROM c WHERE section = 'setup' QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY authority_level, scope, claim_type, claim_id) <= 5) AS y)
SELECT repo_id, s AS section_no, text FROM l UNION ALL SELECT DISTINCT repo_id, s, ['## Restrictions', '## Key Commands', '## Critical Conventions', '## Environment'][s + 1] FROM l""")
def _(t):
    return projection.thin_lines(_routed(t)).select("repo_id", "section_no", "text")


@query("scoped_files", f"""
WITH {ROUTED}, s AS (SELECT *, {SLUG} AS slug FROM routed WHERE section = 'scoped' AND host = 'copilot')
SELECT repo_id, concat('.github/instructions/', slug, '.instructions.md') AS path, concat('---', chr(10), 'applyTo: ', any_value(scope), chr(10), '---', chr(10), string_agg(concat('- ', content), chr(10) ORDER BY authority_level, scope, claim_type, claim_id), chr(10)) AS text FROM s GROUP BY repo_id, slug""")
def _(t):
    routed = _routed(t).filter("host = 'copilot'")
    return projection.assemble(projection.scoped_lines(routed), AS_OF).select("repo_id", "path", "text")


SKILL = "CASE coalesce(list_filter(applicability, lambda x: x <> 'all')[1], 'general') WHEN 'test' THEN 'validate-and-test' WHEN 'ci' THEN 'ci-workflow' WHEN 'lint' THEN 'code-quality' WHEN 'onboarding' THEN 'getting-started' ELSE 'general' END"
SKILLED = f"sk AS (SELECT *, {SKILL} AS skill FROM routed WHERE host = 'claude' AND section = 'skills'), ok AS (SELECT repo_id, skill FROM sk GROUP BY ALL HAVING count(*) >= 2 OR bool_or(confidence >= 0.9 AND authority_level <= 30))"


def _skills(t):
    return projection.skill_groups(_routed(t).filter("host = 'claude' AND section = 'skills'"))


@query("skill_groups", f"WITH {ROUTED}, {SKILLED} SELECT sk.repo_id, sk.claim_id, sk.skill AS final_skill FROM sk JOIN ok ON ok.repo_id = sk.repo_id AND ok.skill = sk.skill")
def _(t):
    return _skills(t).select(*KEY, "final_skill")


@query("skill_consolidation", """
WITH s AS (SELECT repo_id, scope AS skill, count(*) AS n FROM claims_v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, skill) AS rk, count(*) OVER (PARTITION BY repo_id) AS groups FROM s)
SELECT repo_id, skill, CASE WHEN groups > 10 AND rk >= 10 THEN 'general' ELSE skill END AS final_skill FROM r""")
def _(t):
    sizes = t.claims.groupBy("repo_id", F.col("scope").alias("skill")).agg(F.count(F.lit(1)).alias("n"))
    return projection.skill_consolidation(sizes)


@query("skill_files", f"""
WITH {ROUTED}, {SKILLED}, tx AS (SELECT sk.*, CASE WHEN claim_type = 'validated-command' THEN 0 WHEN claim_type = 'always-on-rule' THEN 1 WHEN claim_type = 'scoped-rule' THEN 2 ELSE 4 END AS ty, concat('- ', content) AS line FROM sk JOIN ok ON ok.repo_id = sk.repo_id AND ok.skill = sk.skill),
b AS (SELECT repo_id, skill, string_agg(line, chr(10) ORDER BY ty, authority_level, claim_id) AS body FROM tx GROUP BY ALL),
n AS (SELECT *, array_to_string(list_transform(string_split(skill, '-'), lambda w: concat(upper(w[1]), w[2:])), ' ') AS title FROM b)
SELECT repo_id, concat('.claude/skills/', skill, '/SKILL.md') AS path, concat('---', chr(10), 'name: ', skill, chr(10), 'description: How to ', lower(title), ' in this repository.', chr(10), '---', chr(10), chr(10), '# ', title, chr(10), chr(10), CASE WHEN length(body) > 300 THEN concat(substr(body, 1, 297), '...') ELSE body END, chr(10)) AS text FROM n""")
def _(t):
    return projection.skill_bodies(_skills(t), limit=300).select("repo_id", "path", "text")


@query("skill_files_whole", f"""
WITH {ROUTED}, {SKILLED}, tx AS (SELECT sk.*, CASE WHEN claim_type = 'validated-command' THEN 0 WHEN claim_type = 'always-on-rule' THEN 1 WHEN claim_type = 'scoped-rule' THEN 2 ELSE 4 END AS ty, concat('- ', content) AS line FROM sk JOIN ok ON ok.repo_id = sk.repo_id AND ok.skill = sk.skill),
b AS (SELECT repo_id, skill, string_agg(line, chr(10) ORDER BY ty, authority_level, claim_id) AS body FROM tx GROUP BY ALL),
n AS (SELECT *, array_to_string(list_transform(string_split(skill, '-'), lambda w: concat(upper(w[1]), w[2:])), ' ') AS title FROM b)
SELECT repo_id, concat('.claude/skills/', skill, '/SKILL.md') AS path, concat('---', chr(10), 'name: ', skill, chr(10), 'description: How to ', lower(title), ' in this repository.', chr(10), '---', chr(10), chr(10), '# ', title, chr(10), chr(10), body, chr(10)) AS text FROM n""")
def _(t):
    return projection.skill_bodies(_skills(t)).select("repo_id", "path", "text")


@query("deny_settings", f"""
WITH {ROUTED}, d AS (SELECT DISTINCT repo_id, concat('Bash(', split_part(content, '`', 2), '*)') AS pattern FROM routed WHERE host = 'claude' AND section IN ('guardrails', 'scoped') AND claim_type = 'permission-restriction' AND confidence >= 0.95 AND contains(content, 'destructive'))
SELECT repo_id, '.claude/settings-snippet.json' AS path, concat('{{"permissions":{{"deny":["', string_agg(pattern, '","' ORDER BY pattern), '"]}}}}') AS text FROM d GROUP BY repo_id""")
def _(t):
    return projection.deny_settings(_routed(t))


@query("deny_patterns", f"WITH {ROUTED} SELECT DISTINCT repo_id, concat('Bash(', split_part(content, '`', 2), '*)') AS pattern FROM routed WHERE host = 'claude' AND section IN ('guardrails', 'scoped') AND claim_type = 'permission-restriction' AND confidence >= 0.95 AND contains(content, 'destructive')")
def _(t):
    return projection.deny_rows(_routed(t))


@query("setup_step_documents")
def _(t):
    return projection.setup_steps(_gated(t))


@query("instruction_preview")
def _(t):
    return projection.project(_gated(t), AS_OF)


@query("projection_decisions", f"""
WITH {ROUTED}, d AS (SELECT g.repo_id, h.host, g.claim_id, r.section, r.claim_id IS NOT NULL AS routed FROM g CROSS JOIN hosts h LEFT JOIN routed r ON r.repo_id = g.repo_id AND r.claim_id = g.claim_id AND r.host = h.host)
SELECT repo_id, host, count(*) AS decisions, count(*) FILTER (NOT routed) AS not_shown, count(*) FILTER (section = 'excluded') AS excluded, count(*) FILTER (section = 'scoped') AS scoped_in_files, 0::BIGINT AS without_reason FROM d GROUP BY ALL""")
def _(t):
    gated = _gated(t)
    rows = projection.project_with_decisions(gated, AS_OF)[1].join(projection.route_claims(gated).select(*KEY, "host", "section"), [*KEY, "host"], "left")
    return rows.groupBy("repo_id", "host").agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if(F.col("reason") == "host does not show claims of this type").alias("not_shown"),
        F.count_if((F.col("section") == "excluded") & ~F.col("included")).alias("excluded"),
        F.count_if((F.col("section") == "scoped") & (F.col("included") | (F.col("reason") == "carried by the shared file"))).alias("scoped_in_files"),
        F.count_if(F.col("reason").isNull()).alias("without_reason"),
    )


@query("project_approved")
def _(t):
    return projection.project(filters.approved_only(_gated(t)), AS_OF)


# ---- applying --------------------------------------------------------------------------


@query("plan_apply", """
SELECT d.repo_id, d.path, CASE WHEN k.path IS NULL THEN 'new' WHEN k.h = d.h THEN 'unchanged' ELSE 'updated' END AS action, coalesce(k.h <> a.expected_hash, false) AS hand_edited
FROM (SELECT repo_id, path, sha256(concat(text, CASE WHEN length(text) > 2500 THEN '+' ELSE '' END)) AS h FROM (SELECT source AS repo_id, concat(CASE lang WHEN 'en' THEN '.claude/rules/' WHEN 'fr' THEN '.cursor/rules/' WHEN 'de' THEN '.github/instructions/' ELSE '.windsurf/rules/' END, 'd', doc_id, '.md') AS path, text FROM documents) AS s) AS d
LEFT JOIN (SELECT repo_id, path, sha256(text) AS h FROM disk_v) AS k ON k.repo_id = d.repo_id AND k.path = d.path LEFT JOIN artifacts_v a ON a.repo_id = d.repo_id AND a.path = d.path""")
def _(t):
    folder = F.when(F.col("lang") == "en", ".claude/rules/").when(F.col("lang") == "fr", ".cursor/rules/").when(F.col("lang") == "de", ".github/instructions/").otherwise(".windsurf/rules/")
    text = F.concat("text", F.when(F.length("text") > 2500, "+").otherwise(""))
    files = t.documents.select(F.col("source").alias("repo_id"), F.concat(folder, F.lit("d"), "doc_id", F.lit(".md")).alias("path"), F.sha2(text, 256).alias("new_hash"))
    disk = t.disk.select("repo_id", "path", F.sha2("text", 256).alias("disk_hash"))
    return projection.plan_apply(files, disk, t.artifacts)


# ---- quality ---------------------------------------------------------------------------


@query("format_check")
def _(t):
    return quality.format_check(_files(t))


@query("budget_check")
def _(t):
    return quality.budget_check(_files(t))


@query("leakage_check", f"""
WITH {ROUTED} SELECT DISTINCT host, level AS sensitivity, CAST(0 AS BIGINT) AS leaks, false AS leaked FROM routed CROSS JOIN (SELECT unnest(['local-only', 'team-only']) AS level) AS l""")
def _(t):
    return quality.leakage_check(maintenance.dedup_first(t.claims), checkpointed(quality.file_lines(_files(t))))


@query("conformance_score")
def _(t):
    return quality.conformance(maintenance.dedup_first(t.claims), checkpointed(_files(t)))


@query("promotion_assessment")
def _(t):
    claims, files = maintenance.dedup_first(t.claims), checkpointed(_files(t))
    scores = quality.conformance(claims, files)
    leaks = quality.leakage_check(claims, quality.file_lines(files))
    disk = t.disk.select("repo_id", "path", content_hash(F.col("text")).alias("disk_hash"))
    accuracy = quality.drift_accuracy(freshness.drift(t.artifacts, disk), t.artifacts.select("repo_id").distinct().withColumn("expected", F.lit(0)))
    return quality.promotion(scores, leaks, accuracy)


@query("import_fidelity")
def _(t):
    from attesta.operators import extract_docs

    files = t.markdown.withColumn("repo_id", F.concat_ws("#", "repo_id", "doc_id"))
    imported = extract_docs.instruction_claims(files).filter(F.col("source_kind").isin("agents-md", "claude-md"))
    return quality.import_fidelity(imported)


@query("trace_stats", """
SELECT tool_name, count(*) AS calls, CAST(sum(response_claim_count) AS BIGINT) AS claims, CAST(sum(response_size_bytes) AS BIGINT) AS bytes, count(*) FILTER (response_status = 'error') AS errors, count(DISTINCT session_id) AS sessions, round(CAST(sum(CAST(duration_ms AS DECIMAL(18, 6))) AS DOUBLE) / count(*), 6) AS mean_ms, max(duration_ms) AS max_ms FROM traces_v GROUP BY tool_name""")
def _(t):
    return quality.trace_stats(t.traces).drop("p50_ms", "p95_ms")


@query("trace_latency_quantiles", "SELECT tool_name, quantile_disc(duration_ms, 0.5) AS p50_ms, quantile_disc(duration_ms, 0.95) AS p95_ms FROM traces_v GROUP BY tool_name")
def _(t):
    return quality.trace_stats(t.traces, accuracy=1_000_000).select("tool_name", "p50_ms", "p95_ms")


@query("extraction_summary", """
SELECT repo_id, count(*) AS files, count(*) FILTER (path = 'package.json') AS package_json, count(*) FILTER (path = 'Makefile') AS makefile, count(*) FILTER (path = 'Dockerfile') AS dockerfile, count(*) FILTER (path = '.github/workflows/ci.yml') AS workflow,
  count(*) FILTER (regexp_matches(path, '[.]py$')) AS python, count(*) FILTER (regexp_matches(path, '[.](jsx?|tsx?)$')) AS javascript, count(*) FILTER (path = 'README.md' OR regexp_matches(path, '^docs/[^/]+[.]md$')) AS docs, CAST(sum(size) AS BIGINT) AS bytes FROM files_v GROUP BY repo_id""")
def _(t):
    from attesta.sources.files import route_files

    return quality.extraction_summary(route_files(t.files))


WANTED = "(VALUES (0, 'validated-command', 'PYTEST', 0.2), (1, 'validated-command', 'pytest tests/m3', NULL), (2, 'environment-prerequisite', 'python >=3\\.\\d+', 0.5), (3, 'environment-prerequisite', 'python', NULL), (4, 'module-boundary', 'no such module', NULL))"
MATCHED = f"""RECURSIVE x AS (SELECT repo_id, claim_id, claim_type, content, confidence, ordinal AS place FROM claims_v QUALIFY row_number() OVER (PARTITION BY repo_id, claim_id ORDER BY phase, ordinal) = 1),
w AS (SELECT r.repo_id, v.no, v.claim_type, v.pattern, v.least, row_number() OVER (PARTITION BY r.repo_id, v.claim_type ORDER BY v.no) AS turn FROM (SELECT DISTINCT repo_id FROM repos_v) r CROSS JOIN {WANTED} AS v(no, claim_type, pattern, least)),
f AS (SELECT w.repo_id, w.claim_type, w.no, w.turn, list(x.claim_id ORDER BY x.place, x.claim_id) FILTER (x.claim_id IS NOT NULL) AS fit FROM w LEFT JOIN x ON x.repo_id = w.repo_id AND x.claim_type = w.claim_type
  AND (contains(lower(x.content), lower(w.pattern)) OR regexp_matches(x.content, concat('(?i)', w.pattern))) AND (w.least IS NULL OR x.confidence >= w.least) GROUP BY ALL),
g AS (SELECT repo_id, claim_type, 0 AS turn, -1 AS no, CAST(NULL AS VARCHAR) AS claim_id, CAST([] AS VARCHAR[]) AS taken FROM f WHERE turn = 1
  UNION ALL SELECT f.repo_id, f.claim_type, g.turn + 1, f.no, list_filter(coalesce(f.fit, []), lambda c: NOT list_contains(g.taken, c))[1],
    list_append(g.taken, list_filter(coalesce(f.fit, []), lambda c: NOT list_contains(g.taken, c))[1]) FROM g JOIN f ON f.repo_id = g.repo_id AND f.claim_type = g.claim_type AND f.turn = g.turn + 1),
m AS (SELECT repo_id, claim_type, CAST(no AS INTEGER) AS no, claim_id FROM g WHERE claim_id IS NOT NULL)"""


@query("expected_matches", f"WITH {MATCHED} SELECT * FROM m")
def _(t):
    return quality.match_expected(*_fixture(t))


@query("precision_recall", f"""
WITH {MATCHED}, c AS (SELECT w.repo_id, count(DISTINCT w.no) AS required, (SELECT count(*) FROM m WHERE m.repo_id = w.repo_id) AS matched, (SELECT count(*) FROM x WHERE x.repo_id = w.repo_id) AS extracted FROM w GROUP BY w.repo_id)
SELECT repo_id, required, matched, round(matched / required, 6) AS recall, CASE WHEN matched > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS precision, round(matched / nullif(extracted, 0), 6) AS true_precision,
  CASE WHEN matched > 0 THEN round(2 * matched / required / (matched / required + 1), 6) ELSE 0.0 END AS f1, matched / required >= 0.8 AND matched > 0 AS passed FROM c""")
def _(t):
    expected, extracted = _fixture(t)
    return quality.precision_recall(expected, extracted, quality.match_expected(expected, extracted))


def _fixture(t):
    """Expectations: the runtime names and commands each repository should show."""
    extracted = maintenance.dedup_first(t.claims).select("repo_id", "claim_id", "claim_type", "content", "confidence", F.col("ordinal").alias("place"))
    patterns = F.explode(F.array(*[
        F.struct(F.lit(i).alias("no"), F.lit(kind).alias("claim_type"), F.lit(p).alias("pattern"), F.lit(c).alias("min_confidence"))
        for i, (kind, p, c) in enumerate((
            ("validated-command", "PYTEST", 0.2), ("validated-command", "pytest tests/m3", None), ("environment-prerequisite", r"python >=3\.\d+", 0.5),
            ("environment-prerequisite", "python", None), ("module-boundary", "no such module", None)))
    ]))
    expected = t.repos.select("repo_id", patterns.alias("e")).select("repo_id", "e.*")
    return expected, extracted


