"""Documentation, instruction files, security scans and text expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta import dims
from attesta.catalog.registry import query
from attesta.functions import commands, markdown, naming, scopes, textscan
from attesta.operators import extract_docs, security

FILE = ["repo_id", "path"]


def _alias_case(expr: str, pairs) -> str:
    arms = " ".join(f"WHEN {cond.format(x=expr)} THEN '{value}'" for cond, value in pairs)
    return f"CASE {arms} END"


HEADING = "CASE " + " ".join(
    f"WHEN regexp_matches(lower({{h}}), '{'|'.join(words)}') THEN '{kind}'" for kind, words in dims.HEADING_KEYWORDS
) + " ELSE 'unknown' END"
LINES = """
l AS (SELECT doc_id, repo_id, path, unnest(parts) AS line, generate_subscripts(parts, 1) AS no, len(parts) AS total FROM (SELECT *, string_split(content, chr(10)) AS parts FROM markdown_v) AS m),
f AS (SELECT *, regexp_matches(line, '^[ \\t]*```') AS fence, coalesce(sum(CASE WHEN regexp_matches(line, '^[ \\t]*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)"""
DOC = "(path = 'README.md' OR regexp_matches(path, '^docs/[^/]*[.]md$'))"


def _docs(t):
    return t.markdown.filter((F.col("path") == "README.md") | F.col("path").rlike(r"^docs/[^/]*\.md$"))


# documents of one source share README.md, so the document is part of the file name here
def _files(t, docs=False):
    rows = _docs(t) if docs else t.markdown
    return rows.withColumn("repo_id", F.concat_ws("#", "repo_id", "doc_id"))


WORDS = "|".join(dims.DOCS_COMMAND_WORDS)


@query("docs_commands", f"""
WITH {LINES}, h AS (SELECT *, last_value(CASE WHEN NOT fence AND before % 2 = 0 AND regexp_matches(line, '^#{{1,6}}\\s+.+$') THEN trim(regexp_replace(line, '^#{{1,6}}\\s+', '')) END IGNORE NULLS) OVER w AS heading,
  last_value(CASE WHEN fence AND before % 2 = 0 THEN lower(trim(regexp_replace(line, '^[ \\t]*```', ''))) END IGNORE NULLS) OVER w AS info, max(CASE WHEN fence THEN before END) OVER (PARTITION BY doc_id) AS last_fence
  FROM f WHERE {DOC} WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
c AS (SELECT *, rtrim(regexp_replace(regexp_replace(trim(line), '^\\$ ', ''), '\\s+#.*$', '')) AS command FROM h WHERE NOT fence AND before % 2 = 1 AND before <= last_fence AND split_part(info, ' ', 1) IN ('bash', 'shell', 'sh', 'zsh', 'console', '')),
u AS (SELECT * FROM c WHERE regexp_matches(command, '^(\\$ |# )?({WORDS}) ') QUALIFY row_number() OVER (PARTITION BY doc_id, command ORDER BY no) = 1)
SELECT concat(repo_id, '#', doc_id) AS repo_id, path, command, heading, array_to_string(list_slice(string_split_regex(command, '\\s+'), 1, 2), ' ') AS command_name,
  CASE WHEN contains(lower(command), 'test') THEN 'test-execution' WHEN contains(lower(command), 'build') THEN 'build' ELSE 'safe-mutating' END AS risk_class,
  CASE WHEN contains(lower(command), 'test') THEN 'test' WHEN contains(lower(command), 'build') THEN 'build' ELSE '' END AS applicability,
  CAST(CASE WHEN path = 'README.md' THEN 0.7 ELSE 0.5 END + CASE WHEN lower(heading) = 'commands' THEN 0.2 ELSE 0 END AS DOUBLE) AS confidence FROM u""")
def _(t):
    out = extract_docs.docs_commands(_files(t, docs=True))
    return out.withColumn("applicability", F.array_join("applicability", "|")).withColumn("confidence", F.round("confidence", 6))


RULES = " UNION ALL ".join(f"SELECT {i} AS rule, '{p}' AS pat" for i, p in enumerate(dims.DOCS_RUNTIME_PATTERNS))


@query("docs_prerequisites", f"""
WITH {LINES}, r AS ({RULES}) SELECT concat(repo_id, '#', doc_id) AS repo_id, path, CAST(rule AS INT) AS rule, regexp_extract(line, pat) AS content
FROM f CROSS JOIN r WHERE {DOC} AND NOT fence AND before % 2 = 0 AND NOT regexp_matches(line, '^#{{1,6}}\\s+.+$') AND regexp_matches(line, pat)""")
def _(t):
    return extract_docs.docs_prerequisites(_files(t, docs=True))


@query("docs_prereq_claims", f"""
WITH {LINES}, r AS ({RULES}) SELECT DISTINCT concat(repo_id, '#', doc_id) AS repo_id, path, 'environment-prerequisite' AS claim_type, regexp_extract(line, pat) AS content, 'checked-in-docs' AS source_authority, CAST(0.7 AS DOUBLE) AS confidence
FROM f CROSS JOIN r WHERE {DOC} AND NOT fence AND before % 2 = 0 AND NOT regexp_matches(line, '^#{{1,6}}\\s+.+$') AND regexp_matches(line, pat)""")
def _(t):
    return extract_docs.docs_prereq_claims(extract_docs.docs_prerequisites(_files(t, docs=True)))


SECTIONS = f"""
s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,6}}[ \\t]+.+$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS sec FROM f),
sections AS (SELECT doc_id, repo_id, path, sec, min(no) AS line_start, max(no) AS line_end,
  coalesce(max(CASE WHEN regexp_matches(line, '^#{{1,6}}[ \\t]+.+$') THEN trim(regexp_replace(line, '^#{{1,6}}[ \\t]+', '')) END), '') AS heading,
  coalesce(max(CASE WHEN regexp_matches(line, '^#{{1,6}}[ \\t]+.+$') THEN length(regexp_extract(line, '^#+')) END), 0) AS level,
  regexp_replace(coalesce(string_agg(CASE WHEN NOT regexp_matches(line, '^#{{1,6}}[ \\t]+.+$') THEN line END, chr(10) ORDER BY no), ''), '^\\s+|\\s+$', '', 'g') AS body FROM s GROUP BY ALL)"""


@query("markdown_sections", f"""
WITH {LINES}, {SECTIONS} SELECT doc_id, heading, CAST(level AS INT) AS level, {HEADING.format(h='heading')} AS section_type, sha256(body) AS body_hash, CAST(line_start AS INT) AS line_start, CAST(line_end AS INT) AS line_end FROM sections WHERE heading <> '' OR body <> ''""")
def _(t):
    out = extract_docs.sections(t.markdown)
    return out.select("doc_id", "heading", "level", "section_type", F.sha2("body", 256).alias("body_hash"), "line_start", "line_end")


@query("code_blocks", f"""
WITH {LINES}, o AS (SELECT *, lead(no) OVER (PARTITION BY doc_id ORDER BY no) AS stop FROM f WHERE fence),
b AS (SELECT * FROM o WHERE before % 2 = 0 AND stop IS NOT NULL)
SELECT b.doc_id, split_part(trim(regexp_replace(b.line, '^[ \\t]*```', '')), ' ', 1) AS language, coalesce(string_agg(x.line, chr(10) ORDER BY x.no), '') AS block, CAST(b.no AS INT) AS line_start, CAST(b.stop AS INT) AS line_end
FROM b LEFT JOIN f x ON x.doc_id = b.doc_id AND x.no > b.no AND x.no < b.stop GROUP BY b.doc_id, b.line, b.no, b.stop""")
def _(t):
    return extract_docs.code_blocks(t.markdown).select("doc_id", "language", "block", "line_start", "line_end")


ITEMS = """
sl AS (SELECT *, unnest(string_split(body, chr(10))) AS bline, generate_subscripts(string_split(body, chr(10)), 1) AS bno FROM sections),
m AS (SELECT *, regexp_matches(bline, '^[ \\t]*([-*+]|\\d+[.)])[ \\t]+.+$') AS starts, regexp_matches(bline, '^\\s*$') AS blank FROM sl),
k AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER w AS item_no, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER w AS gaps FROM m WINDOW w AS (PARTITION BY doc_id, sec ORDER BY bno)),
h AS (SELECT doc_id, sec, item_no, gaps AS first_gap, regexp_replace(bline, '^\\s*([-*+]|\\d+[.)])\\s+', '') AS head FROM k WHERE starts),
items AS (SELECT h.doc_id, h.sec, h.item_no, trim(concat_ws(' ', h.head, nullif(coalesce(string_agg(CASE WHEN NOT k.starts AND regexp_matches(k.bline, '^\\s{2,}\\S.+$') THEN regexp_replace(k.bline, '^\\s+', '') END, ' ' ORDER BY bno), ''), ''))) AS item
  FROM h JOIN k ON k.doc_id = h.doc_id AND k.sec = h.sec AND k.item_no = h.item_no AND k.gaps = h.first_gap GROUP BY h.doc_id, h.sec, h.item_no, h.head)"""


@query("bullet_items", f"WITH {LINES}, {SECTIONS}, {ITEMS} SELECT i.doc_id, heading, CAST(i.item_no - 1 AS INT) AS item_no, item FROM items i JOIN sections s ON s.doc_id = i.doc_id AND s.sec = i.sec")
def _(t):
    return extract_docs.bullet_items(extract_docs.sections(t.markdown)).select("doc_id", "heading", "item_no", "item")


@query("instruction_claims")
def _(t):
    out = extract_docs.instruction_claims(_files(t))
    return out.withColumn("applicability", F.array_join("applicability", "|"))


@query("unparseable_sections")
def _(t):
    return extract_docs.unparseable_sections(_files(t))


@query("file_references", "SELECT DISTINCT concat(repo_id, '#', doc_id) AS repo_id, path, unnest(regexp_extract_all(content, '@([\\w./\\-]+(?:\\.\\w+)?)', 1)) AS reference FROM markdown_v")
def _(t):
    return extract_docs.file_references(_files(t))


@query("frontmatter", """
SELECT doc_id, concat('notes on ', repo_id) AS description, CASE WHEN split_part(split_part(content, 'globs: ', 2), chr(10), 1) = 'en/**' THEN 'true' ELSE 'false' END AS always_apply, split_part(split_part(content, 'globs: ', 2), chr(10), 1) AS globs,
  sha256(substr(content, strpos(content, '# Project '))) AS body_hash FROM markdown_v""")
def _(t):
    head = markdown.frontmatter(F.col("content"))
    return t.markdown.select(
        "doc_id", F.try_element_at(head, F.lit("description")).alias("description"), F.try_element_at(head, F.lit("alwaysApply")).alias("always_apply"),
        F.try_element_at(head, F.lit("globs")).alias("globs"), F.sha2(markdown.body_after_frontmatter(F.col("content")), 256).alias("body_hash"))


@query("heading_types", f"""WITH {LINES} SELECT doc_id, CAST(no AS INT) AS no, {HEADING.format(h='line')} AS kind FROM f WHERE starts_with(line, '#')""")
def _(t):
    lines = t.markdown.select("doc_id", F.posexplode(F.split("content", "\n")).alias("no", "line")).filter("startswith(line, '#')")
    return lines.select("doc_id", (F.col("no") + 1).alias("no"), markdown.heading_type(F.col("line")).alias("kind"))


@query("line_predicates", f"""
WITH {LINES} SELECT doc_id, CAST(no AS INT) AS no,
  trim(line) = '' OR regexp_matches(trim(line), '{"|".join(dims.GENERIC_PROSE)}') AS generic,
  regexp_matches(trim(line), '{dims.PROMPT_LINE}') OR regexp_matches(trim(line), '{dims.CLI_LINE}') AS command_like,
  regexp_matches(line, '{dims.DIRECTIVE_LINE.replace("'", "''")}') AS directive FROM f WHERE trim(line) <> ''""")
def _(t):
    line = F.col("line")
    lines = t.markdown.select("doc_id", F.posexplode(F.split("content", "\n")).alias("no", "line")).filter(F.trim("line") != "")
    return lines.select("doc_id", (F.col("no") + 1).alias("no"), markdown.is_generic_prose(line).alias("generic"), markdown.is_command_like(line).alias("command_like"), markdown.is_directive(line).alias("directive"))


# ---- names -----------------------------------------------------------------------------

STYLE = """CASE WHEN length(ltrim(name, '_')) < 2 THEN NULL WHEN regexp_full_match(ltrim(name, '_'), '[a-z][a-z0-9]*(_[a-z0-9]+)*') THEN 'snake_case' WHEN regexp_full_match(ltrim(name, '_'), '[A-Z][A-Z0-9]*(_[A-Z0-9]+)*') THEN 'SCREAMING_SNAKE'
  WHEN regexp_full_match(ltrim(name, '_'), '[a-z][a-zA-Z0-9]*') THEN 'camelCase' WHEN regexp_full_match(ltrim(name, '_'), '[A-Z][a-zA-Z0-9]*') THEN 'PascalCase' END"""


@query("classify_names", f"SELECT name, {STYLE} AS style, count(*) AS uses FROM names_v GROUP BY name")
def _(t):
    uses = t.names.groupBy("name").agg(F.count(F.lit(1)).alias("uses"))
    return uses.select("name", naming.classify_name(F.col("name")).alias("style"), "uses")


# ---- security --------------------------------------------------------------------------

MARKERS = " UNION ALL ".join(f"SELECT {i} AS rule, '{p}' AS pat, '{s}' AS base" for i, (p, s) in enumerate(dims.INJECTION_MARKERS))
# the pieces before the k-th match give its line
HITS = """
hit AS (SELECT d.*, r.*, unnest(regexp_extract_all({text}, pat)) AS marker, generate_subscripts(regexp_extract_all({text}, pat), 1) AS k, string_split_regex({text}, pat) AS pieces, regexp_extract_all({text}, pat) AS marks FROM {src} d CROSS JOIN r WHERE regexp_matches({text}, pat)),
loc AS (SELECT *, CAST(1 + list_sum(list_transform(list_slice(pieces, 1, k), lambda x: length(x) - length(replace(x, chr(10), '')))) + coalesce(list_sum(list_transform(list_slice(marks, 1, k - 1), lambda x: length(x) - length(replace(x, chr(10), '')))), 0) AS INT) AS line FROM hit),
fen AS (SELECT *, string_split({text}, chr(10)) AS ls FROM loc),
inj AS (SELECT *, len(list_filter(list_slice(ls, 1, line - 1), lambda x: regexp_matches(x, '^\\s*```'))) % 2 = 1 OR regexp_matches(ls[line], '^\\s*```') AS fenced FROM fen),
found AS (SELECT *, CASE WHEN NOT fenced THEN base WHEN base = 'high' THEN 'medium' ELSE 'low' END AS severity, CASE WHEN length(ls[line]) > 120 THEN concat(substr(ls[line], 1, 120), '...') ELSE ls[line] END AS context FROM inj)"""


@query("scan_injection", f"WITH r AS ({MARKERS}), {HITS.format(text='content', src='markdown_v')} SELECT doc_id, CAST(rule AS INT) AS no, marker, line, severity, fenced AS in_code_block, context FROM found")
def _(t):
    return security.scan_injection(t.markdown.select("doc_id", "content"), "content").select("doc_id", "no", "marker", "line", "severity", "in_code_block", "context")


@query("max_injection_severity", f"WITH r AS ({MARKERS}), {HITS.format(text='content', src='markdown_v')} SELECT repo_id, arg_min(severity, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS worst, count(*) AS findings FROM found GROUP BY repo_id")
def _(t):
    found = security.scan_injection(t.markdown.select("doc_id", "repo_id", "content"), "content")
    return security.max_injection_severity(found, ["repo_id"])


@query("scan_output_injection", f"""
WITH r AS ({MARKERS}), cells AS (SELECT doc_id, 'content' AS field, content AS cell FROM markdown_v UNION ALL SELECT doc_id, 'path', path FROM markdown_v),
{HITS.format(text='cell', src='cells')} SELECT doc_id, field, line, concat('potential injection marker (', marker, ') at ', field) AS warning FROM found WHERE severity <> 'low'""")
def _(t):
    return security.scan_output(t.markdown, ["doc_id"], ["content", "path"])


LEGACY = " UNION ALL ".join(f"SELECT {i} AS rule, '{p}' AS pat" for i, p in enumerate(dims.LEGACY_MARKERS))


@query("legacy_markers", f"WITH r AS ({LEGACY}) SELECT doc_id, CAST(rule AS INT) AS no, regexp_extract(content, pat) AS marker FROM markdown_v CROSS JOIN r WHERE regexp_matches(content, pat)")
def _(t):
    return security.legacy_markers(t.markdown.select("doc_id", "content"), "content")


SECRETS = " UNION ALL ".join(
    f"SELECT {i} AS rule, '{p.replace(chr(39), chr(39) * 2)}' AS pat, '{label}' AS label, {g} AS grp"
    for i, (p, label, g) in enumerate([*dims.SECRET_PATTERNS, (dims.ASSIGNED_VALUE, dims.ENTROPY_LABEL, 1)])
)
ENTROPY = "-list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: (length({v}) - length(replace({v}, c, ''))) / length({v}) * log2((length({v}) - length(replace({v}, c, ''))) / length({v}))))"
_SECRET_ROWS = f"""
r AS ({SECRETS}),
g0 AS (SELECT d.*, r.*, regexp_extract_all(text, pat) AS marks, string_split_regex(text, pat) AS pieces, CASE WHEN grp = 1 THEN regexp_extract_all(text, pat, 1) ELSE regexp_extract_all(text, pat) END AS vals FROM @src@ d CROSS JOIN r WHERE regexp_matches(text, pat)),
g1 AS (SELECT *, unnest(marks) AS mark, unnest(vals) AS val, generate_subscripts(marks, 1) AS k FROM g0),
g2 AS (SELECT *, list_sum(list_transform(list_slice(pieces, 1, k), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(marks, 1, k - 1), lambda x: length(x))), 0) AS start,
  CAST(1 + list_sum(list_transform(list_slice(pieces, 1, k), lambda x: length(x) - length(replace(x, chr(10), '')))) + coalesce(list_sum(list_transform(list_slice(marks, 1, k - 1), lambda x: length(x) - length(replace(x, chr(10), '')))), 0) AS INT) AS line FROM g1),
g3 AS (SELECT *, start + length(mark) AS stop FROM g2 WHERE label <> '{dims.ENTROPY_LABEL}' OR (NOT regexp_matches(val, '{dims.COMMIT_SHAPE}') AND NOT regexp_matches(val, '{dims.UUID_SHAPE}') AND {ENTROPY.format(v='val')} > 4.5)),
secrets AS (SELECT *, concat(CASE WHEN length(val) > 8 THEN substr(val, 1, 4) ELSE '' END, '...REDACTED') AS mask FROM g3 QUALIFY row_number() OVER (PARTITION BY @key@, start, stop ORDER BY rule) = 1)"""


def _secret_rows(src: str, key: str) -> str:
    return _SECRET_ROWS.replace("@src@", src).replace("@key@", key)


# texts with further assignments, taken from the token each document carries
CONFIG_TEXT = """(SELECT doc_id, source AS repo_id, concat(text, chr(10), 'pass', 'word = "', sha256(source), upper(substr(sha256(text), 1, 12)), '!?"', chr(10),
  CASE WHEN lang = 'fr' THEN concat('postgres', '://app:', substr(sha256(text), 1, 9), '@db.', source, '/x') WHEN lang = 'de' THEN concat('AK', 'IA', upper(substr(sha256(text), 1, 16))) WHEN lang = 'es' THEN concat('auth_to', 'ken: ', sha256(source)) ELSE '' END) AS text FROM documents) AS"""


def _config_texts(t):
    digest = F.sha2("text", 256)
    extra = (
        F.when(F.col("lang") == "fr", F.concat(F.lit("postgres" + "://app:"), F.substring(digest, 1, 9), F.lit("@db."), F.col("source"), F.lit("/x")))
        .when(F.col("lang") == "de", F.concat(F.lit("AK" + "IA"), F.upper(F.substring(digest, 1, 16))))
        .when(F.col("lang") == "es", F.concat(F.lit("auth_to" + "ken: "), F.sha2("source", 256)))
        .otherwise("")
    )
    line = F.concat(F.lit("pass" + "word = \""), F.sha2("source", 256), F.upper(F.substring(digest, 1, 12)), F.lit("!?\""))
    return t.documents.select("doc_id", F.col("source").alias("repo_id"), F.concat("text", F.lit("\n"), line, F.lit("\n"), extra).alias("text"))


@query("scan_secrets", f"WITH {_secret_rows(src=CONFIG_TEXT, key='doc_id')} SELECT doc_id, label AS pattern_type, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop, line, sha256(val) AS value_hash, replace(string_split(text, chr(10))[line], val, mask) AS redacted_context FROM secrets")
def _(t):
    found = security.scan_secrets(_config_texts(t), ["doc_id"])
    return found.select("doc_id", "pattern_type", "start", "stop", "line", F.sha2("value", 256).alias("value_hash"), "redacted_context")


@query("scan_secrets_all_texts", f"WITH {_secret_rows(src='texts_v', key='text_id')} SELECT text_id, label AS pattern_type, CAST(start AS INT) AS start, line, sha256(val) AS value_hash FROM secrets")
def _(t):
    found = security.scan_secrets(t.texts, ["text_id"])
    return found.select("text_id", "pattern_type", "start", "line", F.sha2("value", 256).alias("value_hash"))


@query("file_security_warnings", f"""
SELECT m.doc_id, m.repo_id, coalesce(i.n, 0) AS injections, coalesce(s.n, 0) AS secrets FROM markdown_v m
LEFT JOIN (WITH r AS ({MARKERS}), {HITS.format(text='content', src='markdown_v')} SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id) i ON i.doc_id = m.doc_id
LEFT JOIN (WITH {_secret_rows(src="(SELECT doc_id, repo_id, content AS text FROM markdown_v) AS", key='doc_id')} SELECT doc_id, count(*) AS n FROM secrets GROUP BY doc_id) s ON s.doc_id = m.doc_id""")
def _(t):
    return security.security_warnings(t.markdown.select("doc_id", "repo_id", F.col("content").alias("text")), ["doc_id", "repo_id"])


@query("security_scan_claims", f"""
WITH {_secret_rows(src=CONFIG_TEXT, key='doc_id')}, v AS (SELECT DISTINCT doc_id, val, mask FROM secrets),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(val) DESC, val) AS rn FROM v),
p AS (SELECT doc_id, max(CASE WHEN rn = 1 THEN val END) AS v1, max(CASE WHEN rn = 1 THEN mask END) AS m1, max(CASE WHEN rn = 2 THEN val END) AS v2, max(CASE WHEN rn = 2 THEN mask END) AS m2, max(CASE WHEN rn = 3 THEN val END) AS v3, max(CASE WHEN rn = 3 THEN mask END) AS m3, max(rn) AS n FROM n GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN p.n > 0 THEN 'local-only' ELSE 'public' END AS sensitivity, 'unreviewed' AS review_state,
  sha256(replace(replace(CASE WHEN v1 IS NULL THEN d.text ELSE replace(d.text, v1, m1) END, coalesce(v2, '~~'), coalesce(m2, '~~')), coalesce(v3, '~~'), coalesce(m3, '~~'))) AS content_hash
FROM {CONFIG_TEXT} d LEFT JOIN p ON p.doc_id = d.doc_id""")
def _(t):
    claims = _config_texts(t).select("doc_id", F.col("text").alias("content"), F.lit("public").alias("sensitivity"), F.lit("unreviewed").alias("review_state"))
    out = security.security_scan_claims(claims)
    return out.select("doc_id", "sensitivity", "review_state", F.sha2("content", 256).alias("content_hash"))


@query("shannon_entropy", f"SELECT doc_id, CAST(no AS INT) AS no, round({ENTROPY.format(v='w')}, 6) AS bits FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS no FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]{{12,}}') AS ws FROM documents) AS a) AS b")
def _(t):
    words = t.documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[a-z]{12,}"), F.lit(0))).alias("no", "w"))
    return words.select("doc_id", (F.col("no") + 1).alias("no"), F.round(textscan.shannon_entropy(F.col("w")), 6).alias("bits"))


@query("sanitize_arguments", """
SELECT doc_id, CASE WHEN length(c) > 200 THEN concat(substr(c, 1, 100), '... (', length(c), ' chars)') ELSE c END AS argument
FROM (SELECT doc_id, replace(text, source, CASE WHEN length(source) > 8 THEN concat(substr(source, 1, 4), '...REDACTED') ELSE '...REDACTED' END) AS c FROM documents) AS d""")
def _(t):
    return t.documents.select("doc_id", textscan.sanitize_argument(F.col("text"), F.array("source")).alias("argument"))


# ---- commands and scopes as expressions over the claims table ---------------------------

CMD = "claim_type = 'validated-command'"


@query("command_keys", f"SELECT ordinal, CASE WHEN split_part(content, ' ', 1) IN ('npm', 'yarn', 'pnpm', 'make', 'docker') AND contains(content, ' ') THEN concat(split_part(content, ' ', 1), ' ', split_part(content, ' ', 2)) ELSE split_part(content, ' ', 1) END AS command_key FROM claims_v WHERE {CMD}")
def _(t):
    return t.claims.filter(CMD).select("ordinal", commands.command_key(F.col("content")).alias("command_key"))


@query("command_risks", f"""
SELECT ordinal, CASE WHEN regexp_matches(content, 'test|pytest|jest|vitest|mocha') THEN 'test-execution' WHEN regexp_matches(content, 'lint|check|ruff|eslint|pyright|mypy') THEN 'safe-readonly' WHEN regexp_matches(content, 'format|fmt|prettier') THEN 'safe-mutating'
  WHEN regexp_matches(content, 'build|compile|tsc') THEN 'build' WHEN regexp_matches(content, 'deploy|publish|release') THEN 'destructive' ELSE 'build' END AS ci_risk,
  CASE WHEN contains(content, 'test') THEN 'test-execution' WHEN regexp_matches(content, 'lint|check') THEN 'safe-readonly' WHEN contains(content, 'format') THEN 'safe-mutating' WHEN contains(content, 'build') THEN 'build' ELSE 'safe-mutating' END AS docs_risk,
  CASE WHEN contains(content, 'test') THEN 'test' WHEN regexp_matches(content, 'lint|check|ruff') THEN 'lint' WHEN contains(content, 'build') THEN 'build' ELSE '' END AS docs_tags,
  CASE risk_class WHEN 'test-execution' THEN 'test' WHEN 'safe-readonly' THEN 'lint' WHEN 'safe-mutating' THEN 'format' WHEN 'build' THEN 'build' ELSE 'ci|release' END AS risk_tags
FROM claims_v WHERE {CMD}""")
def _(t):
    text = F.col("content")
    return t.claims.filter(CMD).select(
        "ordinal", commands.risk_of_ci_command(text).alias("ci_risk"), commands.risk_of_docs_command(text).alias("docs_risk"),
        F.array_join(commands.tags_for_docs_command(text), "|").alias("docs_tags"), F.array_join(commands.tags_for_risk(F.col("risk_class")), "|").alias("risk_tags"))


@query("normalized_commands", f"""
SELECT ordinal, trim(regexp_replace(trim(split_part(c, '|', 1)), '\\s*>.*$', '')) AS ci_form, rtrim(regexp_replace(regexp_replace(trim(d), '^\\$ ', ''), '\\s+#.*$', '')) AS docs_form, regexp_matches(trim(d), '^(\\$ |# )?({WORDS}) ') AS operational
FROM (SELECT ordinal, concat('  ', content, CASE WHEN stale THEN ' 2>&1 | tee x' ELSE ' > out.txt' END) AS c, concat(CASE WHEN stale THEN '$ ' ELSE '' END, content, '  # ', scope) AS d FROM claims_v WHERE {CMD}) AS x""")
def _(t):
    c = F.concat(F.lit("  "), "content", F.when(F.col("stale"), " 2>&1 | tee x").otherwise(" > out.txt"))
    d = F.concat(F.when(F.col("stale"), "$ ").otherwise(""), "content", F.lit("  # "), "scope")
    return t.claims.filter(CMD).select("ordinal", commands.normalize_ci_command(c).alias("ci_form"), commands.normalize_docs_command(d).alias("docs_form"), commands.is_operational(d).alias("operational"))


@query("scope_expressions", """
SELECT ordinal, CASE WHEN scope = '**' THEN 'general' ELSE replace(scope, '/', '-') END AS scope_key, CASE WHEN scope = '**' THEN '**' ELSE concat(scope, '/**') END AS scope_glob,
  CASE WHEN contains(content, '`') THEN concat('Bash(', split_part(content, '`', 2), '*)') END AS deny_pattern,
  coalesce(list_filter(applicability, lambda x: x <> 'all')[1], 'general') AS primary_tag,
  CASE coalesce(list_filter(applicability, lambda x: x <> 'all')[1], 'general') WHEN 'test' THEN 'validate-and-test' WHEN 'ci' THEN 'ci-workflow' WHEN 'lint' THEN 'code-quality' WHEN 'onboarding' THEN 'getting-started' ELSE 'general' END AS skill,
  confidence >= 0.9 AND authority_level <= 30 AS high_value FROM claims_v""")
def _(t):
    tag = scopes.primary_tag(F.col("applicability"))
    return t.claims.select(
        "ordinal", scopes.scope_key(F.col("scope")).alias("scope_key"), scopes.scope_glob(F.col("scope")).alias("scope_glob"), scopes.deny_pattern(F.col("content")).alias("deny_pattern"),
        tag.alias("primary_tag"), scopes.skill_name(tag).alias("skill"), scopes.high_value(F.col("confidence"), F.col("source_authority")).alias("high_value"))


@query("imported_command_tags", f"""
SELECT ordinal, CASE WHEN t = '' THEN 'all' ELSE t END AS tags FROM (SELECT ordinal, concat_ws('|', CASE WHEN regexp_matches(content, 'test') THEN 'test' END, CASE WHEN regexp_matches(content, 'lint|ruff') THEN 'lint' END, CASE WHEN contains(content, 'build') THEN 'build' END) AS t FROM claims_v WHERE {CMD}) AS x""")
def _(t):
    return t.claims.filter(CMD).select("ordinal", F.array_join(commands.tags_for_imported_command(F.col("content")), "|").alias("tags"))
