"""Symbols, conventions and module graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.catalog.registry import query
from attesta.catalog.text import STYLE
from attesta.functions.base import percent_text
from attesta.functions.scopes import dotted_module, import_candidate
from attesta.operators import conventions, extract_code, graph
from attesta.session import checkpointed

KIND = "CASE WHEN regexp_matches(name, '^[a-z]') THEN 'function' ELSE 'class' END"
PERCENT = "concat(CAST(round_even({x} * 100, 0) AS BIGINT), '%')"
BUCKETS = "CASE WHEN {c} >= 0.95 THEN 'always-on-rule' ELSE 'scoped-rule' END AS claim_type, CASE WHEN {c} >= 0.95 THEN 'inferred-high' ELSE 'inferred-low' END AS source_authority, CASE WHEN {c} >= 0.95 THEN 'unreviewed' ELSE 'needs-declaration' END AS review_state, round({c}, 4) AS confidence"


# ---- naming over the words of the documents --------------------------------------------


def _stats(keys: str, source: str) -> str:
    return f"""(SELECT {keys}, CAST(sum(n) AS BIGINT) AS total, count(*) AS styles, arg_min(style, (-n, doc_id, pos)) AS dominant, max(n) / sum(n) AS consistency
  FROM (SELECT {keys}, {STYLE} AS style, count(*) AS n, arg_min(doc_id, (doc_id, pos)) AS doc_id, arg_min(pos, (doc_id, pos)) AS pos FROM {source} GROUP BY ALL) AS s WHERE style IS NOT NULL GROUP BY {keys})"""


KINDED = f"(SELECT *, {KIND} AS kind, concat('m', lower(substr(name, 1, 1))) AS module FROM names_v)"


def _kinded(t):
    name = F.col("name")
    return t.names.withColumn("kind", F.when(name.rlike("^[a-z]"), "function").otherwise("class")).withColumn(
        "module", F.concat(F.lit("m"), F.lower(F.substring(name, 1, 1))))


@query("naming_stats", f"SELECT repo_id, kind, total, styles, dominant, round(consistency, 6) AS consistency FROM {_stats('repo_id, kind', KINDED)} AS x")
def _(t):
    return conventions.naming_stats(_kinded(t), ["repo_id", "kind"], ["doc_id", "pos"]).withColumn("consistency", F.round("consistency", 6))


TEXT = f"concat('Use ', dominant, ' for ', kind, ' names (', {PERCENT.format(x='consistency')}, ' consistency across ', total, ' identifiers)') AS content"


@query("naming_conventions", f"SELECT repo_id, kind, {TEXT}, {BUCKETS.format(c='consistency')}, 'all' AS tag FROM {_stats('repo_id, kind', KINDED)} AS x WHERE total >= 20 AND consistency >= 0.8 AND NOT (repo_id IN (SELECT source FROM documents WHERE lang = 'es' AND n_chars > 9000) AND kind = 'function' AND dominant = 'snake_case')")
def _(t):
    stats = conventions.naming_stats(_kinded(t), ["repo_id", "kind"], ["doc_id", "pos"])
    formatted = t.documents.filter("lang = 'es' AND n_chars > 9000").select(F.col("source").alias("repo_id"))
    return conventions.naming_conventions(stats, formatted)


@query("scoped_conventions", f"""
SELECT m.repo_id, m.module, m.kind, concat('Use ', m.dominant, ' for ', m.kind, ' names (', {PERCENT.format(x='m.consistency')}, ' consistency across ', m.total, ' identifiers)') AS content, 'scoped-rule' AS claim_type,
  CASE WHEN m.consistency >= 0.95 THEN 'inferred-high' ELSE 'inferred-low' END AS source_authority, CASE WHEN m.consistency >= 0.95 THEN 'unreviewed' ELSE 'needs-declaration' END AS review_state, round(m.consistency, 4) AS confidence, 'all' AS tag
FROM {_stats("repo_id, module, kind", "(SELECT *, concat('m', substr(name, 1, 1)) AS module, 'mixed' AS kind FROM names_v)")} AS m
JOIN {_stats("repo_id, kind", "(SELECT *, 'mixed' AS kind FROM names_v)")} AS r ON r.repo_id = m.repo_id AND r.kind = m.kind WHERE m.total >= 20 AND m.consistency >= 0.8 AND m.dominant <> r.dominant""")
def _(t):
    words = _kinded(t).withColumn("kind", F.lit("mixed")).withColumn("module", F.concat(F.lit("m"), F.substring("name", 1, 1)))
    by_module = conventions.naming_stats(words, ["repo_id", "module", "kind"], ["doc_id", "pos"])
    by_repo = conventions.naming_stats(words, ["repo_id", "kind"], ["doc_id", "pos"])
    return conventions.scoped_conventions(by_module, by_repo)


@query("percent_texts", f"SELECT p_partkey, {PERCENT.format(x='(p_size / 80.0::DOUBLE)')} AS shown FROM part")
def _(t):
    return t.part.select("p_partkey", percent_text(F.col("p_size") / 80).alias("shown"))


# ---- symbols of Python files -----------------------------------------------------------

WORD = "replace(p_name, ' ', '_')"
BROKEN = "p_retailprice > 1090"
TEST = "p_size % 3 = 0"
SYMBOLS = f"""
(SELECT p.repo_id, p.path, u.kind, u.name, u.level, u.returns, u.params, u.annotated, u.doc, {BROKEN} AS has_errors, p_size FROM part JOIN python_code_v p USING (p_partkey), LATERAL (VALUES
  ('import', concat('shop.brand', p_size % 25 + 1), 0, NULL, NULL, NULL, NULL), ('import', concat('shop.', replace(lower(p_brand), '#', ''), '.', lower(p_type)), 0, NULL, NULL, NULL, NULL),
  ('import', CASE WHEN p_size > 25 THEN '' ELSE 'core' END, CASE WHEN p_size > 25 THEN 1 ELSE 2 END, NULL, NULL, NULL, NULL), ('import', 'os', 0, NULL, NULL, NULL, NULL),
  ('constant', CASE WHEN NOT {BROKEN} THEN 'LIMIT' END, NULL, NULL, NULL, NULL, NULL),
  ('function', concat('make_', {WORD}), NULL, true, 2, 1, true), ('class', concat('Box', p_size), NULL, NULL, NULL, NULL, false), ('function', 'run', NULL, false, 1, 0, false),
  ('function', CASE WHEN {TEST} THEN concat('test_', p_size) END, NULL, false, 0, 0, false), ('function', CASE WHEN {BROKEN} THEN 'broken' END, NULL, NULL, NULL, NULL, NULL)) AS u(kind, name, level, returns, params, annotated, doc) WHERE u.name IS NOT NULL)"""


def _symbols(t):
    return extract_code.python_symbols(t.python_code)


@query("python_symbols", f"SELECT repo_id, path, kind, name, CASE WHEN has_errors AND kind <> 'import' THEN 0 ELSE level END AS level, CASE WHEN NOT has_errors THEN returns END AS returns, CASE WHEN NOT has_errors THEN params END AS params, CASE WHEN NOT has_errors THEN annotated END AS annotated, has_errors FROM {SYMBOLS} AS s")
def _(t):
    return _symbols(t).select("repo_id", "path", "kind", "name", "level", "returns", "params", "annotated", "has_errors")


@query("test_placement", f"""
SELECT repo_id, count(*) AS total, CASE WHEN a >= c THEN 'tests/ directory' ELSE 'co-located test files' END AS dominant, round(greatest(a, c) / count(*), 6) AS share
FROM (SELECT repo_id, path, count(*) FILTER (starts_with(path, 'tests/')) OVER (PARTITION BY repo_id) AS a, count(*) FILTER (NOT starts_with(path, 'tests/')) OVER (PARTITION BY repo_id) AS c FROM (SELECT DISTINCT repo_id, path FROM {SYMBOLS} AS s WHERE kind = 'function' AND starts_with(name, 'test_')) AS d) AS x GROUP BY repo_id, a, c""")
def _(t):
    tests = _symbols(t).filter("is_test").select("repo_id", "path").distinct()
    return conventions.test_placement(tests).withColumn("share", F.round("share", 6))


@query("import_style", f"""
SELECT repo_id, count(*) AS total, CASE WHEN count(*) FILTER (level = 0) >= count(*) FILTER (level > 0) THEN 'absolute imports' ELSE 'relative imports' END AS dominant, round(greatest(count(*) FILTER (level = 0), count(*) FILTER (level > 0)) / count(*), 6) AS share
FROM {SYMBOLS} AS s WHERE kind = 'import' GROUP BY repo_id HAVING count(*) >= 20""")
def _(t):
    return conventions.import_style(_symbols(t).filter("kind = 'import'")).withColumn("share", F.round("share", 6))


#: functions of broken files, tests and runners stand under a key of their own, so both sides of a limit occur
SPLIT = "concat(repo_id, CASE WHEN has_errors OR name = 'run' OR starts_with(name, 'test_') THEN '-rest' ELSE '' END)"
RATIOS = f"(SELECT {SPLIT} AS repo_id, count(*) AS functions, count(*) FILTER (returns AND NOT has_errors) AS with_return, CAST(sum(CASE WHEN has_errors THEN 0 ELSE coalesce(params, 0) END) AS BIGINT) AS params, CAST(sum(CASE WHEN has_errors THEN 0 ELSE coalesce(annotated, 0) END) AS BIGINT) AS annotated FROM {SYMBOLS} AS s WHERE kind = 'function' GROUP BY ALL)"


def _functions(t):
    rest = F.col("has_errors") | (F.col("name") == "run") | F.col("name").startswith("test_")
    return _symbols(t).filter("kind = 'function'").withColumn("repo_id", F.concat("repo_id", F.when(rest, "-rest").otherwise("")))


@query("annotation_ratios", f"SELECT *, round(with_return / functions, 6) AS return_ratio, round(coalesce(annotated / nullif(params, 0), 0), 6) AS param_ratio FROM {RATIOS} AS r")
def _(t):
    out = conventions.annotation_ratios(_functions(t))
    return out.withColumn("return_ratio", F.round("return_ratio", 6)).withColumn("param_ratio", F.round("param_ratio", 6))


@query("annotation_claims", f"""
SELECT repo_id, concat('Use return type annotations on functions (', {PERCENT.format(x='with_return / functions')}, ' of ', functions, ' functions annotated)') AS content, {BUCKETS.format(c='(with_return / functions)')}, 'all' AS tag
FROM {RATIOS} AS r WHERE functions >= 20 AND with_return / functions >= 0.8""")
def _(t):
    return conventions.annotation_claims(conventions.annotation_ratios(_functions(t)))


DOCS = f"(SELECT repo_id, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind = 'function' AND doc AND NOT has_errors) AS functions_with, count(*) FILTER (kind = 'class') AS classes, CAST(0 AS BIGINT) AS classes_with FROM {SYMBOLS} AS s GROUP BY repo_id)"


@query("docstring_ratios", f"SELECT *, round(functions_with / functions, 6) AS function_ratio, 0.0::DOUBLE AS class_ratio FROM {DOCS} AS d")
def _(t):
    return conventions.docstring_ratios(_symbols(t)).withColumn("function_ratio", F.round("function_ratio", 6))


MADE = f"(SELECT concat(repo_id, CASE WHEN starts_with(name, 'make_') THEN '' ELSE '-rest' END) AS repo_id, count(*) AS functions, count(*) FILTER (doc AND NOT has_errors) AS functions_with FROM {SYMBOLS} AS s WHERE kind = 'function' GROUP BY ALL)"


@query("docstring_claims", f"SELECT repo_id, concat('Include docstrings on functions (', {PERCENT.format(x='functions_with / functions')}, ' of functions have docstrings)') AS content, {BUCKETS.format(c='(functions_with / functions)')}, 'all' AS tag FROM {MADE} AS m WHERE functions >= 20 AND functions_with / functions >= 0.8")
def _(t):
    rest = F.when(F.col("name").startswith("make_"), "").otherwise("-rest")
    made = _symbols(t).filter("kind = 'function'").withColumn("repo_id", F.concat("repo_id", rest))
    return conventions.docstring_claims(conventions.docstring_ratios(made))


# ---- JavaScript ------------------------------------------------------------------------

JS = """
(SELECT j.repo_id, j.path, CASE WHEN regexp_matches(j.path, '[.]tsx?$') THEN 'typescript' ELSE 'javascript' END AS language, p_size % 4 = 0 AS has_tests, u.* FROM part JOIN js_code_v j USING (p_partkey), LATERAL (VALUES
  ('import', concat('../', lower(p_type), '/f'), 'import', false), ('import', CASE WHEN p_size > 30 THEN 'vitest' ELSE 'react' END, 'import', false), ('import', concat('./util', p_size), 'require', false),
  ('function', concat('load', upper(substr(p_type, 1, 1))), 'declaration', true), ('function', concat('pick', p_size), 'arrow', false), ('function', 'old', 'expression', false), ('class', concat('Base', p_size), 'class', false)) AS u(kind, name, form, exported))"""


def _js(t):
    return extract_code.js_symbols(t.js_code)


@query("js_symbols", f"SELECT * FROM {JS} AS j")
def _(t):
    return _js(t).drop("default_export", "line", "last", "extends")


@query("js_symbol_lines", f"""
SELECT repo_id, path, kind, name, exported, CASE form WHEN 'declaration' THEN 4 WHEN 'arrow' THEN 5 WHEN 'expression' THEN 6 ELSE 7 END AS line,
  CASE form WHEN 'declaration' THEN 4 WHEN 'arrow' THEN 5 WHEN 'expression' THEN 6 ELSE 7 END AS last, CASE kind WHEN 'class' THEN 'Root' END AS extends, true AS default_export
FROM {JS} AS j WHERE kind <> 'import'""")
def _(t):
    return _js(t).filter("kind <> 'import'").select("repo_id", "path", "kind", "name", "exported", "line", "last", "extends", "default_export")


@query("js_test_placement", f"SELECT repo_id, count(*) AS total, '__tests__/ directory' AS dominant, 1.0::DOUBLE AS share FROM (SELECT DISTINCT repo_id, path FROM {JS} AS j WHERE has_tests) AS d GROUP BY repo_id")
def _(t):
    return conventions.js_test_placement(_js(t).filter("has_tests").select("repo_id", "path").distinct())


@query("placement_claims", f"SELECT repo_id, 'Tests are placed in __tests__/ directory (100% of test files)' AS content, 'always-on-rule' AS claim_type, 'inferred-high' AS source_authority, 'unreviewed' AS review_state, 1.0::DOUBLE AS confidence, 'testing' AS tag FROM (SELECT DISTINCT repo_id FROM {JS} AS j WHERE has_tests) AS d")
def _(t):
    return conventions.placement_claims(conventions.js_test_placement(_js(t).filter("has_tests").select("repo_id", "path").distinct()))


@query("import_style_claims", f"""
SELECT repo_id, concat('Prefer ', style, ' imports (', {PERCENT.format(x='share')}, ' consistency)') AS content, {BUCKETS.format(c='share')}, 'all' AS tag
FROM (SELECT concat(repo_id, CASE WHEN name = 'core' THEN '-core' ELSE '' END) AS repo_id, greatest(count(*) FILTER (level = 0), count(*) FILTER (level > 0)) / count(*) AS share,
  CASE WHEN count(*) FILTER (level = 0) >= count(*) FILTER (level > 0) THEN 'absolute' ELSE 'relative' END AS style FROM {SYMBOLS} AS s WHERE kind = 'import' GROUP BY ALL HAVING count(*) >= 20) AS x WHERE share >= 0.8""")
def _(t):
    return conventions.import_style_claims(conventions.import_style(
        _symbols(t).filter("kind = 'import'").withColumn("repo_id", F.concat("repo_id", F.when(F.col("name") == "core", "-core").otherwise("")))))


@query("js_test_framework", f"""
WITH f AS (SELECT DISTINCT repo_id FROM {JS} AS j WHERE has_tests), h AS (SELECT repo_id, count(*) AS n FROM {JS} AS j WHERE has_tests AND kind = 'import' AND contains(name, 'vitest') GROUP BY repo_id)
SELECT f.repo_id, CASE WHEN n > 0 THEN 'Vitest' ELSE 'Jest (inferred from test patterns)' END AS framework, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS share FROM f LEFT JOIN h ON h.repo_id = f.repo_id""")
def _(t):
    rows = _js(t).filter("has_tests")
    return conventions.js_test_framework(rows.filter("kind = 'import'"), rows)


SHARES = "(SELECT repo_id, count(*) AS total, count(*) FILTER (regexp_matches(path, '[.]tsx?$')) AS typescript FROM js_code_v GROUP BY repo_id)"


@query("typescript_share", f"SELECT *, round(typescript / total, 6) AS share FROM {SHARES} AS s")
def _(t):
    return conventions.typescript_share(t.js_code).withColumn("share", F.round("share", 6))


@query("typescript_claims", f"""
SELECT repo_id, concat('TypeScript is the primary language (', {PERCENT.format(x='share')}, ' of ', total, ' JS/TS files)') AS content, {BUCKETS.format(c='share')}, 'all' AS tag
FROM (SELECT concat(repo_id, CASE WHEN regexp_matches(path, '[.]jsx$') THEN '-jsx' ELSE '' END) AS repo_id, count(*) AS total, count(*) FILTER (regexp_matches(path, '[.]tsx?$')) / count(*) AS share FROM js_code_v GROUP BY ALL) AS x WHERE total >= 20 AND share >= 0.8""")
def _(t):
    return conventions.typescript_claims(conventions.typescript_share(
        t.js_code.withColumn("repo_id", F.concat("repo_id", F.when(F.col("path").endswith(".jsx"), "-jsx").otherwise("")))))


# ---- modules and edges -----------------------------------------------------------------

PY = "(SELECT DISTINCT repo_id, replace(regexp_replace(regexp_extract(path, '^(.*)/__init__[.]py$', 1), '^src/', ''), '/', '.') AS module, regexp_extract(path, '^(.*)/__init__[.]py$', 1) AS module_path, 'python' AS language, 0 AS place FROM init_files_v WHERE regexp_matches(path, '^src/.*__init__[.]py$'))"
JSM = "(SELECT repo_id, regexp_extract(module_path, '([^/]+)$', 1) AS module, module_path, 'javascript' AS language, min(place) AS place FROM (SELECT repo_id, regexp_extract(path, '^(.*)/index[.][jt]s$', 1) AS module_path, CASE WHEN regexp_matches(path, '[.]ts$') THEN 1 ELSE 2 END AS place FROM init_files_v WHERE regexp_matches(path, '/index[.][jt]s$')) AS i GROUP BY ALL)"
MODULES = f"m AS (SELECT * FROM (SELECT * FROM {PY} AS a UNION ALL SELECT * FROM {JSM} AS b) AS u QUALIFY row_number() OVER (PARTITION BY repo_id, module ORDER BY place DESC, module_path DESC) = 1)"


def _modules(t):
    paths = t.kept("module files", lambda: t.init_files)
    return extract_code.distinct_modules(extract_code.py_modules(paths), extract_code.js_modules(paths))


@query("py_modules", f"SELECT repo_id, module, module_path FROM {PY} AS p")
def _(t):
    return extract_code.py_modules(t.init_files).select("repo_id", "module", "module_path")


@query("js_modules", f"SELECT repo_id, module, module_path, place FROM {JSM} AS j")
def _(t):
    return extract_code.js_modules(t.init_files).select("repo_id", "module", "module_path", "place")


@query("distinct_modules", f"WITH {MODULES} SELECT repo_id, module, module_path, language FROM m")
def _(t):
    return _modules(t).select("repo_id", "module", "module_path", "language")


@query("boundary_claims", f"WITH {MODULES} SELECT repo_id, concat('Module ''', module, ''' — ', CASE language WHEN 'python' THEN 'Python package' ELSE 'JS/TS module' END, ' at ', module_path, '/') AS content, module_path AS scope, CASE language WHEN 'python' THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM m")
def _(t):
    return extract_code.boundary_claims(_modules(t)).select("repo_id", "content", "scope", "confidence")


PATHS = "(SELECT DISTINCT repo_id, path FROM python_code_v UNION SELECT DISTINCT repo_id, path FROM js_code_v)"
OWNERS = f"own AS (SELECT p.repo_id, p.path, arg_max(module, (length(module_path), module)) AS module FROM {PATHS} AS p JOIN m ON m.repo_id = p.repo_id AND (starts_with(p.path, concat(m.module_path, '/')) OR p.path = m.module_path) GROUP BY ALL)"


def _owners(t):
    paths = t.python_code.select("repo_id", "path").unionByName(t.js_code.select("repo_id", "path"))
    return graph.path_to_module(paths, _modules(t))


@query("path_to_module", f"WITH {MODULES}, {OWNERS} SELECT * FROM own")
def _(t):
    return _owners(t)


@query("import_candidates", f"""
SELECT repo_id, path, name, level, CASE WHEN level = 0 THEN name ELSE concat_ws('.', nullif(array_to_string(list_slice(fs, 1, greatest(len(fs) - level + 1, 0)), '.'), ''), nullif(name, '')) END AS candidate, dotted
FROM (SELECT DISTINCT repo_id, path, name, CAST(level AS INT) AS level, CASE WHEN starts_with(path, 'src/') THEN list_slice(string_split(path, '/'), 2, -2) ELSE list_slice(string_split(path, '/'), 1, -2) END AS fs, replace(regexp_replace(path, '^src/', ''), '/', '.') AS dotted FROM {SYMBOLS} AS s WHERE kind = 'import') AS x""")
def _(t):
    imports = _symbols(t).filter("kind = 'import'").select("repo_id", "path", "name", "level").distinct()
    return imports.select("*", import_candidate(F.col("path"), F.col("name"), F.col("level")).alias("candidate"), dotted_module(F.col("path")).alias("dotted"))


PY_RESOLVED = f"""
cand AS (SELECT repo_id, path, name, level, CASE WHEN level = 0 THEN name ELSE concat_ws('.', nullif(array_to_string(list_slice(fs, 1, greatest(len(fs) - level + 1, 0)), '.'), ''), nullif(name, '')) END AS candidate
  FROM (SELECT DISTINCT repo_id, path, name, CAST(level AS INT) AS level, CASE WHEN starts_with(path, 'src/') THEN list_slice(string_split(path, '/'), 2, -2) ELSE list_slice(string_split(path, '/'), 1, -2) END AS fs FROM {SYMBOLS} AS s WHERE kind = 'import') AS x),
pyr AS (SELECT c.repo_id, c.path, c.name, c.level, arg_max(m.module, length(m.module)) AS target FROM cand c JOIN m ON m.repo_id = c.repo_id AND (c.candidate = m.module OR starts_with(c.candidate, concat(m.module, '.'))) GROUP BY ALL)"""


def _py_resolved(t):
    imports = _symbols(t).filter("kind = 'import'")
    return graph.resolve_py_imports(imports, _modules(t))


@query("resolve_py_imports", f"WITH {MODULES}, {PY_RESOLVED} SELECT * FROM pyr")
def _(t):
    return _py_resolved(t)


JS_RESOLVED = f"""
jc AS (SELECT DISTINCT repo_id, path, name, CASE WHEN starts_with(name, '../') THEN concat(regexp_extract(path, '^(.*)/[^/]+/[^/]+$', 1), '/', substr(name, 4)) ELSE concat(regexp_extract(path, '^(.*)/[^/]+$', 1), '/', substr(name, 3)) END AS resolved FROM {JS} AS j WHERE kind = 'import' AND starts_with(name, '.')),
jsr AS (SELECT j.repo_id, j.path, j.name, arg_max(m.module, length(m.module_path)) AS target FROM jc j JOIN m ON m.repo_id = j.repo_id AND (j.resolved = m.module_path OR starts_with(j.resolved, concat(m.module_path, '/'))) GROUP BY ALL)"""


def _js_resolved(t):
    return graph.resolve_js_imports(_js(t).filter("kind = 'import'"), _modules(t))


@query("resolve_js_imports", f"WITH {MODULES}, {JS_RESOLVED} SELECT * FROM jsr")
def _(t):
    return _js_resolved(t)


IMPORTS = f"imp AS (SELECT DISTINCT o.repo_id, o.module AS source, r.target FROM (SELECT repo_id, path, target FROM pyr UNION ALL SELECT repo_id, path, target FROM jsr) r JOIN own o ON o.repo_id = r.repo_id AND o.path = r.path WHERE o.module <> r.target)"
EDGE_SQL = f"{MODULES}, {OWNERS}, {PY_RESOLVED}, {JS_RESOLVED}, {IMPORTS}"


def _imports(t):
    # the module table is small next to the files and read three times
    modules = checkpointed(_modules(t))
    py = graph.resolve_py_imports(_symbols(t).filter("kind = 'import'"), modules)
    js = graph.resolve_js_imports(_js(t).filter("kind = 'import'"), modules)
    both = py.select("repo_id", "path", "target").unionByName(js.select("repo_id", "path", "target"))
    paths = t.python_code.select("repo_id", "path").unionByName(t.js_code.select("repo_id", "path"))
    return graph.import_edges(both, graph.path_to_module(paths, modules))


@query("import_edges", f"WITH {EDGE_SQL} SELECT *, 'imports' AS edge_type FROM imp")
def _(t):
    return _imports(t)


@query("contains_edges", f"WITH {MODULES} SELECT c.repo_id, p.module AS source, c.module AS target, 'contains' AS edge_type FROM m c JOIN m p ON p.repo_id = c.repo_id AND p.module = regexp_extract(c.module, '^(.*)[.][^.]+$', 1)")
def _(t):
    return graph.contains_edges(_modules(t))


TESTS = f"(SELECT DISTINCT repo_id, path FROM {SYMBOLS} AS s WHERE kind = 'function' AND starts_with(name, 'test_') UNION SELECT DISTINCT repo_id, path FROM {JS} AS j WHERE has_tests)"
MAPPED = f"""
tf AS (SELECT repo_id, path, CASE WHEN regexp_matches(path, '/test_[^/]+[.]py$') THEN regexp_extract(path, '/test_([^/]+)[.]py$', 1) ELSE regexp_extract(path, '/([^/]+)[.]test[.][jt]sx?$', 1) END AS part FROM {TESTS} AS t),
op AS (SELECT repo_id, part, arg_min(module, (language <> 'python', module_path, module)) AS module FROM (SELECT *, unnest(string_split(module_path, '/')) AS part FROM m) AS a GROUP BY ALL),
om AS (SELECT repo_id, part, arg_min(module, (language <> 'python', module_path, module)) AS module FROM (SELECT *, unnest(string_split(module, '.')) AS part FROM m) AS a GROUP BY ALL),
tm AS (SELECT tf.repo_id, tf.path, coalesce(op.module, om.module) AS module FROM tf LEFT JOIN op ON op.repo_id = tf.repo_id AND op.part = tf.part LEFT JOIN om ON om.repo_id = tf.repo_id AND om.part = tf.part WHERE coalesce(op.module, om.module) IS NOT NULL)"""


def _mapped(t):
    tests = _symbols(t).filter("is_test").select("repo_id", "path").unionByName(_js(t).filter("has_tests").select("repo_id", "path"))
    return graph.map_tests_to_modules(tests, _modules(t))


@query("run_graph", f"""
WITH {EDGE_SQL}, {MAPPED} SELECT repo_id, source, target, 'imports' AS edge_type FROM imp
UNION ALL SELECT c.repo_id, p.module, c.module, 'contains' FROM m c JOIN m p ON p.repo_id = c.repo_id AND p.module = regexp_extract(c.module, '^(.*)[.][^.]+$', 1)
UNION ALL SELECT * FROM (SELECT DISTINCT repo_id, module, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]+$', 1) ELSE '.' END, 'tests' FROM tm) AS te""")
def _(t):
    from attesta.plans import runs

    cols = ["repo_id", "path", "content"]
    inits = t.init_files.withColumn("content", F.lit(""))
    return runs.run_graph(t.python_code.select(cols).unionByName(t.js_code.select(cols)).unionByName(inits.select(cols)))[1]


@query("map_tests_to_modules", f"WITH {MODULES}, {MAPPED} SELECT * FROM tm")
def _(t):
    return _mapped(t)


@query("test_edges", f"WITH {MODULES}, {MAPPED} SELECT DISTINCT repo_id, module AS source, regexp_extract(path, '^(.*)/[^/]+$', 1) AS target, 'tests' AS edge_type FROM tm")
def _(t):
    return graph.test_edges(_mapped(t))


@query("dependencies", f"WITH {EDGE_SQL} SELECT repo_id, source AS module, target AS neighbour FROM imp")
def _(t):
    return graph.neighbours(_imports(t), "imports")


@query("dependents", f"WITH {EDGE_SQL} SELECT repo_id, target AS module, source AS neighbour FROM imp")
def _(t):
    return graph.neighbours(_imports(t), "imports", reverse=True)


@query("test_locations", f"WITH {MODULES}, {MAPPED} SELECT DISTINCT repo_id, module, regexp_extract(path, '^(.*)/[^/]+$', 1) AS neighbour FROM tm")
def _(t):
    return graph.neighbours(graph.test_edges(_mapped(t)), "tests")


@query("module_info", f"""
WITH {EDGE_SQL}, {MAPPED}, te AS (SELECT DISTINCT repo_id, module AS source, regexp_extract(path, '^(.*)/[^/]+$', 1) AS target FROM tm),
ru AS (SELECT repo_id, replace(scope, 'src/m', 'src/shop/brand') AS module_path, count(*) AS rules FROM claims_v WHERE claim_type = 'scoped-rule' GROUP BY ALL)
SELECT m.repo_id, m.module, concat('Module ''', m.module, ''' — ', CASE language WHEN 'python' THEN 'Python package' ELSE 'JS/TS module' END, ' at ', m.module_path, '/') AS boundary,
  (SELECT count(*) FROM imp WHERE imp.repo_id = m.repo_id AND imp.source = m.module) AS dependencies, (SELECT count(*) FROM imp WHERE imp.repo_id = m.repo_id AND imp.target = m.module) AS dependents,
  (SELECT count(*) FROM te WHERE te.repo_id = m.repo_id AND te.source = m.module) AS test_locations, coalesce(ru.rules, 0) AS rules
FROM m LEFT JOIN ru ON ru.repo_id = m.repo_id AND ru.module_path = m.module_path""")
def _(t):
    modules = _modules(t)
    edges = _imports(t).unionByName(graph.test_edges(_mapped(t)))
    rules = t.claims.filter("claim_type = 'scoped-rule'").withColumn("scope", F.replace("scope", F.lit("src/m"), F.lit("src/shop/brand")))
    return graph.module_info(modules, edges, extract_code.boundary_claims(modules), rules).drop("module_path")


@query("dependency_closure", f"""
WITH RECURSIVE {EDGE_SQL}, e AS (SELECT repo_id, source, target FROM imp),
walk AS (SELECT repo_id, source, target, 1 AS distance FROM e UNION SELECT w.repo_id, w.source, e.target, w.distance + 1 FROM walk w JOIN e ON e.repo_id = w.repo_id AND e.source = w.target WHERE w.distance < 3)
SELECT repo_id, source, target, min(distance) AS distance FROM walk WHERE source <> target GROUP BY ALL""")
def _(t):
    return graph.dependency_closure(_imports(t), depth=3)


@query("line_counts", "SELECT repo_id, path, CAST(len(string_split(content, chr(10))) AS INT) AS lines FROM python_code_v")
def _(t):
    return extract_code.line_counts(t.python_code)
