"""Configuration, workflow and file-routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.catalog.registry import query
from attesta.functions import versions
from attesta.functions.base import blob_id
from attesta.operators import extract_config as config
from attesta.operators import prerequisites
from attesta.session import checkpointed, shared_folder
from attesta.sources import files

C = "concat('repo-c', c_custkey) AS repo_id"
OK = "c_nationkey <> 13"
SEG = "lower(c_mktsegment)"


def _joined(*names):
    return [F.array_join(n, "|").alias(n) for n in names]


# ---- files -----------------------------------------------------------------------------


@query("prune_paths", """
SELECT repo_id, path, size FROM files_v WHERE size <= 1000000 AND NOT list_has_any(string_split(path, '/'), ['vendor', 'node_modules', 'dist', 'build', '__pycache__', '.git'])
  AND NOT (path = 'web/brand1' OR starts_with(path, 'web/brand1/'))""")
def _(t):
    kept = files.prune_paths(t.files, ("vendor", "node_modules", "dist/", "build", "__pycache__", ".git", "web/brand1"), max_bytes=1_000_000)
    return kept.select("repo_id", "path", "size")


@query("route_files", """
SELECT repo_id, path, CASE WHEN path = 'pyproject.toml' THEN 'pyproject' WHEN path = 'package.json' THEN 'package_json' WHEN path = 'Makefile' THEN 'makefile' WHEN path = 'Dockerfile' THEN 'dockerfile'
  WHEN path = 'docker-compose.yml' THEN 'compose' WHEN path IN ('.python-version', '.nvmrc', '.tool-versions') THEN 'version_file' WHEN path = '.github/workflows/copilot-setup-steps.yml' THEN 'setup_steps'
  WHEN path = '.github/workflows/ci.yml' THEN 'workflow' WHEN path = 'README.md' OR regexp_matches(path, '^docs/[^/]+[.]md$') THEN 'docs' WHEN regexp_matches(path, '(AGENTS|CLAUDE)[.]md$|^[.]cursor/rules/') THEN 'instruction'
  WHEN regexp_matches(path, '[.]py$') THEN 'python' WHEN regexp_matches(path, '[.](jsx?|tsx?)$') THEN 'javascript' ELSE 'other' END AS role FROM files_v""")
def _(t):
    return files.route_files(t.files).select("repo_id", "path", "role")


@query("discover_docs", "SELECT DISTINCT repo_id, path FROM (SELECT repo_id, CASE WHEN contains(path, '/') THEN path ELSE lower(path) END AS fold, sha256(content) AS h, min(path) AS path FROM files_v WHERE path = 'README.md' OR regexp_matches(path, '^docs/[^/]+[.]md$') GROUP BY ALL) AS x")
def _(t):
    return files.discover_docs(t.files.withColumn("content_hash", F.sha2("content", 256))).distinct()


@query("discover_instruction_files", """
SELECT DISTINCT repo_id, path, CASE WHEN regexp_matches(path, 'AGENTS[.]md$') THEN 'agents-md' WHEN path = 'CLAUDE.md' THEN 'claude-md' WHEN starts_with(path, '.cursor/') THEN 'cursor-rules' ELSE 'copilot-setup-steps' END AS source_kind,
  CASE WHEN regexp_matches(path, 'AGENTS[.]md$') THEN 'codex' WHEN path = 'CLAUDE.md' THEN 'claude' WHEN starts_with(path, '.cursor/') THEN 'cursor' ELSE 'copilot' END AS host,
  CASE WHEN contains(path, '/') THEN concat(regexp_extract(path, '^(.*)/[^/]*$', 1), '/**') ELSE '**' END AS scope, 'projected-file' AS x
FROM files_v WHERE regexp_matches(path, '(AGENTS|CLAUDE)[.]md$|^[.]cursor/rules/|copilot-setup-steps[.]yml$')""")
def _(t):
    from attesta.functions.scopes import host_from_source, scope_from_path

    found = files.discover_instruction_files(t.files)
    return found.select("repo_id", "path", "source_kind", host_from_source(F.col("source_kind")).alias("host"), scope_from_path(F.col("path")).alias("scope"), F.lit("projected-file").alias("x")).distinct()


@query("artifact_types", """
SELECT repo_id, path, CASE WHEN regexp_matches(path, '[.]json$') THEN 'settings-snippet' WHEN starts_with(path, '.claude/rules/') THEN 'scoped-rule' WHEN starts_with(path, '.github/instructions/') THEN 'scoped-instruction'
  WHEN starts_with(path, '.cursor/rules/') THEN 'cursor-rule' WHEN starts_with(path, '.windsurf/rules/') THEN 'windsurf-rule' WHEN contains(path, 'copilot-setup-steps') THEN 'setup-steps' WHEN path IN ('CLAUDE.md', 'AGENTS.md') THEN 'instruction-file' ELSE 'projected-file' END AS artifact_type
FROM (SELECT repo_id, path FROM files_v UNION ALL SELECT repo_id, path FROM artifacts_v) AS f""")
def _(t):
    from attesta.functions.scopes import artifact_type

    both = t.files.select("repo_id", "path").unionByName(t.artifacts.select("repo_id", "path"))
    return both.select("repo_id", "path", artifact_type(F.col("path")).alias("artifact_type"))


@query("detect_languages", """
SELECT repo_id, language, true AS supported, count(*) AS files FROM (SELECT repo_id, CASE WHEN regexp_matches(path, '[.]py$') THEN 'Python' WHEN regexp_matches(path, '[.]tsx?$') THEN 'TypeScript' WHEN regexp_matches(path, '[.]jsx?$') THEN 'JavaScript' END AS language FROM files_v) AS x WHERE language IS NOT NULL GROUP BY ALL""")
def _(t):
    return files.detect_languages(t.files)


@query("safe_paths", """
SELECT page_id, raw, CASE WHEN starts_with(raw, '/') THEN false ELSE NOT climbs END AS safe FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN concat('a/../../', url) WHEN page_id % 4 = 1 THEN concat('/abs/', url) WHEN page_id % 4 = 2 THEN concat('a/b/../../', url) ELSE concat('./x/../', url) END AS raw, page_id % 4 = 0 AS climbs FROM pages) AS p""")
def _(t):
    from attesta.functions.scopes import safe_path

    prefix = F.get(F.array(*map(F.lit, ("a/../../", "/abs/", "a/b/../../", "./x/../"))), (F.col("page_id") % 4).cast("int"))
    return t.pages.select("page_id", F.concat(prefix, "url").alias("raw")).withColumn("safe", safe_path(F.col("raw")))


@query("blob_ids", "SELECT repo_id, path, sha1(concat('blob ', octet_length(encode(content)), chr(0), content)) AS blob FROM makefile_v")
def _(t):
    return t.makefile.select("repo_id", "path", blob_id(F.col("content")).alias("blob"))


# ---- package.json, pyproject, Makefile -------------------------------------------------

PACKAGE = f"""
(SELECT {C}, 'package.json' AS path, u.name, u.command, u.risk_class FROM customer, LATERAL (VALUES (0, 'test', concat('jest --group ', {SEG}), 'test-execution'), (1, 'lint', concat('eslint src/', c_nationkey), 'safe-readonly'),
  (2, concat('build-', {SEG}), concat('tsc -p ', c_nationkey), 'build'), (3, 'typecheck', 'tsc --noEmit', 'safe-readonly'), (5, 'deploy:prod', 'ship --all', 'destructive')) AS u(ordinal, name, command, risk_class)
WHERE {OK} AND (u.ordinal < 5 OR c_acctbal < 0))"""


@query("package_json_commands", f"SELECT repo_id, path, name, command, risk_class FROM {PACKAGE} AS p")
def _(t):
    return config.package_json_commands(t.package_json).drop("ordinal", "confidence")


@query("package_json_engines", "SELECT repo_id, concat('node ', json_extract_string(content, '$.engines.node')) AS runtime FROM package_json_v WHERE json_valid(content) AND json_type(content, '$.engines.node') = 'VARCHAR'")
def _(t):
    return config.package_json_engines(t.package_json).select("repo_id", "runtime")


PYPROJECT = f"""
(SELECT {C}, part, name, command, risk_class, confidence FROM customer, LATERAL (VALUES (0, concat('serve-', {SEG}), concat('app.m', c_custkey, ':run'), 'build', 1.0::DOUBLE), (1, 'hatch:dev:fmt', concat('ruff format m', c_nationkey), 'safe-mutating', 1.0::DOUBLE),
  (2, 'pytest', 'pytest', 'test-execution', 0.9::DOUBLE)) AS u(part, name, command, risk_class, confidence) WHERE {OK} AND (part < 2 OR c_acctbal > 0))"""


def _pyproject(t):
    return config.pyproject_documents(t.pyproject)


@query("pyproject_commands", f"SELECT repo_id, CAST(part AS INT) AS part, name, command, CASE WHEN part = 0 AND contains(name, 'build') THEN 'build' ELSE risk_class END AS risk_class, confidence FROM {PYPROJECT} AS p")
def _(t):
    return config.pyproject_commands(_pyproject(t)).drop("path", "ordinal")


@query("pyproject_facts", f"SELECT {C}, concat('Python >=3.', c_nationkey) AS runtime, CASE WHEN c_acctbal > 0 THEN 'ruff|pytest|hatch' ELSE 'ruff|hatch|bandit' END AS tools FROM customer WHERE {OK}")
def _(t):
    return config.pyproject_facts(_pyproject(t)).select("repo_id", "runtime", *_joined("tools"))


@query("makefile_targets", """
SELECT repo_id, CAST(dense_no AS INT) AS ordinal, name, concat('make ', name) AS command, CASE WHEN name = 'test' THEN 'test-execution' WHEN contains(name, 'lint') THEN 'safe-readonly' ELSE 'build' END AS risk_class
FROM (SELECT repo_id, name, row_number() OVER (PARTITION BY repo_id ORDER BY no) - 1 AS dense_no FROM (SELECT repo_id, name, min(no) AS no FROM (SELECT repo_id, generate_subscripts(ns, 1) AS no, unnest(ns) AS name FROM (SELECT repo_id, regexp_extract_all(content, '(?m)^([a-zA-Z_][a-zA-Z0-9_-]*):', 1) AS ns FROM makefile_v) AS a) AS b GROUP BY repo_id, name) AS g) AS c""")
def _(t):
    return config.makefile_targets(t.makefile).select("repo_id", "ordinal", "name", "command", "risk_class")


# ---- Dockerfile, compose, version files ------------------------------------------------

IMAGE = "CASE c_nationkey % 6 WHEN 0 THEN concat('python:3.', c_nationkey, '-slim') WHEN 1 THEN concat('node:', c_nationkey) WHEN 2 THEN 'registry.example.com/base/golang' WHEN 3 THEN 'ruby:latest' WHEN 4 THEN concat('eclipse-temurin:', c_nationkey) ELSE concat('debian:', c_nationkey) END"
HINT = "CASE c_nationkey % 6 WHEN 0 THEN concat('Python:3.', c_nationkey, '-slim') WHEN 1 THEN concat('Node.js:', c_nationkey) WHEN 2 THEN 'Go' WHEN 3 THEN 'Ruby' WHEN 4 THEN concat('Java:', c_nationkey) END"


@query("dockerfile_facts", f"""
SELECT {C}, kind, CAST(position AS INT) AS position, value FROM customer, LATERAL (VALUES ('base_image', 0, {IMAGE}), ('runtime_hint', 0, {HINT}), ('tool_install', 0, 'curl'), ('tool_install', 1, concat('git', c_nationkey)), ('tool_install', 2, 'make'),
  ('tool_install', 3, 'pip:uv'), ('tool_install', 4, concat('pip:tool', c_nationkey)), ('env_name', 0, concat('APP_', c_mktsegment)), ('port', 0, (8000 + c_nationkey)::VARCHAR), ('port', 1, concat('9', c_nationkey)), ('workdir', 0, concat('/srv/', {SEG}))) AS u(kind, position, value)
WHERE value IS NOT NULL""")
def _(t):
    return config.dockerfile_facts(t.dockerfile).drop("path")


@query("runtime_hints", f"SELECT {C}, {IMAGE} AS image, {HINT} AS hint FROM customer")
def _(t):
    images = config.dockerfile_facts(t.dockerfile).filter("kind = 'base_image'")
    return images.select("repo_id", F.col("value").alias("image"), versions.runtime_hint(F.col("value")).alias("hint"))


@query("compose_services", f"""
SELECT {C}, service, image, env_names, ports, depends_on, volumes FROM customer, LATERAL (VALUES ('db', concat('postgres:', c_nationkey), concat('PG_', c_mktsegment, '|PGDATA'), concat(5400 + c_nationkey, ':5432'), NULL, NULL),
  ('web', NULL, 'URL', NULL, 'db', 'data:/srv')) AS u(service, image, env_names, ports, depends_on, volumes)""")
def _(t):
    out = config.compose_services(t.compose)
    return out.select("repo_id", "service", "image", *_joined("env_names", "ports", "depends_on", "volumes"))


VERSION = """
(SELECT repo_id, path, runtime, version FROM (SELECT concat('repo-c', c_custkey) AS repo_id, u.* FROM customer, LATERAL (VALUES ('.python-version', 'Python', concat('3.', c_nationkey)), ('.nvmrc', 'Node.js', concat('v', c_nationkey)),
  ('.tool-versions', 'Python', concat('3.', c_nationkey)), ('.tool-versions', 'Node.js', concat(c_nationkey, '.1.0')), ('.tool-versions', 'zig', concat('0.', c_nationkey))) AS u(path, runtime, version)) AS x)"""


@query("version_files", f"SELECT repo_id, path, runtime, version FROM {VERSION} AS v")
def _(t):
    return config.version_files(t.version_file).drop("ordinal")


# ---- workflows -------------------------------------------------------------------------

TEST_CERT = "CASE WHEN c_nationkey % 3 = 2 THEN 'low' ELSE 'medium' END"
LINT_CERT = "CASE WHEN c_nationkey % 3 = 2 THEN 'low' ELSE {} END"
CI = f"""
(SELECT {C}, job, CAST(step_no AS INT) AS step_no, CAST(line_no AS INT) AS line_no, command, certainty, CASE certainty WHEN 'high' THEN 0.95::DOUBLE WHEN 'medium' THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM customer, LATERAL (VALUES
  ('test', 1, 0, concat('make test > log-', c_custkey, '.txt'), {TEST_CERT}), ('test', 1, 2, concat('pytest tests/', {SEG}, ' | tee out'), {TEST_CERT}), ('lint', 1, 0, concat('eslint src/', c_nationkey), {LINT_CERT.format("'medium'")}),
  ('lint', 2, 0, 'bandit -r src', 'low'), ('lint', 3, 0, 'ruff check .', {LINT_CERT.format("'high'")})) AS u(job, step_no, line_no, command, certainty))"""


def _workflow(t):
    docs = t.kept("workflow documents", lambda: config.workflow_documents(t.workflow))
    jobs = config.workflow_jobs(docs)
    return docs, jobs, config.workflow_steps(jobs)


@query("ci_commands", f"SELECT * FROM {CI} AS c")
def _(t):
    return config.ci_commands(_workflow(t)[2]).select("repo_id", "job", "step_no", "line_no", "command", "certainty", "confidence")


@query("workflow_jobs", f"""
SELECT {C}, job, runs_on, matrix, c_nationkey % 3 = 2 AS schedule_only FROM customer, LATERAL (VALUES ('test', 'ubuntu-latest', concat('python=3.', c_nationkey, ',3.', c_nationkey + 1)), ('lint', concat('self-hosted, ', {SEG}), '')) AS u(job, runs_on, matrix)""")
def _(t):
    entries = F.transform(F.map_entries("matrix"), lambda e: F.concat(e.key, F.lit("="), F.array_join(e.value, ",")))
    return _workflow(t)[1].select("repo_id", "job", "runs_on", F.array_join(F.array_sort(entries), ";").alias("matrix"), "schedule_only")


@query("ci_runtimes", f"""
SELECT {C}, job, runtime, CAST(version_no AS INT) AS version_no, version FROM customer, LATERAL (VALUES ('test', 'python', 0, concat('3.', c_nationkey)), ('test', 'python', 1, concat('3.', c_nationkey + 1)), ('lint', 'node', 0, c_nationkey::VARCHAR)) AS u(job, runtime, version_no, version)""")
def _(t):
    return config.ci_runtimes(_workflow(t)[2]).select("repo_id", "job", "runtime", "version_no", "version")


@query("ci_services", f"SELECT {C}, 'test' AS job, 'db' AS service, concat('postgres:', c_nationkey) AS image FROM customer")
def _(t):
    return config.ci_services(_workflow(t)[1]).select("repo_id", "job", "service", "image")


@query("ci_env_names", f"SELECT {C}, 'workflow' AS level, u.name FROM customer, LATERAL (VALUES ('TOKEN (secret-ref)'), ('MODE')) AS u(name)")
def _(t):
    return config.ci_env_names(*_workflow(t)).drop("path")


@query("resolve_matrix", """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat('3.', c_nationkey, '|3.', c_nationkey + 1) WHEN 1 THEN concat('<unresolvable:${{ inputs.v', c_nationkey, ' }}>') ELSE concat('4.', c_nationkey) END AS resolved FROM customer""")
def _(t):
    n = F.col("c_nationkey")
    matrix = F.create_map(F.lit("python"), F.array(F.concat(F.lit("3."), n), F.concat(F.lit("3."), n + 1)))
    value = F.when(F.col("c_custkey") % 3 == 0, "${{ matrix.python }}").when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("${{ inputs.v"), n, F.lit(" }}"))).otherwise(F.concat(F.lit("4."), n))
    return t.customer.select("c_custkey", F.array_join(versions.resolve_matrix(value, matrix), "|").alias("resolved"))


@query("setup_steps_claims", f"""
SELECT {C}, claim_type, content FROM customer, LATERAL (VALUES ('environment-prerequisite', concat('Environment variable: API_', c_mktsegment)), ('environment-prerequisite', concat('Python 3.', c_nationkey)), ('validated-command', concat('pip install m', c_nationkey))) AS u(claim_type, content)""")
def _(t):
    return config.setup_steps_claims(t.setup_steps).drop("path", "confidence")


@query("validate_setup_steps", f"""
SELECT {C}, error FROM customer, LATERAL (VALUES (CASE WHEN c_acctbal < 0 THEN 'the job has to be called copilot-setup-steps, not other-job' END),
  (CASE WHEN c_nationkey * 4 > 59 THEN concat('timeout-minutes is ', c_nationkey * 4, ', the most is 59') WHEN c_nationkey = 0 THEN 'timeout-minutes is 0, the least is 1' END),
  (CASE WHEN c_mktsegment = 'BUILDING' THEN 'keys a set-up job cannot have: strategy' END),
  (CASE WHEN c_nationkey % 2 = 0 THEN 'step 0 uses actions/setup-python without a version' END)) AS u(error) WHERE error IS NOT NULL""")
def _(t):
    return config.validate_setup_steps(t.setup_steps).drop("path")


# ---- cross reference and claims --------------------------------------------------------


def _config_commands(t):
    """All configured commands of a repository in lookup order; the files are parsed once."""

    def make():
        docs = t.kept("pyproject documents", lambda: _pyproject(t))
        return config.configured_commands(config.pyproject_commands(docs), config.package_json_commands(t.package_json), config.makefile_targets(t.makefile))

    return t.kept("configured commands", make)


MATCHED = f"""
cfg AS (SELECT repo_id, part * 100 AS ord, name, command, CASE WHEN part = 0 AND contains(name, 'build') THEN 'build' ELSE risk_class END AS risk_class, confidence FROM {PYPROJECT} AS a
  UNION ALL SELECT repo_id, 1000 + CASE WHEN name = 'test' THEN 0 WHEN name = 'lint' THEN 1 WHEN name = 'typecheck' THEN 3 WHEN name = 'deploy:prod' THEN 5 ELSE 2 END, name, command, risk_class, 1.0::DOUBLE FROM {PACKAGE} AS b
  UNION ALL SELECT concat('repo-c', c_custkey), 2000 + o, name, concat('make ', name), r, 0.9::DOUBLE FROM customer, LATERAL (VALUES (0, 'test', 'test-execution'), (1, concat('lint-', {SEG}), 'safe-readonly'), (2, 'release_all', 'build'), (3, concat('docs', c_nationkey), 'build')) AS u(o, name, r)),
cis AS (SELECT repo_id, regexp_replace(trim(split_part(command, '|', 1)), '\\s*>.*$', '') AS ci, min((step_no, confidence)) AS seen, arg_min(confidence, (job = 'lint', step_no, line_no)) AS confidence FROM {CI} AS c GROUP BY ALL),
pairs AS (SELECT cis.repo_id, ci, cis.confidence, cfg.ord, cfg.command, cfg.risk_class, cfg.confidence AS own FROM cis JOIN cfg ON cfg.repo_id = cis.repo_id AND (ci = command OR suffix(ci, name) OR ci = concat('make ', name) OR starts_with(ci, command)
  OR regexp_matches(ci, concat('\\b', regexp_escape(command), '\\b')) OR list_contains(list_transform(list_filter(['npx ', 'yarn ', 'pnpm ', 'npm run ', 'make ', 'python -m ', 'uv run '], lambda p: starts_with(ci, p)), lambda p: trim(substr(ci, length(p) + 1))), command)
  OR list_contains(list_transform(list_filter(['npx ', 'yarn ', 'pnpm ', 'npm run ', 'make ', 'python -m ', 'uv run '], lambda p: starts_with(ci, p)), lambda p: trim(substr(ci, length(p) + 1))), name)))"""


@query("ci_match", f"WITH {MATCHED} SELECT c.repo_id, c.ci AS ci_command, arg_min(p.command, p.ord) AS command FROM cis c LEFT JOIN pairs p ON p.repo_id = c.repo_id AND p.ci = c.ci GROUP BY ALL")
def _(t):
    commands = _config_commands(t)
    out = config.ci_match(config.ci_commands(_workflow(t)[2]), commands)
    return out.join(commands.select("repo_id", "ordinal", "command").hint(config.BY_SORT), ["repo_id", "ordinal"], "left").select("repo_id", "ci_command", "command")


@query("ci_claims", f"""
WITH {MATCHED}, b AS (SELECT repo_id, ci, arg_min(command, ord) AS command, arg_min(risk_class, ord) AS risk_class, greatest(arg_min(own, ord), any_value(confidence)) AS confidence FROM pairs GROUP BY repo_id, ci)
SELECT repo_id, command AS content, 'executable-config' AS source_authority, risk_class, max(confidence) AS confidence FROM b GROUP BY ALL
UNION ALL SELECT repo_id, ci, 'ci-observed', CASE WHEN contains(ci, 'test') THEN 'test-execution' WHEN regexp_matches(ci, 'lint|check|ruff') THEN 'safe-readonly' ELSE 'build' END, confidence FROM cis c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.repo_id = c.repo_id AND b.ci = c.ci)""")
def _(t):
    from attesta.functions.commands import normalize_ci_command
    from attesta.operators.maintenance import first_by

    ci, commands = config.ci_commands(_workflow(t)[2]), _config_commands(t)
    lines = ci.withColumn("ci_command", normalize_ci_command(F.col("command")))
    first = first_by(lines, ["repo_id", "ci_command"], [F.col("job_no"), F.col("step_no"), F.col("line_no")])
    matched = t.kept("matched lines", lambda: config.ci_match(ci, commands))
    return prerequisites.ci_claims(matched, first.select("repo_id", "ci_command", "command", "confidence"), commands).drop("evidence_level")


@query("docs_new_commands", """
WITH cfg AS (SELECT DISTINCT repo_id, lower(trim(content)) AS c FROM claims_v WHERE claim_type = 'validated-command' AND source_authority IN ('executable-config', 'ci-observed'))
SELECT repo_id, claim_id, content AS command FROM unique_claims_v d WHERE claim_type = 'validated-command' AND source_authority = 'checked-in-docs' AND NOT EXISTS (SELECT 1 FROM cfg WHERE cfg.repo_id = d.repo_id AND cfg.c = lower(trim(d.content)))""")
def _(t):
    from attesta.operators.maintenance import dedup_first

    command = F.col("claim_type") == "validated-command"
    known = t.claims.filter(command & F.col("source_authority").isin("executable-config", "ci-observed")).select("repo_id", F.col("content").alias("command"))
    docs = dedup_first(t.claims).filter(command & (F.col("source_authority") == "checked-in-docs")).select("repo_id", "claim_id", F.col("content").alias("command"))
    return config.docs_new_commands(docs, known)


@query("command_claims", f"SELECT repo_id, 'validated-command' AS claim_type, command AS content, risk_class, CASE risk_class WHEN 'test-execution' THEN 'test' WHEN 'safe-readonly' THEN 'lint' WHEN 'build' THEN 'build' ELSE 'ci|release' END AS applicability FROM {PACKAGE} AS p")
def _(t):
    out = prerequisites.command_claims(config.package_json_commands(t.package_json))
    return out.select("repo_id", "claim_type", "content", "risk_class", *_joined("applicability"))


def _prereq_columns(df):
    return df.select("repo_id", "content", "source_authority", "evidence_level", "confidence", "sensitivity", "tag", F.col("place").cast("int").alias("place"))


def _runtimes(t):
    docker = config.dockerfile_facts(t.dockerfile)
    return prerequisites.runtime_prereqs(config.pyproject_facts(_pyproject(t)), config.package_json_engines(t.package_json), config.version_files(t.version_file), config.ci_runtimes(_workflow(t)[2]), docker)


def _compose(t):
    return t.kept("compose services", lambda: config.compose_services(t.compose))


def _services(t):
    return prerequisites.service_prereqs(_compose(t), config.ci_services(_workflow(t)[1]))


def _variables(t):
    return prerequisites.env_prereqs(config.ci_env_names(*_workflow(t)), config.dockerfile_facts(t.dockerfile), _compose(t))


PREREQ = "SELECT repo_id, content, {a} AS source_authority, {l} AS evidence_level, confidence, {s} AS sensitivity, {t} AS tag, CAST(place AS INT) AS place FROM ({rows}) AS r QUALIFY row_number() OVER (PARTITION BY repo_id, content ORDER BY place) = 1"


def _prereq_sql(values: str, where: str, observed: str, sensitivity: str = "'public'") -> str:
    rows = f"SELECT {C}, place, content, confidence FROM customer, LATERAL (VALUES {values}) AS u(place, content, confidence) WHERE content IS NOT NULL AND {where}"
    return PREREQ.format(
        a=f"CASE WHEN {observed} THEN 'ci-observed' ELSE 'executable-config' END", l=f"CASE WHEN {observed} THEN 'ci-evidenced' ELSE 'prerequisites-extracted' END",
        s=sensitivity, t=f"CASE WHEN {observed} THEN 'ci' ELSE 'all' END", rows=rows)


RUNTIMES = _prereq_sql(
    f"(0, concat('Python >=3.', c_nationkey), 1.0::DOUBLE), (1, concat('node >=', c_nationkey + 10), 1.0::DOUBLE), (2, concat('Python 3.', c_nationkey), 0.95::DOUBLE), (2, concat('Node.js v', c_nationkey), 0.95::DOUBLE), (2, concat('Node.js ', c_nationkey, '.1.0'), 0.95::DOUBLE), (2, concat('zig 0.', c_nationkey), 0.95::DOUBLE), (3, concat('python 3.', c_nationkey), 0.9::DOUBLE), (3, concat('python 3.', c_nationkey + 1), 0.9::DOUBLE), (3, concat('node ', c_nationkey), 0.9::DOUBLE), (4, {HINT}, 0.85::DOUBLE)",
    f"({OK} OR place > 1)", "place = 3")
SERVICES = _prereq_sql("(0, concat('Service: postgres:', c_nationkey), 0.9::DOUBLE), (0, 'Service: web', 0.9::DOUBLE), (1, concat('Service: postgres:', c_nationkey), 0.85::DOUBLE)", "true", "place = 1")
VARIABLES = _prereq_sql("(0, 'Env: TOKEN (secret-ref)', 0.8::DOUBLE), (0, 'Env: MODE', 0.8::DOUBLE), (1, concat('Env: APP_', c_mktsegment), 0.8::DOUBLE), (2, concat('Env: PG_', c_mktsegment), 0.8::DOUBLE), (2, 'Env: PGDATA', 0.8::DOUBLE), (2, 'Env: URL', 0.8::DOUBLE)", "true", "place = 0", "'team-only'")
SYSTEMS = _prereq_sql(f"(0, 'OS: ubuntu-latest', 0.9::DOUBLE), (0, concat('OS: self-hosted, ', {SEG}), 0.9::DOUBLE)", "true", "true")


@query("runtime_prereqs", RUNTIMES)
def _(t):
    return _prereq_columns(_runtimes(t))


@query("service_prereqs", SERVICES)
def _(t):
    return _prereq_columns(_services(t))


@query("env_prereqs", VARIABLES)
def _(t):
    return _prereq_columns(_variables(t))


@query("os_prereqs", SYSTEMS)
def _(t):
    return _prereq_columns(prerequisites.os_prereqs(_workflow(t)[1]))


@query("environment_profile", f"""
SELECT {C}, 'ci-default' AS name, CASE WHEN {OK} THEN concat('Python >=3.', c_nationkey) ELSE concat('Node.js ', c_nationkey, '.1.0') END AS runtime, CAST(2 AS BIGINT) AS services, CAST(6 AS BIGINT) AS env_vars, array_to_string(list_sort([concat('postgres:', c_nationkey), 'web']), '|') AS service_names,
  array_to_string(list_sort(['TOKEN (secret-ref)', 'MODE', concat('APP_', c_mktsegment), concat('PG_', c_mktsegment), 'PGDATA', 'URL']), '|') AS env_names, concat('pip install m', c_nationkey) AS setup_commands FROM customer""")
def _(t):
    prereqs = _runtimes(t).unionByName(_services(t)).unionByName(_variables(t))
    setup = config.ci_commands(config.workflow_steps(config.workflow_jobs(config.workflow_documents(t.setup_steps))))
    return prerequisites.environment_profile(prereqs, setup)


PROFILES = f"""
SELECT {C}, 'ci-default' AS name, CASE WHEN {OK} THEN concat('Python >=3.', c_nationkey) ELSE concat('Node.js ', c_nationkey, '.1.0') END AS runtime, CASE WHEN c_nationkey % 2 = 0 THEN 'ruff' ELSE '' END AS tools,
  array_to_string(list_sort([concat('postgres:', c_nationkey), 'web']), '|') AS services,
  array_to_string(list_sort(['TOKEN (secret-ref)', 'MODE', concat('APP_', c_mktsegment), concat('PG_', c_mktsegment), 'PGDATA', 'URL']), '|') AS env_vars, concat('pip install m', c_nationkey) AS setup_commands FROM customer"""


def _profiles(t):
    from attesta.plans import index

    prereqs = _runtimes(t).unionByName(_services(t)).unionByName(_variables(t))
    setup = config.ci_commands(config.workflow_steps(config.workflow_jobs(config.workflow_documents(t.setup_steps))))
    tools = t.customer.filter("c_nationkey % 2 = 0").select(F.concat(F.lit("repo-c"), "c_custkey").alias("repo_id"), F.lit("ruff").alias("tool"))
    return index.environment_profiles(prereqs, setup, tools)


def _flat(df):
    return df.select("repo_id", "name", "runtime", *[F.array_join(c, "|").alias(c) for c in ("tools", "services", "env_vars", "setup_commands")])


@query("environment_profiles", PROFILES)
def _(t):
    return _flat(_profiles(t))


@query("upsert_profiles", PROFILES)
def _(t):
    from attesta.plans import index

    path = shared_folder(t.spark, "profiles")
    whole = checkpointed(_profiles(t))
    some = F.pmod(F.xxhash64("repo_id"), F.lit(3)) == 0
    # a first run with other runtimes, a second run over all, and a third that comes late and is older
    index.upsert_profiles(whole.filter(some).withColumn("runtime", F.lit("first")), path, F.lit("2024-01-01T00:00:00Z"))
    index.upsert_profiles(whole, path, F.lit("2024-02-01T00:00:00Z"))
    index.upsert_profiles(whole.filter(some).withColumn("runtime", F.lit("late")), path, F.lit("2023-01-01T00:00:00Z"))
    return _flat(t.spark.read.parquet(path))


# ---- guardrails ------------------------------------------------------------------------

DESTRUCTIVE = "concat('Command `', content, '` is classified as destructive — require explicit confirmation before running')"


@query("destructive_guardrails", f"SELECT DISTINCT repo_id, {DESTRUCTIVE} AS content, 1.0::DOUBLE AS confidence FROM claims_v WHERE claim_type = 'validated-command' AND risk_class = 'destructive'")
def _(t):
    return prerequisites.destructive_guardrails(t.claims)


@query("ci_security_guardrails", "SELECT DISTINCT repo_id, concat('CI runs security scan: `', content, '` — ensure changes pass security checks') AS content, 0.9::DOUBLE AS confidence FROM claims_v WHERE claim_type = 'validated-command' AND source_authority = 'ci-observed' AND (starts_with(content, 'npm audit') OR starts_with(content, 'bandit'))")
def _(t):
    return prerequisites.ci_security_guardrails(t.claims)


@query("services_guardrails", """
WITH s AS (SELECT repo_id, string_agg(DISTINCT substr(content, 10), ', ' ORDER BY substr(content, 10)) AS services FROM claims_v WHERE starts_with(content, 'Service: ') GROUP BY repo_id)
SELECT DISTINCT c.repo_id, concat('Command `', content, '` requires services: ', services) AS content, 0.9::DOUBLE AS confidence FROM claims_v c JOIN s ON s.repo_id = c.repo_id WHERE claim_type = 'validated-command' AND risk_class = 'test-execution'""")
def _(t):
    return prerequisites.services_guardrails(t.claims)


@query("security_tool_guardrails", f"SELECT {C}, 'Security tooling configured: bandit — run security checks before merging' AS content, 1.0::DOUBLE AS confidence FROM customer WHERE {OK} AND c_acctbal <= 0")
def _(t):
    tools = config.pyproject_facts(_pyproject(t)).select("repo_id", F.explode("tools").alias("tool"))
    return prerequisites.security_tool_guardrails(tools)


@query("runtime_names", "SELECT ordinal, CASE WHEN contains(lower(content), 'python') THEN 'python' WHEN contains(lower(content), 'node') THEN 'node' WHEN contains(lower(content), 'go') THEN 'go' WHEN contains(lower(content), 'ruby') THEN 'ruby' WHEN regexp_matches(lower(content), 'java|jdk') THEN 'java' WHEN contains(lower(content), 'rust') THEN 'rust' END AS runtime, CASE WHEN regexp_matches(content, '\\d+\\.\\d+') THEN regexp_extract(content, '\\d+\\.\\d+') WHEN regexp_matches(content, '\\d') THEN regexp_extract(content, '\\d+') END AS version FROM claims_v")
def _(t):
    return t.claims.select("ordinal", versions.runtime_name(F.col("content")).alias("runtime"), versions.major_minor(F.col("content")).alias("version"))


@query("versions_conflict", """
SELECT p_partkey, CASE WHEN NOT ma AND NOT mb THEN va <> vb WHEN ma AND NOT mb THEN vb < va WHEN mb AND NOT ma THEN va < vb ELSE false END AS clash FROM (SELECT p_partkey, p_size % 3 = 0 AS ma, p_size % 2 = 0 AS mb, [3, p_size % 20] AS va, [3, CAST(floor(p_retailprice) AS INT) % 20, 1] AS vb FROM part) AS x""")
def _(t):
    a = F.concat(F.when(F.col("p_size") % 3 == 0, "py >=3.").otherwise("py 3."), F.col("p_size") % 20)
    b = F.concat(F.when(F.col("p_size") % 2 == 0, "py >=3.").otherwise("py 3."), F.floor("p_retailprice").cast("int") % 20, F.lit(".1"))
    return t.part.select("p_partkey", versions.versions_conflict(a, b).alias("clash"))
