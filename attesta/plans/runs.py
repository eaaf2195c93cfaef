"""Whole runs: files to claims, instruction files to claims, claims to conflict claims."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import dims
from attesta.functions.base import authority_level, blob_id, claim_id, content_hash
from attesta.functions.commands import normalize_ci_command, tags_for_risk
from attesta.functions.scopes import host_from_source
from attesta.functions.scopes import artifact_type as artifact_kind
from attesta.operators import conflicts, conventions, extract_code, extract_docs, graph, prerequisites
from attesta.operators import extract_config as config
from attesta.operators.maintenance import CLAIM_KEY, dedup_first, first_by
from attesta.operators.security import security_applied, security_found, security_scan_claims
from attesta.session import checkpointed, written
from attesta.sources.files import discover_instruction_files, prune_paths, route_files

OUT = [
    "repo_id", "claim_type", "content", "scope", "source_authority", "evidence_level", "risk_class", "applicability",
    "confidence", "sensitivity", "review_state", "phase", "ordinal",
]
EXTRACTION_VERSION = "2"
_registered: dict[str, tuple[str, object]] = {}


def register_extractor(name: str, role: str, fn) -> None:
    """Add an extractor: files of one role to rows with (repo_id, claim_type, content, confidence)."""
    _registered[name] = (role, fn)


def _claims(rows: DataFrame, phase: int, **given: object) -> DataFrame:
    """Extractor output in the claims schema; what a source does not know gets its default."""
    defaults = {
        "scope": F.lit("**"), "evidence_level": F.lit("discovered"), "risk_class": F.lit(None).cast("string"),
        "applicability": F.array(F.lit("all")), "sensitivity": F.lit("public"), "review_state": F.lit("unreviewed"),
        "source_authority": F.lit("executable-config"), "confidence": F.lit(1.0),
    }
    cols = []
    for name in OUT:
        if name == "phase":
            cols.append(F.lit(phase).alias(name))
        elif name == "ordinal":
            cols.append(given.get(name, _order(rows)).alias(name))
        elif name in given:
            value = given[name]
            cols.append((F.lit(value) if isinstance(value, str | int | float) else value).alias(name))
        elif name in rows.columns:
            cols.append(F.col(name))
        else:
            cols.append(defaults[name].alias(name))
    return rows.select(*cols)


def _order(rows: DataFrame) -> Column:
    """Total order of the sightings of one phase: source, file, part, environment, position, then the surer one."""
    kinds = dict(rows.dtypes)
    nested = kinds.get("ordinal", "").startswith("struct")
    part = {n: F.col(f"ordinal.{n}") if nested else F.lit(0) for n in ("source", "part", "env", "position")}
    if "ordinal" in kinds and not nested:
        part["position"] = F.col("ordinal")
    path = F.coalesce("path", F.lit("")) if "path" in kinds else F.lit("")
    doubt = -F.col("confidence") if "confidence" in kinds else F.lit(0.0)
    return F.struct(
        part["source"].cast("int").alias("source"), path.alias("path"), part["part"].cast("int").alias("part"), part["env"].cast("long").alias("env"),
        part["position"].cast("long").alias("position"), doubt.cast("double").alias("doubt"),
    )


class _Seen(NamedTuple):
    """Every sighting of a claim in files, the tools of every repository, and the routed files; nothing of it is kept."""

    sightings: DataFrame
    tools: DataFrame
    routed: DataFrame


def _sightings(files: DataFrame, excluded: tuple[str, ...], max_bytes: int | None) -> _Seen:
    routed = route_files(prune_paths(files, excluded, max_bytes))

    def of(role: str) -> DataFrame:
        return routed.filter(F.col("role") == role).select("repo_id", "path", "content")

    # parsed once each: configuration is needed by several extractors
    pyproject = checkpointed(config.pyproject_documents(of("pyproject")))
    facts = config.pyproject_facts(pyproject)
    formatted = facts.filter(F.arrays_overlap("tools", F.array(*map(F.lit, dims.FORMATTERS)))).select("repo_id")
    jobs_doc = checkpointed(config.workflow_documents(of("workflow")))
    jobs = config.workflow_jobs(jobs_doc)
    steps = config.workflow_steps(jobs)
    docker = config.dockerfile_facts(of("dockerfile"))
    compose = checkpointed(config.compose_services(of("compose")))
    commands = checkpointed(
        config.configured_commands(config.pyproject_commands(pyproject), config.package_json_commands(of("package_json")), config.makefile_targets(of("makefile")))
    )
    lines = config.ci_commands(steps).withColumn("ci_command", normalize_ci_command(F.col("command")))
    first = first_by(lines, ["repo_id", "ci_command"], [F.col("job_no"), F.col("step_no"), F.col("line_no")])
    ci = prerequisites.ci_claims(config.ci_match(lines, commands), first.select("repo_id", "ci_command", "command", "confidence"), commands)
    # a CI sighting raises evidence and confidence of the command it matches, so it goes first
    tags = tags_for_risk(F.col("risk_class"))
    text = F.col("command")
    docs = extract_docs.docs_commands(of("docs"))
    parts = [
        _claims(ci, 0, claim_type="validated-command", applicability=tags),
        _claims(commands, 1, claim_type="validated-command", content=text, applicability=tags),
        _claims(config.docs_new_commands(docs, commands), 2, claim_type="validated-command", content=text, source_authority="checked-in-docs"),
        _claims(prerequisites.runtime_prereqs(
            facts, config.package_json_engines(of("package_json")), config.version_files(of("version_file")),
            config.ci_runtimes(steps), docker), 3, applicability=F.array("tag")),
        _claims(prerequisites.service_prereqs(compose, config.ci_services(jobs)), 4, applicability=F.array("tag")),
        _claims(prerequisites.env_prereqs(config.ci_env_names(jobs_doc, jobs, steps), docker, compose), 5, applicability=F.array("tag")),
        _claims(prerequisites.os_prereqs(jobs), 6, applicability=F.array("tag")),
        _claims(extract_docs.docs_prereq_claims(extract_docs.docs_prerequisites(of("docs"))), 7),
        *_code_claims(of, routed, formatted),
    ]
    for name in sorted(_registered):
        role, fn = _registered[name]
        parts.append(_claims(fn(of(role)), 20))
    return _Seen(_named(_union(parts)), facts.select("repo_id", F.explode("tools").alias("tool")), routed)


def _guards(first: DataFrame, tools: DataFrame) -> DataFrame:
    """Sightings of the guardrails that the first sightings of all claims call for."""
    guards = [
        _claims(prerequisites.destructive_guardrails(first), 21, **_GUARD),
        _claims(prerequisites.ci_security_guardrails(first), 22, **_GUARD),
        _claims(prerequisites.security_tool_guardrails(tools), 23, **_GUARD),
        _claims(prerequisites.services_guardrails(first), 24, **_GUARD),
    ]
    return _named(_union(guards))


_GUARD = {"claim_type": "permission-restriction"}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _code_claims(of, routed: DataFrame, formatted: DataFrame) -> list[DataFrame]:
    """Conventions of both languages and module boundaries; each source is parsed once."""
    symbols = checkpointed(extract_code.python_symbols(of("python")).select("repo_id", "path", "kind", "name", "line", "returns", "params", "annotated", "doc", "level", "is_test"))
    script = checkpointed(extract_code.js_symbols(of("javascript")).select("repo_id", "path", "kind", "name", "form", "has_tests"))
    functions = symbols.filter("kind = 'function'")
    named = symbols.filter("kind IN ('function', 'class') AND NOT is_test").withColumn("seen", F.coalesce("line", F.lit(0)))
    js_named = script.filter("kind IN ('function', 'class')")
    js_tests = script.filter("has_tests")
    tag = F.array("tag")
    modules = extract_code.distinct_modules(extract_code.py_modules(routed), extract_code.js_modules(routed))
    tests = functions.filter("is_test").select("repo_id", "path").distinct()
    naming = conventions.naming_stats(named, ["repo_id", "kind"], ["path", "seen"])
    js_naming = conventions.naming_stats(js_named, ["repo_id", "kind"], ["path", "name"])
    frameworks = conventions.js_test_framework(js_tests.filter("kind = 'import'"), js_tests)
    return [
        _claims(conventions.naming_conventions(naming, formatted), 8, applicability=tag),
        _claims(conventions.placement_claims(conventions.test_placement(tests)), 9, applicability=tag),
        _claims(conventions.import_style_claims(conventions.import_style(symbols.filter("kind = 'import'"))), 10, applicability=tag),
        _claims(conventions.annotation_claims(conventions.annotation_ratios(functions)), 11, applicability=tag),
        _claims(conventions.docstring_claims(conventions.docstring_ratios(symbols)), 12, applicability=tag),
        _claims(conventions.naming_conventions(js_naming, formatted, owned_style=None), 13, applicability=tag),
        _claims(conventions.js_framework_claims(frameworks), 14, applicability=tag),
        _claims(conventions.placement_claims(conventions.js_test_placement(js_tests.select("repo_id", "path").distinct())), 15, applicability=tag),
        _claims(conventions.typescript_claims(conventions.typescript_share(routed)), 16, applicability=tag),
        _claims(extract_code.boundary_claims(modules), 17, source_authority="inferred-high"),
    ]


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("claim_id", claim_id(F.col("claim_type"), F.col("scope"), F.col("content")))


def _stamped(claims: DataFrame, as_of: str | None) -> DataFrame:
    """Authority level, and the columns that later jobs keep up to date."""
    stamp = F.lit(as_of).cast("timestamp")
    return claims.withColumn("authority_level", authority_level(F.col("source_authority"))).select(
        "*", F.lit(False).alias("stale"), F.lit(None).cast("timestamp").alias("last_validated"),
        F.lit(None).cast("string").alias("revalidation_trigger"), stamp.alias("created_at"),
    )


def _finished(sightings: DataFrame, as_of: str | None = None) -> DataFrame:
    """First sighting per id, security scan, authority level, and the columns that later jobs keep up to date."""
    return _stamped(security_scan_claims(dedup_first(sightings)), as_of)


def _whole(seen: _Seen, as_of: str | None) -> tuple[DataFrame, DataFrame]:
    """All claims, and the sightings of the guardrails. The claims in files are moved once, by their ids, and stored once.

    Guardrails and conflicts come from what is stored and stand beside it; an id that is there already stays.
    """
    unique = written(security_found(dedup_first(seen.sightings)), "claims")
    first = unique.drop("severe", "leaked")
    guards = checkpointed(_guards(first, seen.tools))
    found = _stamped(security_applied(unique), as_of)
    # an id begins with its type, so only claims of that type can have it; conflicts are not about guardrails
    fresh = _finished(guards, as_of).join(_ids(first, _GUARD["claim_type"]).hint("merge"), CLAIM_KEY, "left_anti").drop("phase", "ordinal")
    against = conflicts_among(found, as_of).join(_ids(first, "conflict").hint("merge"), CLAIM_KEY, "left_anti")
    beside = written(fresh.unionByName(against.select(*fresh.columns)), "claims-beside")
    claims = found.drop("phase", "ordinal")
    return claims.unionByName(beside.select(*claims.columns)), guards


def _ids(claims: DataFrame, kind: str) -> DataFrame:
    return claims.filter(F.col("claim_type") == kind).select(*CLAIM_KEY)


def _evidence(sightings: DataFrame, files: DataFrame) -> DataFrame:
    """One row per claim and file that shows it, with the hash the file had."""
    seen = sightings.select("repo_id", "claim_id", F.col("ordinal.path").alias("file_path"), "evidence_level").filter("file_path <> ''").distinct()
    hashes = files.select("repo_id", F.col("path").alias("file_path"), blob_id(F.col("content")).alias("file_hash"))
    return seen.join(hashes, ["repo_id", "file_path"], "left").withColumn("extraction_version", F.lit(EXTRACTION_VERSION))


def run_extraction(
    files: DataFrame, excluded: tuple[str, ...] = dims.EXCLUDED_DIRS, max_bytes: int | None = None, as_of: str | None = None
) -> DataFrame:
    """Claims of every repository from its files: deduplicated, scanned, with ids, guardrails and conflicts.

    All files count; ``max_bytes`` leaves larger ones out where a caller asks for it. ``as_of`` is their time of creation.
    """
    return _whole(_sightings(files, excluded, max_bytes), as_of)[0]


class Extraction(NamedTuple):
    """What a whole run finds: claims, evidence, every sighting, and the routed files."""

    claims: DataFrame
    evidence: DataFrame
    sightings: DataFrame
    routed: DataFrame


def conflicts_among(claims: DataFrame, as_of: str | None = None) -> DataFrame:
    """The conflicts of the claims as claims of their own."""
    against = _claims(
        conflict_claims(claims), 30, claim_type="conflict", source_authority="inferred-high", review_state="needs-declaration"
    )
    return _finished(_named(against), as_of).drop("phase", "ordinal")


def extraction(
    files: DataFrame, excluded: tuple[str, ...] = dims.EXCLUDED_DIRS, max_bytes: int | None = None, as_of: str | None = None
) -> Extraction:
    """Everything a whole run finds, from one pass over the files."""
    seen = _sightings(files, excluded, max_bytes)
    seen = seen._replace(sightings=checkpointed(seen.sightings))
    claims, guards = _whole(seen, as_of)
    return Extraction(claims, _evidence(seen.sightings, seen.routed), seen.sightings.unionByName(guards), seen.routed)


def run_extraction_with_evidence(
    files: DataFrame, excluded: tuple[str, ...] = dims.EXCLUDED_DIRS, max_bytes: int | None = None, as_of: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The claims and, from the same sightings, one evidence row per claim and file."""
    run = extraction(files, excluded, max_bytes, as_of)
    return run.claims, run.evidence


def run_evidence(files: DataFrame, excluded: tuple[str, ...] = dims.EXCLUDED_DIRS, max_bytes: int | None = None) -> DataFrame:
    """The evidence of a whole run by itself: no claim is scanned or stored, and no guardrail or conflict, which no file shows, is made."""
    seen = _sightings(files, excluded, max_bytes)
    return _evidence(seen.sightings, seen.routed)


def run_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Modules of every repository and their import, contains and test edges; each source is routed and parsed once."""
    # kept, as five parts read it; only code keeps its text
    code = F.when(F.col("role").isin("python", "javascript"), F.col("content"))
    routed = checkpointed(route_files(files).select("repo_id", "path", "role", code.alias("content")))
    modules = checkpointed(extract_code.distinct_modules(extract_code.py_modules(routed), extract_code.js_modules(routed)))

    def of(role: str) -> DataFrame:
        return routed.filter(F.col("role") == role).select("repo_id", "path", "content")

    symbols = checkpointed(extract_code.python_symbols(of("python")).select("repo_id", "path", "kind", "name", "level", "is_test"))
    script = checkpointed(extract_code.js_symbols(of("javascript")).select("repo_id", "path", "kind", "name", "has_tests"))
    resolved = graph.resolve_py_imports(symbols.filter("kind = 'import'"), modules).select("repo_id", "path", "target").unionByName(
        graph.resolve_js_imports(script.filter("kind = 'import'"), modules).select("repo_id", "path", "target")
    )
    owners = graph.path_to_module(routed.filter("role IN ('python', 'javascript')").select("repo_id", "path"), modules)
    tests = symbols.filter("is_test").select("repo_id", "path").unionByName(script.filter("has_tests").select("repo_id", "path"))
    edges = [graph.import_edges(resolved, owners), graph.contains_edges(modules), graph.test_edges(graph.map_tests_to_modules(tests, modules))]
    return modules, _union(edges)


def run_import(files: DataFrame, as_of: str | None = None) -> DataFrame:
    """Claims of hand-written instruction files and set-up step files, unreviewed and scanned."""
    # kept, as three parts read it
    sources = checkpointed(discover_instruction_files(files).select("repo_id", "path", "content", "source_kind"))
    found = extract_docs.instruction_claims(sources.select("repo_id", "path", "content"))
    steps = config.setup_steps_claims(sources.filter("source_kind = 'copilot-setup-steps'").select("repo_id", "path", "content"))
    authority = "declared-imported-unreviewed"
    rows = _claims(found, 0, content=F.col("claim_text"), scope=F.col("claim_scope"), source_authority=authority)
    return _finished(_named(rows.unionByName(_claims(steps, 1, source_authority=authority))), as_of).drop("phase", "ordinal")


def imported_artifacts(files: DataFrame) -> DataFrame:
    """Instruction files registered as human owned, with the hash they were read at."""
    found = discover_instruction_files(files).filter("source_kind <> 'copilot-setup-steps'")
    return found.select(
        "repo_id", "path", artifact_kind(F.col("path")).alias("artifact_type"), host_from_source(F.col("source_kind")).alias("target_host"),
        content_hash(F.col("content")).alias("expected_hash"), F.lit("imported-human-owned").alias("ownership_mode"),
    )


def conflict_claims(claims: DataFrame) -> DataFrame:
    """All conflict kinds as claims that need a declaration; one row per disagreeing claim."""
    content = F.col("content")
    # fixed values: the texts of conflict claims, which enter their ids
    versus = F.concat(F.initcap("runtime"), F.lit(" version conflict: '"), content, F.lit("' vs '"), "rival", F.lit("'"))
    imported = F.concat(F.lit("Imported instruction says '"), content, F.lit("' but extracted evidence shows '"), "rival", F.lit("'"))
    missing = F.concat(F.lit("README references '"), content, F.lit("' but no test command found in package.json scripts"))
    stale = F.concat(F.lit("Stale instruction: imported file references '"), content, F.lit("' but no matching command found in config files"))
    parts = [
        (conflicts.version_conflicts(claims), versus, 1.0),
        (conflicts.import_conflicts(claims), imported, 1.0),
        (conflicts.docs_command_conflicts(claims), missing, 1.0),
        (conflicts.stale_import_conflicts(claims), stale, 0.8),
        (conflicts.topic_conflicts(claims).withColumn("conflict_type", F.lit("convention")), content, 1.0),
    ]
    rows = None
    for df, text, confidence in parts:
        part = df.select("repo_id", text.alias("content"), "conflict_type", F.lit(confidence).alias("confidence")).distinct()
        rows = part if rows is None else rows.unionByName(part)
    return rows.select(
        "repo_id", claim_id(F.lit("conflict"), F.lit("**"), F.col("content")).alias("claim_id"), F.lit("conflict").alias("claim_type"),
        F.lit("**").alias("scope"), "content", "conflict_type", "confidence", F.lit("needs-declaration").alias("review_state"),
    )
