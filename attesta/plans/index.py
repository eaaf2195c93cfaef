"""Whole runs that are stored: claims in their full schema, evidence, modules and edges, profiles, index rows, counters.

Everything a run writes is written once and read back. The counters of a run are taken from what it wrote and from its
sightings; totals are observed while the claims are written, without another scan.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from attesta.functions import codecs
from attesta.operators import prerequisites
from attesta.operators import extract_config as config
from attesta.operators.maintenance import CLAIM_KEY, upsert
from attesta.plans import runs
from attesta.session import checkpointed
from attesta.sources.files import discover_instruction_files, route_files
from attesta.sources.tables import with_bucket

PROFILE_KEY = ["repo_id", "name"]
#: Phases of the sightings by what they count as.
COUNTED = {
    "ci_commands_found": (0,), "docs_commands_found": (2,), "prerequisites_extracted": (3, 4, 5, 6, 7),
    "conventions_extracted": tuple(range(8, 17)), "guardrails_extracted": (21, 22, 23, 24),
}


def environment_profiles(prereqs: DataFrame, setup: DataFrame, tools: DataFrame | None = None, most_commands: int | None = 20) -> DataFrame:
    """One profile per repository: its first runtime, and its tools, services, variables and set-up commands as lists.

    ``prereqs`` has (repo_id, content, place), ``setup`` CI command lines, ``tools`` (repo_id, tool). The lists hold what the
    repository's own files name, in order; of the commands the first ``most_commands`` count.
    """
    text = F.col("content")
    named = lambda kind: F.when(text.startswith(f"{kind}: "), F.regexp_replace(text, f"^{kind}: ", ""))
    other = text.startswith("Service: ") | text.startswith("Env: ") | text.startswith("OS: ")
    facts = prereqs.groupBy("repo_id").agg(
        F.min_by(F.when(~other, text), F.when(~other, F.struct("place", "content"))).alias("runtime"),
        F.array_sort(F.collect_set(named("Service"))).alias("services"), F.array_sort(F.collect_set(named("Env"))).alias("env_vars"),
    )
    wanted = F.lower("command").rlike("install|setup|apt-get")
    order = ["path", "job_no", "step_no", "line_no"]
    steps = setup.filter(wanted)
    if most_commands is not None:
        steps = prerequisites.first_n(steps, ["repo_id"], order, most_commands)
    listed = steps.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct(*order, "command"))).alias("_c"))
    commands = listed.select("repo_id", F.transform("_c", lambda c: c.command).alias("setup_commands"))
    rows = facts.join(commands, "repo_id", "left")
    none = F.array().cast("array<string>")
    if tools is not None:
        rows = rows.join(tools.groupBy("repo_id").agg(F.array_sort(F.collect_set("tool")).alias("tools")), "repo_id", "left")
    return rows.select(
        "repo_id", F.lit("ci-default").alias("name"), "runtime", (F.coalesce("tools", none) if tools is not None else none).alias("tools"),
        "services", "env_vars", F.coalesce("setup_commands", none).alias("setup_commands"),
    )


def upsert_profiles(profiles: DataFrame, path: str, version: Column) -> None:
    """Last write wins per (repository, name); only the buckets that the profiles touch are written again."""
    spark = profiles.sparkSession
    fresh = with_bucket(profiles.withColumn("version", version.cast("timestamp")))
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = fresh.limit(0)
    kept = stored.join(fresh.select("repo_bucket").distinct(), "repo_bucket", "left_semi").select(*fresh.columns)
    merged = checkpointed(upsert(kept, fresh, PROFILE_KEY, "version"))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_bucket").parquet(path)


def full_claims(claims: DataFrame, evidence: DataFrame, as_of: str, branch: str = "main", heads: DataFrame | None = None) -> DataFrame:
    """Claims with the columns of the stored table: branch, files that show them, provenance and times.

    ``heads(repo_id, repo_head)`` names the commit that was read.
    """
    files = evidence.groupBy(*CLAIM_KEY).agg(F.array_sort(F.collect_set("file_path")).alias("evidence"))
    known = heads.select("repo_id", "repo_head") if heads is not None else claims.select("repo_id", F.lit(None).cast("string").alias("repo_head")).distinct()
    stamp = F.lit(as_of).cast("timestamp")
    none = F.array().cast("array<string>")
    return claims.join(files, CLAIM_KEY, "left").join(known, "repo_id", "left").select(
        "claim_id", "repo_id", F.lit(branch).alias("branch"), "content", "claim_type", "source_authority", "authority_level", "scope", "applicability",
        "sensitivity", "review_state", "confidence", F.coalesce("evidence", none).alias("evidence"),
        F.struct(
            F.lit("1").alias("index_version"), F.coalesce("repo_head", F.lit("")).alias("repo_head"), F.lit(branch).alias("branch"), F.lit(as_of).alias("timestamp"),
            F.lit(runs.EXTRACTION_VERSION).alias("extraction_version"),
        ).alias("provenance"),
        "risk_class", "evidence_level", none.alias("projection_targets"), F.lit(None).cast("string").alias("worktree_id"), F.lit(None).cast("string").alias("session_id"),
        "last_validated", "revalidation_trigger", "stale", stamp.alias("created_at"), stamp.alias("updated_at"),
    )


def _counts(rows: DataFrame, **what: Column) -> DataFrame:
    return rows.groupBy("repo_id").agg(*[F.count_if(c).alias(name) for name, c in what.items()])


def extraction_counters(routed: DataFrame, sightings: DataFrame, claims: DataFrame, modules: DataFrame, edges: DataFrame, profiles: DataFrame, broken: DataFrame) -> DataFrame:
    """The counters of a run per repository, and its warnings: the files that could not be read as what they are."""
    always = F.lit(True)
    role = F.col("role")
    phase = F.col("phase")
    files = _counts(routed, files_parsed=role != "other", python_files_parsed=role == "python", js_files_parsed=role == "javascript")
    seen = _counts(sightings, sightings=always, **{name: phase.isin(*phases) for name, phases in COUNTED.items()})
    made = _counts(claims, claims_created=F.col("claim_type") != "conflict", conflicts_detected=F.col("claim_type") == "conflict")
    out = files
    for part in (seen, made, _counts(modules, modules_detected=always), _counts(edges, edges_created=always), _counts(profiles, profiles_created=always)):
        out = out.join(part, "repo_id", "left")
    told = F.concat(F.lit("not read as "), "role", F.lit(": "), "path")
    warnings = broken.groupBy("repo_id").agg(F.array_sort(F.collect_list(told)).alias("warnings"))
    out = out.fillna(0).join(warnings, "repo_id", "left")
    return out.withColumn("claims_deduplicated", F.col("sightings") - F.col("claims_created")).withColumn(
        "warnings", F.coalesce("warnings", F.array().cast("array<string>"))
    ).drop("sightings")


def unread_files(routed: DataFrame) -> DataFrame:
    """``(repo_id, path, role)`` of configuration and source files whose text is broken."""

    def of(*roles: str) -> DataFrame:
        return routed.filter(F.col("role").isin(*roles)).select("repo_id", "path", "content", "role")

    toml = config.pyproject_documents(of("pyproject")).filter("doc IS NULL").select("repo_id", "path", F.lit("pyproject").alias("role"))
    yaml = config.workflow_documents(of("workflow")).filter("doc IS NULL").select("repo_id", "path", F.lit("workflow").alias("role"))
    json = of("package_json").filter(F.try_parse_json("content").isNull()).select("repo_id", "path", "role")
    parsed = of("python").withColumn("_p", codecs.python_to_json(F.coalesce("content", F.lit(""))))
    python = parsed.filter(F.get_json_object("_p", "$.errors") == "true").select("repo_id", "path", "role")
    return toml.unionByName(yaml).unionByName(json).unionByName(python)


def read(spark: SparkSession, target: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{target}/{name}")


def index_repositories(files: DataFrame, target: str, as_of: str, branch: str = "main", heads: DataFrame | None = None) -> dict[str, object]:
    """A whole run over ``files(repo_id, path, content)``, written below ``target``; returns the totals of the run.

    Written are ``claims``, ``evidence``, ``modules``, ``edges``, ``index`` and ``summary`` (all anew), and ``profiles``, where repositories
    that the run does not know keep theirs.
    """
    spark = files.sparkSession
    sized = files if "size" in files.columns else files.withColumn("size", F.length("content").cast("bigint"))
    run = runs.extraction(sized, as_of=as_of)

    def put(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{target}/{name}")
        return read(spark, target, name)

    evidence = put(run.evidence, "evidence")
    watch = Observation("claims")
    whole = full_claims(run.claims, evidence, as_of, branch, heads).observe(
        watch, F.count(F.lit(1)).alias("claims"), F.count_if(F.col("claim_type") == "conflict").alias("conflicts"), F.count_if(F.col("sensitivity") == "local-only").alias("local_only")
    )
    claims = put(whole, "claims")
    modules, edges = runs.run_graph(sized)
    modules, edges = put(modules, "modules"), put(edges.withColumn("branch", F.lit(branch)), "edges")
    prereqs = run.sightings.filter(F.col("phase").between(3, 6)).select("repo_id", "content", F.col("phase").alias("place"))
    setup = config.ci_commands(config.workflow_steps(config.workflow_jobs(config.workflow_documents(run.routed.filter("role = 'workflow'").select("repo_id", "path", "content")))))
    profiles = checkpointed(environment_profiles(prereqs, setup))
    upsert_profiles(profiles, f"{target}/profiles", F.lit(as_of))
    summary = put(extraction_counters(run.routed, run.sightings, claims, modules, edges, profiles, unread_files(run.routed)), "summary")
    put(
        summary.select(
            "repo_id", F.lit(as_of).cast("timestamp").alias("last_indexed"), F.lit(branch).alias("branch"), F.col("files_parsed").alias("file_count"),
            (F.col("claims_created") + F.col("conflicts_detected")).alias("claim_count"),
        ), "index",
    )
    return dict(watch.get)


def import_instructions(files: DataFrame, known: DataFrame | None = None, as_of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Claims of all instruction files, set-up step files included, with the conflicts they make, and the files' artifact rows.

    ``known`` are the claims of earlier extractions: an imported claim that is among them already does not come again, and
    conflicts are looked for between the two.
    """
    imported = checkpointed(runs.run_import(files, as_of))
    if known is not None:
        imported = checkpointed(imported.join(known.select(*CLAIM_KEY), CLAIM_KEY, "left_anti"))
    together = imported if known is None else imported.unionByName(known.select(*imported.columns))
    against = checkpointed(runs.conflicts_among(together.withColumn("ordinal", F.col("claim_id")), as_of))
    held = imported if known is None else imported.select(*CLAIM_KEY).unionByName(known.select(*CLAIM_KEY))
    new = against.join(held.select(*CLAIM_KEY), CLAIM_KEY, "left_anti")
    return imported.unionByName(new.select(*imported.columns)), runs.imported_artifacts(files)


def instruction_files(files: DataFrame) -> DataFrame:
    """What an import would read, without reading it: the dry run."""
    return discover_instruction_files(route_files(files)).select("repo_id", "path", "source_kind")
