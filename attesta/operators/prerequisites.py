"""Configuration facts as claims: commands, runtimes, services, variables, systems, guardrails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import dims
from attesta.functions.base import contains_any
from attesta.functions.commands import risk_of_ci_command, tags_for_risk
from attesta.operators.extract_config import BY_HASH, BY_SORT
from attesta.operators.maintenance import first_by

PREREQ = ["repo_id", "content", "path", "source_authority", "evidence_level", "confidence", "sensitivity", "tag", "place"]


def _prerequisite(
    rows: DataFrame, content: Column, place: int, authority: str, confidence: float, sensitivity: str = "public"
) -> DataFrame:
    observed = authority == "ci-observed"
    return rows.select(
        "repo_id", content.alias("content"), "path", F.lit(authority).alias("source_authority"),
        F.lit("ci-evidenced" if observed else "prerequisites-extracted").alias("evidence_level"),
        F.lit(confidence).alias("confidence"), F.lit(sensitivity).alias("sensitivity"),
        F.lit("ci" if observed else "all").alias("tag"), F.lit(place).alias("place"),
    )


def _first_texts(parts: list[DataFrame]) -> DataFrame:
    """First source of every text per repository."""
    rows = reduce(DataFrame.unionByName, parts)
    return first_by(rows, ["repo_id", "content"], [F.col("place"), F.col("path")]).withColumn(
        "claim_type", F.lit("environment-prerequisite")
    )


def runtime_prereqs(
    pyproject: DataFrame, engines: DataFrame, hints: DataFrame, ci: DataFrame, docker: DataFrame
) -> DataFrame:
    named = F.concat_ws(" ", "runtime", "version")
    return _first_texts([
        _prerequisite(pyproject.filter("runtime IS NOT NULL"), F.col("runtime"), 0, "executable-config", 1.0),
        _prerequisite(engines, F.col("runtime"), 1, "executable-config", 1.0),
        _prerequisite(hints, named, 2, "executable-config", 0.95),
        _prerequisite(ci.filter(~F.col("version").startswith("<unresolvable:")), named, 3, "ci-observed", 0.9),
        _prerequisite(docker.filter("kind = 'runtime_hint'"), F.col("value"), 4, "executable-config", 0.85),
    ])


def service_prereqs(compose: DataFrame, ci: DataFrame) -> DataFrame:
    label = F.concat(F.lit("Service: "), F.coalesce("image", "service"))
    return _first_texts([
        _prerequisite(compose, label, 0, "executable-config", 0.9),
        _prerequisite(ci, label, 1, "ci-observed", 0.85),
    ])


def env_prereqs(ci: DataFrame, docker: DataFrame, compose: DataFrame) -> DataFrame:
    """Variable names, never values, kept inside the team."""
    from_compose = compose.select("repo_id", "path", F.explode("env_names").alias("name"))
    return _first_texts([
        _prerequisite(ci, F.concat(F.lit("Env: "), "name"), 0, "ci-observed", 0.8, "team-only"),
        _prerequisite(docker.filter("kind = 'env_name'"), F.concat(F.lit("Env: "), "value"), 1, "executable-config", 0.8, "team-only"),
        _prerequisite(from_compose, F.concat(F.lit("Env: "), "name"), 2, "executable-config", 0.8, "team-only"),
    ])


def os_prereqs(jobs: DataFrame) -> DataFrame:
    found = jobs.filter("runs_on IS NOT NULL")
    return _first_texts([_prerequisite(found, F.concat(F.lit("OS: "), "runs_on"), 0, "ci-observed", 0.9)])


def environment_profile(prereqs: DataFrame, setup: DataFrame, most_commands: int | None = None) -> DataFrame:
    """First runtime, services and variables with their counts, and the set-up commands of a repository in order.

    The lists of a repository are what its own files name; ``most_commands`` cuts the commands where a caller asks.
    """
    text = F.col("content")
    other = text.startswith("Service: ") | text.startswith("Env: ") | text.startswith("OS: ")
    facts = prereqs.groupBy("repo_id").agg(
        F.min_by(F.when(~other, text), F.when(~other, F.struct("place", "content"))).alias("runtime"),
        F.count_if(text.startswith("Service: ")).alias("services"),
        F.count_if(text.startswith("Env: ")).alias("env_vars"),
        F.array_join(F.array_sort(F.collect_set(F.when(text.startswith("Service: "), F.regexp_replace("content", "^Service: ", "")))), "|").alias("service_names"),
        F.array_join(F.array_sort(F.collect_set(F.when(text.startswith("Env: "), F.regexp_replace("content", "^Env: ", "")))), "|").alias("env_names"),
    )
    wanted = contains_any(F.lower("command"), ("install", "setup", "apt-get"))
    steps = setup.filter(wanted)
    if most_commands is not None:
        steps = first_n(steps, ["repo_id"], ["path", "job_no", "step_no", "line_no"], most_commands)
    listed = steps.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("path", "job_no", "step_no", "line_no", "command"))).alias("_c"))
    commands = listed.select("repo_id", F.array_join(F.transform("_c", lambda c: c.command), " && ").alias("setup_commands"))
    return facts.join(commands, "repo_id", "left").withColumn("name", F.lit("ci-default"))


def first_n(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    from pyspark.sql import Window

    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_n") <= n).drop("_n")


def command_claims(commands: DataFrame) -> DataFrame:
    return commands.select(
        "repo_id", F.lit("validated-command").alias("claim_type"), F.col("command").alias("content"), "path",
        F.lit("executable-config").alias("source_authority"), F.lit("discovered").alias("evidence_level"),
        "risk_class", tags_for_risk(F.col("risk_class")).alias("applicability"), "confidence",
    )


def ci_claims(matched: DataFrame, ci: DataFrame, config: DataFrame) -> DataFrame:
    """Matched commands upgraded to the better confidence; unmatched ones as CI-observed claims.

    ``matched`` comes from :func:`ci_match`; ``ci`` has the raw text and the confidence of
    every CI line beside its normal form, the first sighting counting.
    """
    sighted = matched.join(ci.hint(BY_HASH), ["repo_id", "ci_command"])
    owned = config.select("repo_id", "ordinal", "command", "risk_class", F.col("confidence").alias("own"))
    upgraded = sighted.filter("ordinal IS NOT NULL").drop("command").join(owned.hint(BY_SORT), ["repo_id", "ordinal"]).select(
        "repo_id", F.col("command").alias("content"), F.lit("executable-config").alias("source_authority"),
        "risk_class", F.greatest("own", "confidence").alias("confidence"),
    )
    upgraded = upgraded.groupBy("repo_id", "content", "source_authority", "risk_class").agg(F.max("confidence").alias("confidence"))
    fresh = sighted.filter("ordinal IS NULL").select(
        "repo_id", F.col("ci_command").alias("content"), F.lit("ci-observed").alias("source_authority"),
        risk_of_ci_command(F.col("command")).alias("risk_class"), "confidence",
    )
    return upgraded.unionByName(fresh).withColumn("evidence_level", F.lit("ci-evidenced"))


# ---- guardrails over the claims table (fixed values: their texts, which enter claim ids) ----


def destructive_guardrails(claims: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit("Command `"), "content", F.lit("` is classified as destructive — require explicit confirmation before running")
    )
    rows = claims.filter("claim_type = 'validated-command' AND risk_class = 'destructive'")
    return rows.select("repo_id", text.alias("content"), F.lit(1.0).alias("confidence")).distinct()


def ci_security_guardrails(claims: DataFrame) -> DataFrame:
    text = F.concat(F.lit("CI runs security scan: `"), "content", F.lit("` — ensure changes pass security checks"))
    rows = claims.filter("claim_type = 'validated-command' AND source_authority = 'ci-observed'").filter(
        F.col("content").rlike("|".join(dims.SECURITY_SCANNERS))
    )
    return rows.select("repo_id", text.alias("content"), F.lit(0.9).alias("confidence")).distinct()


def services_guardrails(claims: DataFrame) -> DataFrame:
    """Every test command needs the services of its repository."""
    name = F.trim(F.split_part(F.trim(F.regexp_replace("content", r"^[^:]*:", "")), F.lit("("), F.lit(1)))
    services = (
        claims.filter("claim_type = 'environment-prerequisite'")
        .filter(F.lower("content").startswith("service:"))
        .select("repo_id", name.alias("service")).distinct()
    )
    # services of one repository: a handful of distinct names
    joined = services.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list("service")), ", ").alias("services"))
    tests = claims.filter("claim_type = 'validated-command' AND risk_class = 'test-execution'").select("repo_id", "content").distinct()
    text = F.concat(F.lit("Command `"), "content", F.lit("` requires services: "), "services")
    return tests.join(joined, "repo_id").select("repo_id", text.alias("content"), F.lit(0.9).alias("confidence"))


def security_tool_guardrails(tools: DataFrame) -> DataFrame:
    """Configured security tools of a repository; ``tools`` has one row per (repo_id, tool)."""
    found = tools.filter(F.col("tool").isin(*dims.SECURITY_TOOLS)).distinct()
    listed = found.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list("tool")), ", ").alias("tools"))
    text = F.concat(F.lit("Security tooling configured: "), "tools", F.lit(" — run security checks before merging"))
    return listed.select("repo_id", text.alias("content"), F.lit(1.0).alias("confidence"))
