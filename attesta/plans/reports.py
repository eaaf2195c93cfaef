"""Read reports over the governed claims of many repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import dims
from attesta.functions import base
from attesta.operators import filters, ordering

CLAIM_KEY = ["repo_id", "claim_id"]


def validated_commands(
    claims: DataFrame, scope: str = "**", limit: int = 50, cursor: tuple[str, str] | None = None
) -> DataFrame:
    found = filters.list_claims(claims, claim_type="validated-command")
    rows = filters.output_gate(filters.scope_filter(found, scope))
    return ordering.page(rows, limit, cursor)


def conventions(
    claims: DataFrame,
    path: str = "**",
    task: str | None = None,
    limit: int = 50,
    cursor: tuple[int, str, str] | None = None,
) -> DataFrame:
    rows = claims.filter(F.col("claim_type").isin("always-on-rule", "scoped-rule"))
    rows = filters.scope_filter(rows, path)
    if task:
        rows = filters.task_filter(rows, task)
    return ordering.page_by_precedence(filters.output_gate(rows), limit, cursor)


def prerequisites(claims: DataFrame, profiles: DataFrame, scope: str | None = None) -> DataFrame:
    rows = filters.list_claims(claims, claim_type="environment-prerequisite")
    if scope:
        rows = filters.scope_filter(rows, scope)
    return filters.output_gate(rows).join(profiles, "repo_id", "left")


def conflicts(claims: DataFrame, scope: str = "**") -> DataFrame:
    rows = filters.scope_filter(filters.list_claims(claims, claim_type="conflict"), scope)
    return filters.output_gate(rows).withColumn(
        "suggested_resolution", F.lit("Review and resolve the conflicting claims")
    )


def guardrails(claims: DataFrame, host: str | None = None, scope: str = "**") -> DataFrame:
    rows = filters.scope_filter(filters.list_claims(claims, claim_type="permission-restriction"), scope)
    return filters.with_enforcement(filters.output_gate(rows), host)


def preflight(claims: DataFrame, path: str, task: str | None = None) -> DataFrame:
    """Counts of what an agent must know for a path, per repository, in one scan.

    Hidden and local conflicts are gated like everything else.
    """
    rows = filters.output_gate(claims.filter(F.col("scope").isin(path, "**")))
    rule = F.col("claim_type").isin("always-on-rule", "scoped-rule")
    if task:
        rule = rule & F.arrays_overlap("applicability", F.array(F.lit("all"), F.lit(task)))
    command = F.col("claim_type") == "validated-command"
    return rows.groupBy("repo_id").agg(
        F.count_if(rule).alias("rules"),
        F.count_if(command).alias("commands"),
        F.count_if(F.col("claim_type") == "permission-restriction").alias("guardrails"),
        F.count_if((rule | command) & F.col("stale")).alias("stale_claims"),
        F.count_if(F.col("claim_type") == "conflict").alias("open_conflicts"),
    )


def preflight_items(claims: DataFrame, path: str, task: str | None = None) -> DataFrame:
    """The rows behind :func:`preflight`, each with its bucket."""
    rule = F.col("claim_type").isin("always-on-rule", "scoped-rule")
    if task:
        rule = rule & F.arrays_overlap("applicability", F.array(F.lit("all"), F.lit(task)))
    bucket = (
        F.when(rule, "rule")
        .when(F.col("claim_type") == "validated-command", "command")
        .when(F.col("claim_type") == "permission-restriction", "guardrail")
        .when(F.col("claim_type") == "conflict", "conflict")
    )
    rows = filters.output_gate(claims.filter(F.col("scope").isin(path, "**")))
    return rows.withColumn("bucket", bucket).filter("bucket IS NOT NULL")


def audit(
    history: DataFrame,
    claims: DataFrame,
    scope: str | None = None,
    claim_id: str | None = None,
    action: str | None = None,
    since: Column | None = None,
    limit: int = 50,
) -> DataFrame:
    """Decision log, all filters before the limit."""
    if scope is not None:
        inside = filters.scope_prefix_filter(claims, scope, with_global=True)
        history = history.join(inside.select(*CLAIM_KEY).distinct(), CLAIM_KEY, "left_semi")
    return ordering.recent_history(history, limit, claim_id, action, since)


def history_by_scope(history: DataFrame, claims: DataFrame, scope: str) -> DataFrame:
    """Decision rows of the claims under a scope prefix (or global), with the claim's scope."""
    inside = filters.scope_prefix_filter(claims, scope, with_global=True)
    scopes = inside.select(*CLAIM_KEY, F.col("scope").alias("claim_scope"))
    return history.drop("scope").join(scopes, CLAIM_KEY)


def response_freshness(rows: DataFrame, repos: DataFrame, as_of: Column) -> DataFrame:
    """Stale rows in a result, index age and whether the head still is the indexed one."""
    stale = rows.groupBy("repo_id").agg(F.count_if("stale").alias("stale_in_response"))
    age = F.unix_timestamp(as_of) - F.unix_timestamp("last_indexed")
    head = F.col("head_at_index") == F.col("head_now")
    return stale.join(repos, "repo_id", "left").select(
        "repo_id", "stale_in_response", age.alias("index_age_seconds"), head.alias("head_current")
    )


def claim_with_chain(claims: DataFrame, evidence: DataFrame, history: DataFrame) -> DataFrame:
    """Claim with its evidence and decision totals, folded before the joins.

    The rows of the chain stay in their own tables (same key); a claim with very
    many of them is never gathered into one array.
    """
    chain = evidence.groupBy(*CLAIM_KEY).agg(
        F.count(F.lit(1)).alias("evidence_rows"),
        F.count_distinct("file_path").alias("evidence_files"),
        F.min("file_path").alias("first_file"),
    )
    log = history.groupBy(*CLAIM_KEY).agg(
        F.count(F.lit(1)).alias("decisions"),
        F.max_by("action", F.struct("ts", "event_id")).alias("last_action"),
    )
    return (
        claims.join(chain, CLAIM_KEY, "left")
        .join(log, CLAIM_KEY, "left")
        .fillna(0, ["evidence_rows", "evidence_files", "decisions"])
    )


def claim_chain_rows(claims: DataFrame, evidence: DataFrame, history: DataFrame) -> DataFrame:
    """Evidence and decisions of the given claims as one ordered relation."""
    wanted = claims.select(*CLAIM_KEY).distinct()
    proof = evidence.select(
        *CLAIM_KEY, F.lit("evidence").alias("part"),
        F.concat_ws(":", "file_path", "line_start", "line_end").alias("item"),
    )
    log = history.select(
        *CLAIM_KEY, F.lit("history").alias("part"),
        F.concat_ws(":", "action", "actor", F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("item"),
    )
    return proof.unionByName(log).join(wanted, CLAIM_KEY, "left_semi")


def repo_overview(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claim counts by type and state, languages and indexed files per repository."""
    shown = filters.output_gate(claims)
    by_type = [
        F.count_if(F.col("claim_type") == c).alias(f"n_{c.replace('-', '_')}") for c in dims.CLAIM_TYPES
    ]
    by_state = [
        F.count_if(F.col("review_state") == s).alias(f"n_{s.replace('-', '_')}")
        for s in dims.REVIEW_STATES[:4]
    ]
    counts = shown.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total"), *by_type, *by_state)
    paths = (
        evidence.join(shown.select(*CLAIM_KEY).distinct(), CLAIM_KEY, "left_semi")
        .select("repo_id", "file_path").distinct()
        .withColumn("language", base.lookup(F.lower(F.regexp_extract("file_path", r"\.([^.]*)$", 1)), dims.LANGUAGE_BY_SUFFIX))
    )
    # languages come from a fixed list, so the set stays small
    files = paths.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("indexed_files"),
        F.array_join(F.array_sort(F.collect_set("language")), "|").alias("languages"),
    )
    return counts.join(files, "repo_id", "left")


def entrypoints(claims: DataFrame) -> DataFrame:
    return filters.output_gate(filters.list_claims(claims, claim_type="validated-command")).select(
        "repo_id", F.col("content").alias("command")
    ).distinct()


def status_rollup(claims: DataFrame) -> DataFrame:
    """Counts and mean confidence by type, by state and in total, per repository."""
    grouped = claims.groupingSets(
        [["repo_id", "claim_type"], ["repo_id", "review_state"], ["repo_id"]],
        "repo_id", "claim_type", "review_state",
    )
    return grouped.agg(
        F.count(F.lit(1)).alias("claims"), base.exact_mean(F.col("confidence")).alias("mean_confidence")
    )
