"""Filters and projections over claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import dims
from attesta.functions import base, scopes

CLAIM_KEY = ["repo_id", "claim_id"]


def list_claims(
    claims: DataFrame,
    scope: str | None = None,
    claim_type: str | None = None,
    review_state: str | None = None,
    repo_id: str | None = None,
) -> DataFrame:
    wanted = {
        "scope": scope,
        "claim_type": claim_type,
        "review_state": review_state,
        "repo_id": repo_id,
    }
    for column, value in wanted.items():
        if value is not None:
            claims = claims.filter(F.col(column) == value)
    return claims


def scope_filter(claims: DataFrame, path: str) -> DataFrame:
    return claims if path == "**" else claims.filter(F.col("scope").isin(path, "**"))


def scope_prefix_filter(claims: DataFrame, prefix: str, with_global: bool = False) -> DataFrame:
    cond = F.col("scope").startswith(prefix)
    return claims.filter(cond | (F.col("scope") == "**") if with_global else cond)


def task_filter(claims: DataFrame, tag: str) -> DataFrame:
    return claims.filter(F.arrays_overlap("applicability", F.array(F.lit("all"), F.lit(tag))))


def visible(claims: DataFrame) -> DataFrame:
    return claims.filter(~F.col("review_state").isin(*dims.HIDDEN_STATES))


def sensitivity_verdict(claims: DataFrame, target: str) -> DataFrame:
    """Every claim with ``included`` and the reason when it is not."""
    ok = base.sensitivity_rank(F.col("sensitivity")) <= dims.SENSITIVITY_RANK[target]
    reason = F.concat(
        F.lit("sensitivity "), F.col("sensitivity"), F.lit(f" exceeds target {target}")
    )
    return claims.withColumn("included", ok).withColumn("reason", F.when(~ok, reason))


def for_target(claims: DataFrame, target: str = "public") -> DataFrame:
    return claims.filter(
        base.sensitivity_rank(F.col("sensitivity")) <= dims.SENSITIVITY_RANK[target]
    )


def allowlist(
    claims: DataFrame,
    sources: tuple[str, ...] = dims.TRUSTED_SOURCES,
    dirs: tuple[str, ...] = ("**",),
    evidence: DataFrame | None = None,
) -> DataFrame:
    """Trusted authorities; with directories, some evidence path must match one.

    The path test is folded to one flag per claim before the join, so no claim
    carries its evidence list.
    """
    kept = claims.filter(F.col("source_authority").isin(*sources))
    if dirs == ("**",) or evidence is None:
        return kept
    pattern = "|".join(scopes.glob_regex(g) for g in dirs)
    flags = evidence.groupBy(*CLAIM_KEY).agg(
        F.bool_or(F.col("file_path").rlike(pattern)).alias("in_allowed_dir")
    )
    return (
        kept.join(flags, CLAIM_KEY, "left")
        .filter(F.coalesce("in_allowed_dir", F.lit(True)))
        .drop("in_allowed_dir")
    )


def output_gate(claims: DataFrame, sources: tuple[str, ...] = dims.TRUSTED_SOURCES) -> DataFrame:
    """What may leave the system: not hidden, trusted, public."""
    return for_target(allowlist(visible(claims), sources), "public")


def confidence_verdict(claims: DataFrame, minimum: float) -> DataFrame:
    ok = F.col("confidence") >= minimum
    reason = F.concat(
        F.lit("confidence "), F.format_number("confidence", 2), F.lit(f" below {minimum:.2f}")
    )
    return claims.withColumn("included", ok).withColumn("reason", F.when(~ok, reason))


def approved_only(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("review_state").isin(*dims.APPROVED_STATES))


def review_queue(
    claims: DataFrame,
    state: str | None = None,
    claim_type: str | None = None,
    scope_prefix: str | None = None,
) -> DataFrame:
    states = (state,) if state else ("unreviewed", "needs-declaration")
    out = claims.filter(F.col("review_state").isin(*states))
    if claim_type:
        out = out.filter(F.col("claim_type") == claim_type)
    return scope_prefix_filter(out, scope_prefix) if scope_prefix else out


def batch_approve(claims: DataFrame, as_of: Column, threshold: float = dims.STRONG) -> DataFrame:
    """Decision rows for confident claims of strong authority still unreviewed."""
    chosen = claims.filter(
        (F.col("confidence") >= threshold)
        & F.col("source_authority").isin(*dims.BATCH_APPROVE_AUTHORITY)
        & (F.col("review_state") == "unreviewed")
    )
    return chosen.select(
        *CLAIM_KEY, F.lit("approved").alias("action"), as_of.alias("ts"), F.lit("human").alias("actor")
    )


def with_high_authority(claims: DataFrame) -> DataFrame:
    return claims.withColumn(
        "high_authority", F.col("source_authority").isin(*dims.HIGH_AUTHORITY)
    )


def with_enforcement(claims: DataFrame, host: str | None = None) -> DataFrame:
    flag = scopes.enforceable(F.col("claim_type"), F.col("confidence"), F.col("content"))
    hosts = F.when(flag, F.array(F.lit("claude"), F.lit("copilot"))).otherwise(
        F.array().cast("array<string>")
    )
    active = "tool-allowlist" if host == "copilot" else "settings.json permissions.deny"
    return claims.withColumn("enforceable", flag).withColumn("enforceable_on", hosts).withColumn(
        "mechanism", F.when(flag, active).otherwise("advisory text only")
    )


def render_claims(claims: DataFrame, detail: str = "normal") -> DataFrame:
    """Column sets of the three detail levels."""
    if detail == "terse":
        return claims.select(
            "repo_id", "claim_id", base.preview(F.col("content")).alias("content_preview"),
            "claim_type", "confidence",
        )
    normal = [
        "repo_id", "claim_id", "content", "claim_type", "source_authority", "confidence", "scope",
        "applicability", "review_state", "risk_class",
    ]
    if detail != "detailed":
        return claims.select(*normal)
    return claims.select(
        *normal, "stale", "last_validated",
        F.when(F.col("stale"), base.effective_confidence(F.col("confidence"), F.col("stale"))).alias(
            "effective_confidence"
        ),
    )


def claim_verdict(claims: DataFrame, sources: tuple[str, ...] = dims.TRUSTED_SOURCES) -> DataFrame:
    """Status a point lookup of each claim would answer with."""
    status = (
        F.when(F.col("review_state").isin(*dims.HIDDEN_STATES), "hidden")
        .when(~F.col("source_authority").isin(*sources), "not-allowlisted")
        .when(F.col("sensitivity") == "local-only", "local-only")
        .otherwise("ok")
    )
    return claims.withColumn("status", status)


def get_claim(claims: DataFrame, wanted: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """Point lookups: every wanted key gets a status, also the unknown ones."""
    found = claim_verdict(claims, sources).select(*CLAIM_KEY, "content", "status")
    return wanted.join(found, CLAIM_KEY, "left").withColumn(
        "status", F.coalesce("status", F.lit("not-found"))
    )


def split_valid_ids(decisions: DataFrame, column: str = "claim_id") -> DataFrame:
    ok = F.col(column).rlike(r"^[a-zA-Z0-9][a-zA-Z0-9_-]*$") & ~F.col(column).contains("..")
    return decisions.withColumn("valid", ok)
