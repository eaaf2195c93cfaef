"""Evidence against current files, snapshot differences and claim freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import dims
from attesta.functions.base import days_between

CLAIM_KEY = ["repo_id", "claim_id"]


def evidence_state(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """deleted / changed / current per evidence row; an empty stored hash is never a change."""
    now = files.select("repo_id", F.col("path").alias("file_path"), F.col("blob_hash").alias("now_hash"))
    state = (
        F.when(F.col("now_hash").isNull(), "deleted")
        .when((F.col("file_hash") != "") & (F.col("file_hash") != F.col("now_hash")), "changed")
        .otherwise("current")
    )
    return evidence.join(now, ["repo_id", "file_path"], "left").withColumn("state", state)


def evidence_flags(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Counts per claim; identical evidence is folded before the file join."""
    distinct = evidence.select(*CLAIM_KEY, "file_path", "file_hash").distinct()
    return evidence_state(distinct, files).groupBy(*CLAIM_KEY).agg(
        F.count_if(F.col("state") == "deleted").alias("n_deleted"),
        F.count_if(F.col("state") == "changed").alias("n_changed"),
    )


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """added / removed / modified paths between two snapshots."""
    before = old.select("repo_id", "path", F.col("blob_hash").alias("old_hash"))
    after = new.select("repo_id", "path", F.col("blob_hash").alias("new_hash"))
    change = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") != F.col("new_hash"), "modified")
    )
    return (
        before.join(after, ["repo_id", "path"], "full_outer")
        .withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .select("repo_id", "path", "change")
    )


def check_freshness(
    claims: DataFrame,
    evidence: DataFrame,
    files: DataFrame,
    repos: DataFrame,
    as_of: Column,
    window_days: int = dims.STALE_DAYS,
    cited: DataFrame | None = None,
    changed: DataFrame | None = None,
) -> DataFrame:
    """First trigger that applies: time, branch, deleted evidence, changed evidence.

    Claims without evidence rows fall back to ``cited`` (repo, claim, path) against
    ``changed`` paths of the repository, when both are given.
    """
    days = days_between(as_of, F.coalesce("last_validated", "created_at"))
    flags = evidence_flags(evidence, files)
    heads = repos.select("repo_id", "branch_at_index", "branch_now")
    out = claims.join(flags, CLAIM_KEY, "left").join(heads, "repo_id", "left")
    fallback = F.lit(False)
    if cited is not None and changed is not None:
        touched = (
            cited.join(changed.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
            .select(*CLAIM_KEY).distinct().withColumn("cited_change", F.lit(True))
        )
        out = out.join(touched, CLAIM_KEY, "left")
        fallback = F.col("n_deleted").isNull() & F.col("cited_change").isNotNull()
    trigger = (
        F.when(F.coalesce(days, F.lit(0)) > window_days, "time-expired")
        .when(F.col("branch_at_index") != F.col("branch_now"), "branch-changed")
        .when(F.col("n_deleted") > 0, "evidence-deleted")
        .when((F.col("n_changed") > 0) | fallback, "evidence-changed")
    )
    return out.select(
        *CLAIM_KEY,
        F.coalesce(days, F.lit(0)).alias("days_since"),
        trigger.alias("trigger"),
        trigger.isNotNull().alias("stale"),
    )


def freshness_report(freshness: DataFrame, repos: DataFrame) -> DataFrame:
    """Totals per repository, stale counts by trigger, and whether branch or head moved."""
    triggers = ("time-expired", "branch-changed", "evidence-deleted", "evidence-changed")
    counts = freshness.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("stale").alias("stale"),
        *[F.count_if(F.col("trigger") == t).alias("n_" + t.replace("-", "_")) for t in triggers],
    )
    heads = repos.select(
        "repo_id",
        (F.col("branch_at_index") != F.col("branch_now")).alias("branch_changed"),
        (F.col("head_at_index") != F.col("head_now")).alias("head_changed"),
    )
    return counts.withColumn("fresh", F.col("total") - F.col("stale")).join(heads, "repo_id", "left")


def drift(artifacts: DataFrame, disk: DataFrame) -> DataFrame:
    """drifted / clean / missing / unmanaged per file. ``disk`` carries a ``disk_hash``."""
    tracked = artifacts.select("repo_id", "path", "expected_hash", "ownership_mode")
    status = (
        F.when(F.col("expected_hash").isNull(), "unmanaged")
        .when(F.col("disk_hash").isNull(), "missing")
        .when(F.col("expected_hash") != F.col("disk_hash"), "drifted")
        .otherwise("clean")
    )
    return tracked.join(disk, ["repo_id", "path"], "full_outer").withColumn("status", status)
