"""Human decisions: replay, timelines, illegal moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta import dims
from attesta.operators.maintenance import first_by

CLAIM_KEY = ["repo_id", "claim_id"]


def last_decision(decisions: DataFrame) -> DataFrame:
    """Latest non-declared decision per claim."""
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    return first_by(decisions.filter(F.col("action") != "declared"), CLAIM_KEY, order)


def apply_overrides(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """Claims with the state and text of their last decision."""
    last = last_decision(decisions).select(
        *CLAIM_KEY, F.col("action").alias("decided"), F.col("content_after").alias("edited")
    )
    return (
        claims.join(last, CLAIM_KEY, "left")
        .withColumn("review_state", F.coalesce("decided", "review_state"))
        .withColumn(
            "content",
            F.when(F.col("decided") == "edited", F.coalesce("edited", "content")).otherwise(F.col("content")),
        )
        .drop("decided", "edited")
    )


def skipped_decisions(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions on claims the store does not know."""
    return last_decision(decisions).join(claims.select(*CLAIM_KEY).distinct(), CLAIM_KEY, "left_anti")


def declared_claims(decisions: DataFrame) -> DataFrame:
    """Rules a human declared: reviewed, approved, certain. A later declaration replaces an earlier one."""
    kind = F.coalesce(
        F.when(F.col("claim_type").isin(*dims.CLAIM_TYPES), F.col("claim_type")), F.lit("always-on-rule")
    )
    last = first_by(
        decisions.filter(F.col("action") == "declared"),
        CLAIM_KEY,
        [F.col("ts").desc(), F.col("event_id").desc()],
    )
    return last.select(
        *CLAIM_KEY,
        F.coalesce("content", F.lit("")).alias("content"),
        kind.alias("claim_type"),
        F.coalesce("scope", F.lit("**")).alias("scope"),
        F.lit("declared-reviewed").alias("source_authority"),
        F.lit("approved").alias("review_state"),
        F.lit(1.0).alias("confidence"),
    )


def state_timeline(history: DataFrame) -> DataFrame:
    """Each decision with the one before and after it on the same claim.

    The window runs per (claim, day); day edges are stitched from one summary row
    per day, so a claim with very many decisions is still spread over tasks.
    """
    keyed = history.withColumn("day", F.to_date("ts"))
    inside = Window.partitionBy(*CLAIM_KEY, "day").orderBy("ts", "event_id")
    local = (
        keyed.withColumn("prev_in_day", F.lag("action").over(inside))
        .withColumn("next_ts_in_day", F.lead("ts").over(inside))
    )
    stamp = F.struct("ts", "event_id")
    days = keyed.groupBy(*CLAIM_KEY, "day").agg(
        F.max_by("action", stamp).alias("last_action"), F.min("ts").alias("first_ts")
    )
    across = Window.partitionBy(*CLAIM_KEY).orderBy("day")
    edges = days.select(
        *CLAIM_KEY, "day",
        F.lag("last_action").over(across).alias("prev_day_action"),
        F.lead("first_ts").over(across).alias("next_day_ts"),
    )
    previous = F.coalesce("prev_in_day", "prev_day_action")
    return local.join(edges, [*CLAIM_KEY, "day"]).select(
        *CLAIM_KEY, "event_id", "action", "ts",
        previous.alias("previous_action"),
        F.coalesce("next_ts_in_day", "next_day_ts").alias("until"),
        F.coalesce(previous.isin("tombstoned"), F.lit(False)).alias("illegal"),
    )
