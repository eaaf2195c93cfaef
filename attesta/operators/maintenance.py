"""Deduplication, last-write-wins upserts, merges and purges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta import dims
from attesta.functions.base import lookup

CLAIM_KEY = ["repo_id", "claim_id"]


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key. ``row_number() = 1`` is cut on the map side too, so a hot key ships one row per task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def dedup_first(claims: DataFrame) -> DataFrame:
    """First sighting of a claim in (phase, ordinal) order wins."""
    return first_by(claims, CLAIM_KEY, [F.col("phase").asc(), F.col("ordinal").asc()])


def assemble_claims(parts: list[DataFrame]) -> DataFrame:
    """All extractor outputs with the phase they came from."""
    tagged = [df.withColumn("phase", F.lit(i)) for i, df in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def resolve_by_precedence(claims: DataFrame) -> DataFrame:
    """Winning claim per (repo, type, scope)."""
    order = [F.col("authority_level").asc(), F.col("confidence").desc(), F.col("claim_id").asc()]
    return first_by(claims, ["repo_id", "claim_type", "scope"], order)


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last write wins per key; the incoming row wins a tie."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return first_by(both, keys, [F.col(version).desc(), F.col("_new").desc()]).drop("_new")


def delete_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def split_duplicates(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New claims with ``duplicate`` set when the store or an earlier new row has the id."""
    known = existing.select(*CLAIM_KEY).distinct().withColumn("known", F.lit(True))
    firsts = dedup_first(new).select(*CLAIM_KEY, F.col("ordinal").alias("first_ordinal"), F.col("phase").alias("first_phase"))
    return (
        new.join(firsts, CLAIM_KEY)
        .join(known, CLAIM_KEY, "left")
        .withColumn(
            "duplicate",
            F.col("known").isNotNull()
            | (F.col("ordinal") != F.col("first_ordinal"))
            | (F.col("phase") != F.col("first_phase")),
        )
        .drop("known", "first_ordinal", "first_phase")
    )


def id_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """new / removed / common per claim key."""
    old = before.select(*CLAIM_KEY).distinct().withColumn("in_old", F.lit(True))
    new = after.select(*CLAIM_KEY).distinct().withColumn("in_new", F.lit(True))
    change = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "removed")
    return old.join(new, CLAIM_KEY, "full_outer").select(
        *CLAIM_KEY, change.otherwise("common").alias("change")
    )


def refresh_diff(before: DataFrame, after: DataFrame, stale: DataFrame) -> DataFrame:
    """One change label per claim: new, removed, updated, stale or stable."""
    old = before.select(*CLAIM_KEY, F.col("content").alias("old_content"))
    new = after.select(*CLAIM_KEY, F.col("content").alias("new_content"))
    flagged = stale.select(*CLAIM_KEY).distinct().withColumn("is_stale", F.lit(True))
    change = (
        F.when(F.col("old_content").isNull(), "new")
        .when(F.col("new_content").isNull(), "removed")
        .when(F.col("old_content") != F.col("new_content"), "updated")
        .when(F.col("is_stale").isNotNull(), "stale")
        .otherwise("stable")
    )
    return (
        old.join(new, CLAIM_KEY, "full_outer")
        .join(flagged, CLAIM_KEY, "left")
        .select(*CLAIM_KEY, change.alias("change"))
    )


def merge_claims(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The id stays; incoming content, authority and confidence win; merged rows are fresh.

    Evidence level and confidence never go down, so a CI sighting upgrades the
    configured command it matches.
    """
    rank = {level: i for level, i in dims.EVIDENCE_RANK.items()}
    old = existing.select(
        *CLAIM_KEY, *[F.col(c).alias(f"o_{c}") for c in ("content", "source_authority", "confidence", "evidence_level", "stale")]
    )
    new = incoming.select(
        *CLAIM_KEY, *[F.col(c).alias(f"n_{c}") for c in ("content", "source_authority", "confidence", "evidence_level")]
    )
    hi = F.coalesce(lookup(F.col("n_evidence_level"), rank), F.lit(-1)) >= F.coalesce(
        lookup(F.col("o_evidence_level"), rank), F.lit(-1)
    )
    return old.join(new, CLAIM_KEY, "full_outer").select(
        *CLAIM_KEY,
        F.coalesce("n_content", "o_content").alias("content"),
        F.coalesce("n_source_authority", "o_source_authority").alias("source_authority"),
        F.greatest("n_confidence", "o_confidence").alias("confidence"),
        F.when(hi, F.col("n_evidence_level")).otherwise(F.col("o_evidence_level")).alias("evidence_level"),
        F.when(F.col("n_content").isNotNull(), F.lit(False)).otherwise(F.col("o_stale")).alias("stale"),
    )


def purge_tombstoned(
    claims: DataFrame, dependents: dict[str, DataFrame]
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the tombstoned claims, and the log rows of what went."""
    gone = claims.filter(F.col("review_state") == "tombstoned").select(*CLAIM_KEY).distinct()
    kept = {"claims": delete_keys(claims, gone, CLAIM_KEY)}
    kept |= {name: delete_keys(df, gone, CLAIM_KEY) for name, df in dependents.items()}
    log = gone.select(
        F.lit("purge").alias("session_id"), F.lit("purge").alias("event_type"), *CLAIM_KEY
    )
    return kept, log


def mark_stale(claims: DataFrame, freshness: DataFrame) -> DataFrame:
    """Set the stale flag and trigger of claims found stale; leave the rest alone."""
    found = freshness.filter("stale").select(*CLAIM_KEY, F.col("trigger").alias("found_trigger"))
    hit = F.col("found_trigger").isNotNull()
    return claims.join(found, CLAIM_KEY, "left").withColumn("stale", F.col("stale") | hit).withColumn(
        "revalidation_trigger", F.col("found_trigger")
    ).drop("found_trigger")


def revalidate(claims: DataFrame, extracted: DataFrame, as_of: Column) -> DataFrame:
    """An unchanged re-extraction clears the stale flag."""
    again = extracted.select(*CLAIM_KEY, F.col("content").alias("again")).distinct()
    same = F.col("stale") & (F.col("again") == F.col("content"))
    same = F.coalesce(same, F.lit(False))
    return (
        claims.join(again, CLAIM_KEY, "left")
        .withColumn("last_validated", F.when(same, as_of).otherwise(F.col("last_validated")))
        .withColumn("stale", F.col("stale") & ~same)
        .drop("again")
    )


def audit_rows(freshness: DataFrame, as_of: Column) -> DataFrame:
    """History rows for claims that turned stale; the id is a hash, not a counter."""
    return freshness.filter("stale").select(
        F.sha2(F.concat_ws(":", "repo_id", "claim_id", F.lit("stale"), as_of.cast("string")), 256).alias("event_id"),
        *CLAIM_KEY, F.lit("stale").alias("action"), F.lit("system").alias("actor"),
        as_of.alias("ts"), F.col("trigger").alias("reason"),
    )
