"""Orders, keyset pages and top-k reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta import dims
from attesta.session import checkpointed

STABLE = ["authority_level", "scope", "claim_type", "claim_id"]


def priority() -> list[Column]:
    return [F.col("authority_level").asc(), F.col("confidence").desc(), F.col("claim_id").asc()]


def review_order() -> list[Column]:
    first = F.when(F.col("review_state") == "needs-declaration", 0).otherwise(1)
    return [first.asc(), F.col("confidence").desc(), F.col("claim_id").asc()]


def _clamped(limit: int) -> int:
    """The range of the page parameter: 1 to ``MAX_PAGE``, the nearest end for others."""
    return max(1, min(limit, dims.MAX_PAGE))


def _page(rows: DataFrame, total: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """First ``limit`` rows in key order, flagged when more follow (at most 501 rows are ordered).

    ``total`` is a second pass over the rows; a reader that does not select it does not pay for it.
    """
    size = _clamped(limit)
    ahead = rows.orderBy(*keys).limit(size + 1)
    numbered = ahead.withColumn("position", F.row_number().over(Window.orderBy(*keys)))
    more = F.max("position").over(Window.partitionBy()) > size
    return (
        numbered.withColumn("has_more", more)
        .filter(F.col("position") <= size)
        .withColumn("total", total.agg(F.count(F.lit(1))).scalar())
    )


def page(rows: DataFrame, limit: int = 50, cursor: tuple[str, str] | None = None) -> DataFrame:
    """Keyset page in (claim_id, repo_id) order."""
    after = rows
    if cursor is not None:
        after = rows.filter(
            (F.col("claim_id") > cursor[0])
            | ((F.col("claim_id") == cursor[0]) & (F.col("repo_id") > cursor[1]))
        )
    return _page(after, rows, ["claim_id", "repo_id"], limit)


def page_by_precedence(
    rows: DataFrame, limit: int = 50, cursor: tuple[int, str, str] | None = None
) -> DataFrame:
    """Keyset page in (authority, id, repo) order; the cursor carries the whole key."""
    after = rows
    if cursor is not None:
        level, cid, repo = F.col("authority_level"), F.col("claim_id"), F.col("repo_id")
        after = rows.filter(
            (level > cursor[0])
            | ((level == cursor[0]) & (cid > cursor[1]))
            | ((level == cursor[0]) & (cid == cursor[1]) & (repo > cursor[2]))
        )
    return _page(after, rows, ["authority_level", "claim_id", "repo_id"], limit)


def recent_history(
    history: DataFrame,
    limit: int = 50,
    claim_id: str | None = None,
    action: str | None = None,
    since: Column | None = None,
) -> DataFrame:
    """Newest rows first; every filter applies before the limit."""
    if claim_id:
        history = history.filter(F.col("claim_id") == claim_id)
    if action:
        history = history.filter(F.col("action") == action)
    if since is not None:
        history = history.filter(F.col("ts") >= since)
    return history.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(limit)


def placed(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """All rows with ``rank``, their place in the order of their group.

    Rows are dealt by ranges of (group, order), so a large group spreads over tasks: the place is the place inside the
    range plus what earlier ranges hold of the group.
    """
    ranged = checkpointed(rows.repartitionByRange(*[F.col(c).asc() for c in by], *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    # null is a group like any other
    earlier = offsets.select(F.col("_part").alias("_of"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_before")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)), F.col("_part") == F.col("_of"))
    met = ranged.withColumn("_inside", inside).join(earlier, same)
    return met.select(*rows.columns, (F.col("_inside") + F.col("_before")).alias("rank"))


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per group; the rank limit is applied before the shuffle as well."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)
