"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sources take part by weight in a budget of words. A target never exceeds ``epochs`` times its source; what a capped
source cannot take goes to the others by weight. With the sources in the order of cap over weight this has a closed
form: going up, a source is capped as long as its cap is at most its share of what is left, and the first that is not
fixes the level ``target / weight`` of all that follow.

A source that takes ``e`` epochs takes each document ``floor(e)`` times, and once more those whose seeded hash lies below
a threshold. The threshold is found from sums over hash ranges, then inside the one range where the sum crosses, so no
source is ever ordered as a whole; documents meet their source's row by a join with a table of one row per source.

Defined cases: a null text has size 0; null sources form one source, the last; rows with the same id share their fate;
a null id is replaced by the hash of its text; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import packed_row, stored, WORD

EPOCHS = 3.0
SEED = 17
RANGE_BITS = 12


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


PLACE_BITS = 60


def _place(seed: int) -> Column:
    """Seeded position of a document in [0, 2^60): the first 15 hex digits of an MD5, which any engine can compute."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, PLACE_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``(doc_id, source, size, _place)``: the narrow rows that all sums are taken over."""
    return docs.select("doc_id", "source", size_of("text").alias("size"), _place(seed).alias("_place"))


def weights_by_order(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, along the sources by code point, null last. One row per source comes in."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", ((rank - 1) % 3 + 1).cast("double"))


def water_filled(sources: DataFrame, epochs: float = EPOCHS) -> DataFrame:
    """Adds ``target`` to ``(source, source_size, weight)``; the budget is the sum of all sizes."""
    total = Window.partitionBy()
    up = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(epochs)
    left = F.sum("source_size").over(total) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    stepped = sources.select("*", cap.alias("_cap"), (left / weight_left).alias("_level"), F.row_number().over(up).alias("_step"))
    free = F.col("_cap") > F.col("weight") * F.col("_level")
    level = F.min(F.when(free, F.struct("_step", "_level"))).over(total)["_level"]
    target = F.when(free, F.least("_cap", F.col("weight") * level)).otherwise(F.col("_cap"))
    return stepped.select(*sources.columns, target.alias("target"))


def plan(rows: DataFrame, weights: DataFrame | None = None, epochs: float = EPOCHS) -> DataFrame:
    """One row per source: size, weight, target, whole repetitions, and the hash below which one more is taken.

    ``weights(source, weight)`` may state positive weights; without it they go 1, 2, 3 by the order of the sources.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        weighed = weights_by_order(sums)
    else:
        stated = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("weight"))
        weighed = sums.join(stated, sums["source"].eqNullSafe(stated["_source"])).drop("_source")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = stored(
        water_filled(weighed, epochs)
        .withColumn("repeats", F.floor(share).cast("long"))
        .withColumn("_rest", F.col("target") - F.col("repeats") * F.col("source_size")),
        "mix-targets",
    )
    shift = PLACE_BITS - RANGE_BITS
    ranges = rows.groupBy("source", F.shiftright("_place", shift).alias("_range")).agg(F.sum("size").alias("_words"))
    along = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    keyed = targets.select(F.col("source").alias("_key"), "_rest")
    cut = (
        ranges.withColumnRenamed("source", "_source")
        .join(keyed, F.col("_source").eqNullSafe(F.col("_key")))
        .withColumn("_before", F.coalesce(F.sum("_words").over(along), F.lit(0)))
        .filter("_before <= _rest AND _rest < _before + _words")
        .select("_key", F.col("_range").alias("_at"), (F.col("_rest") - F.col("_before")).alias("_open"))
    )
    inside = rows.withColumn("_r", F.shiftright("_place", shift)).join(
        stored(cut, "mix-cut"), F.col("source").eqNullSafe(F.col("_key")) & (F.col("_r") == F.col("_at"))
    )
    fine = Window.partitionBy("_key").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    first_out = (
        inside.groupBy("_key", "_at", "_open", "_place").agg(F.sum("size").alias("_words"))
        .withColumn("_before", F.coalesce(F.sum("_words").over(fine), F.lit(0)))
        .withColumn("_in", F.col("_before") + F.col("_words") / 2 <= F.col("_open"))
        .groupBy("_key", "_at")
        .agg(F.min(F.when(~F.col("_in"), F.col("_place"))).alias("_first"))
        .select("_key", F.coalesce("_first", F.shiftleft(F.col("_at") + 1, shift) - 1).alias("below"))
    )
    # a source that needs nothing more than whole repetitions has its range at the start, with nothing below
    return stored(
        targets.join(first_out, targets["source"].eqNullSafe(first_out["_key"]), "left")
        .select("source", "source_size", "weight", "target", "repeats", F.coalesce("below", F.lit(0)).alias("below")),
        "mix-plan",
    )


def taken(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Adds the source's row and ``copies``, the number of times the mix takes the document. ``rows`` has ``_place``."""
    per = planned.select(F.col("source").alias("_key"), "source_size", "weight", "target", "repeats", "below")
    copies = F.col("repeats") + F.when(F.col("_place") < F.col("below"), 1).otherwise(0)
    return rows.join(per, F.col("source").eqNullSafe(F.col("_key"))).withColumn("copies", copies.cast("long")).drop("_key")


def mix(docs: DataFrame, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per document: its size, its source's size and target, its copies and the words the mix takes."""
    rows = stored(sized(docs, seed), "mix-sizes")
    return taken(rows, plan(rows, epochs=epochs)).select(
        "doc_id", "source", "size", "source_size", "weight", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed(docs: DataFrame, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """The documents that the mix takes, whole, with ``mix_copies``, the times each is to be read.

    A column ``mix_copies`` that comes in is replaced; all others pass through, whatever their names.
    """
    planned = plan(stored(sized(docs, seed), "mix-sizes"), epochs=epochs)
    per = planned.select(F.col("source").alias("mixed_source"), "repeats", "below")
    rows = docs.select(packed_row(docs.drop("mix_copies")).alias("row"), F.col("source").alias("own_source"), _place(seed).alias("own_place"))
    copies = F.col("repeats") + F.when(F.col("own_place") < F.col("below"), 1).otherwise(0)
    joined = rows.join(per, F.col("own_source").eqNullSafe(F.col("mixed_source"))).withColumn("mix_copies", copies.cast("long"))
    return joined.filter("mix_copies > 0").select("row.*", "mix_copies")
