"""Structured Streaming versions of the append logs and of the refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.base import exact_mean
from attesta.operators import security
from attesta.session import shared_folder

CLAIM_KEY = ["repo_id", "claim_id"]
SKETCH_K = 400


def history_counts(history: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Decisions per hour and action; an hour comes out when the watermark passes it, rows later than that are dropped."""
    return (
        history.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 hour").alias("w"), "action")
        .agg(F.count(F.lit(1)).alias("decisions"))
        .select(F.col("w.start").alias("hour"), "action", "decisions")
    )


def tool_sessions(traces: DataFrame, gap: str = "15 minutes", lateness: str = "1 hour", k: int = SKETCH_K) -> DataFrame:
    """Sessions of calls with a gap of silence between them.

    ``latencies`` is a KLL sketch of the session's durations; sketches of any sessions can be merged (``merged_latency``).
    ``p95_ms`` is read from it: exact up to ``k`` calls, beyond that off by about 2 / ``k`` in rank.
    """
    return (
        traces.withWatermark("ts", lateness)
        .groupBy(F.session_window("ts", gap).alias("w"), "session_id")
        .agg(
            F.count(F.lit(1)).alias("calls"), F.sum("response_size_bytes").alias("bytes"), F.max("duration_ms").alias("slowest_ms"),
            F.kll_sketch_agg_double(F.col("duration_ms").cast("double"), F.lit(k)).alias("latencies"),
        )
        .select(
            "session_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "calls", "bytes", "slowest_ms",
            quantile("latencies", 0.95).alias("p95_ms"), "latencies",
        )
    )


def quantile(sketch: str, rank: float) -> Column:
    """The value of a rank; null for a sketch that has seen nothing."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(rank)))


def merged_latency(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Latency quantiles over the sessions of a key, from their sketches alone."""
    merged = sessions.groupBy(*keys).agg(F.sum("calls").alias("calls"), F.kll_merge_agg_double("latencies").alias("latencies"))
    return merged.select(*keys, "calls", quantile("latencies", 0.5).alias("p50_ms"), quantile("latencies", 0.95).alias("p95_ms"))


def sliding_latency(traces: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Latency per tool over ten minutes, every five."""
    return (
        traces.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "10 minutes", "5 minutes").alias("w"), "tool_name")
        .agg(F.count(F.lit(1)).alias("calls"), exact_mean(F.col("duration_ms")).alias("mean_ms"), F.max("duration_ms").alias("max_ms"))
        .select(F.col("w.start").alias("started"), "tool_name", "calls", "mean_ms", "max_ms")
    )


def dedup_claims(claims: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """First sighting of a claim; the state is dropped once the watermark has passed."""
    return claims.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(CLAIM_KEY)


def secret_alerts(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Secret findings in arriving texts, stateless."""
    found = security.secret_hits(texts, [key], text)
    return found.select(key, "pattern_type", "line", F.sha2("value", 256).alias("value_hash"))


def refresh(files: DataFrame, target: str, extract: Callable[[DataFrame], DataFrame], checkpoint: str):
    """One extractor, file by file: re-extract only the files of each batch; write its claims and a ledger of the paths
    it looked at. ``streaming.refresh`` runs every extractor.

    A row without content says that the file is gone. Of several versions of a path in one batch the highest ``version``
    counts (without that column, the greatest content). The batch id is part of the folders, so a batch that is run
    again replaces its own rows; the ledger makes a file count that has no claims any more.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        version = F.col("version") if "version" in batch.columns else F.lit(0)
        newest = F.max_by(F.struct("content"), F.struct(version, F.coalesce("content", F.lit("")))).alias("_f")
        files = batch.groupBy("repo_id", "path").agg(newest).select("repo_id", "path", "_f.content").persist()
        extract(files.filter("content IS NOT NULL")).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{target}/claims/batch={batch_id}")
        seen = files.select("repo_id", "path", F.col("content").isNull().alias("gone"))
        seen.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{target}/ledger/batch={batch_id}")
        files.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_claims(spark: SparkSession, target: str) -> DataFrame:
    """Claims of the newest batch that looked at each (repository, path); emptied and deleted files have none."""
    last = spark.read.parquet(f"{target}/ledger/batch=*").groupBy("repo_id", "path").agg(F.max("batch_id").alias("batch_id"))
    return spark.read.parquet(f"{target}/claims/batch=*").join(last, ["repo_id", "path", "batch_id"], "left_semi")


def source(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of a folder as a stream of its files, be it one file or a folder of part files.

    The last letter is a pattern, as a stream takes a plain path for a folder and refuses a file.
    """
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{table}.parque[t]")


def run_to_end(stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run over everything available and read the sink back.

    Append goes to Parquet: windows and sessions come out once, when the watermark has passed them, and their state is
    dropped then. Update mode writes the keys that a batch changed, beside its number; the newest row of a key counts,
    so no batch rewrites what the others found.
    """
    spark = stream.sparkSession
    sink, marks = shared_folder(spark, name), shared_folder(spark, f"{name}-marks")
    writer = stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", sink).outputMode("append").start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(sink)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    writer.outputMode(mode).foreachBatch(write).start().awaitTermination()
    rows = spark.read.parquet(f"{sink}/batch=*")
    newest = F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "_batch").alias("_r")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_r.*")
