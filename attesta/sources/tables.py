"""Reading and writing the governed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators.maintenance import CLAIM_KEY, first_by
from attesta.session import checkpointed

BUCKETS = 64
#: Parts into which the evidence of one bucket can be dealt.
SHARES = 64
# fixed values: fields of the interchange files
DECISION_SCHEMA = (
    "repo_id string, claim_id string, action string, ts timestamp, actor string, original_content string, "
    "edited_content string, content string, claim_type string, scope string, applicability array<string>, "
    "sensitivity string, reason string, _corrupt string"
)
TRACE_SCHEMA = (
    "ts timestamp, tool_name string, arguments map<string,string>, response_status string, response_claim_count bigint, "
    "response_size_bytes bigint, duration_ms double, session_id string, repo_id string"
)
DECISIONS = ("approved", "edited", "suppressed", "tombstoned", "declared")


def with_bucket(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("repo_bucket", F.pmod(F.xxhash64("repo_id"), F.lit(buckets)).cast("int"))


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", order: tuple[str, ...] = ("repo_id",)) -> None:
    """Parquet by repository bucket, sorted inside files so row-group statistics prune.

    A bucket is spread over several files when it is large (rebalance), so one hot
    repository does not become one task.
    """
    _write_sorted(with_bucket(df).hint("rebalance", "repo_bucket"), path, mode, order)


def _write_sorted(bucketed: DataFrame, path: str, mode: str, order: tuple[str, ...]) -> None:
    rows = bucketed.sortWithinPartitions("repo_bucket", *order)
    rows.write.mode(mode).option("compression", "zstd").partitionBy("repo_bucket").parquet(path)


def read_table(spark: SparkSession, path: str, repo_id: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Whole table, or one repository with its bucket predicate for partition pruning."""
    df = spark.read.parquet(path)
    if repo_id is None:
        return df
    bucket = F.pmod(F.xxhash64(F.lit(repo_id)), F.lit(buckets)).cast("int")
    return df.filter((F.col("repo_bucket") == bucket) & (F.col("repo_id") == repo_id))


def duplicate_ids(claims: DataFrame) -> DataFrame:
    """Keys that a write must refuse."""
    return claims.groupBy(*CLAIM_KEY).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def write_claims(claims: DataFrame, path: str) -> None:
    claims = checkpointed(claims)  # computed once, for the check and the write
    if not duplicate_ids(claims).isEmpty():
        raise ValueError("claims hold duplicate (repo_id, claim_id) keys")
    write_table(claims, path, order=("repo_id", "claim_type"))


EVIDENCE_KEY = [*CLAIM_KEY, "file_path", "extraction_version"]


def unique_evidence(evidence: DataFrame) -> DataFrame:
    """One row per (claim, file, extraction version)."""
    # the smallest row itself: beside an order of its own, each row would be moved twice over
    first = F.min(F.struct("line_start", "line_end", "file_hash", "evidence_level")).alias("r")
    return evidence.groupBy(*EVIDENCE_KEY).agg(first).select(
        *EVIDENCE_KEY, "r.file_hash", "r.line_start", "r.line_end", "r.evidence_level"
    )


def _packed(rows: DataFrame, name: str, prefix: str = "") -> DataFrame:
    """The column as the bytes that it spells behind the prefix, in ``_bytes_<name>``; a text that spells none stays as it is."""
    spells = F.col(name).rlike(f"^{prefix}[0-9a-f]*\\z") & ((F.length(name) - len(prefix)) % 2 == 0)
    held = F.when(spells, F.unhex(F.substr(name, F.lit(len(prefix) + 1))))
    return rows.withColumn(f"_bytes_{name}", held).withColumn(name, F.when(F.coalesce(spells, F.lit(False)), F.lit(None)).otherwise(F.col(name)))


def _unpacked(rows: DataFrame, name: str, prefix: str = "") -> DataFrame:
    held = F.col(f"_bytes_{name}")
    text = F.when(held.isNotNull(), F.concat(F.lit(prefix), F.lower(F.hex(held)))).otherwise(F.col(name))
    return rows.withColumn(name, text).drop(f"_bytes_{name}")


def write_evidence(evidence: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Evidence rows, one per claim, file and version, by repository bucket and sorted for reads by claim.

    Rows move once: they are dealt by bucket and share of it, so that a hot repository or claim is many tasks and files, and the
    first of each key is taken where they land, in the order in which they are written. Ids and hashes move as bytes.
    """
    share = F.pmod(F.xxhash64("claim_id", "file_path"), F.lit(SHARES)).cast("int")
    small = _packed(_packed(with_bucket(evidence).withColumn("_share", share), "claim_id", "claim-"), "file_hash")
    dealt = _unpacked(_unpacked(small.repartition("repo_bucket", "_share"), "claim_id", "claim-"), "file_hash")
    place = [F.col(c) for c in ("line_start", "line_end", "file_hash", "evidence_level")]
    rows = first_by(dealt, ["repo_bucket", *CLAIM_KEY, "file_path", "extraction_version", "_share"], place).drop("_share")
    _write_sorted(rows, path, mode, ("repo_id", "claim_id", "file_path"))


def read_evidence(
    spark: SparkSession, path: str, repo_id: str | None = None, claim_id: str | None = None, file_path: str | None = None
) -> DataFrame:
    """Evidence of everything, of a repository, of a claim or of a file."""
    rows = read_table(spark, path, repo_id)
    for name, value in (("claim_id", claim_id), ("file_path", file_path)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows


def append_history(history: DataFrame, path: str) -> None:
    """Append decisions; ids come from the row, so a retried job writes the same ids."""
    stamped = history.withColumn(
        "event_key", F.sha2(F.concat_ws(":", "repo_id", "claim_id", "action", F.col("ts").cast("string"), "actor"), 256)
    )
    with_bucket(stamped).write.mode("append").partitionBy("repo_bucket").parquet(path)


def replace_repo_edges(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges with those of the refreshed repositories replaced."""
    touched = fresh.select("repo_id").distinct()
    return current.join(touched, "repo_id", "left_anti").unionByName(fresh)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decision files (one JSON document per line); broken or unknown ones are set apart by ``valid``."""
    raw = spark.read.schema(DECISION_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    valid = F.col("_corrupt").isNull() & F.col("action").isin(*DECISIONS) & F.col("claim_id").isNotNull()
    return raw.withColumn("valid", F.coalesce(valid, F.lit(False)))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE_SCHEMA).json(path)


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    """Expected-claims documents, one row per expectation; the fixture is the folder name."""
    claim = "struct<claim_type:string,content_pattern:string,source_authority:string,risk_class:string,min_confidence:double,required:boolean>"
    raw = spark.read.schema(f"description string, claims array<{claim}>").option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    folder = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    return raw.select(folder.alias("repo_id"), F.posexplode("claims").alias("no", "c")).select(
        "repo_id", "no", "c.claim_type", F.col("c.content_pattern").alias("pattern"), "c.source_authority", "c.risk_class", "c.min_confidence",
        F.coalesce("c.required", F.lit(True)).alias("required"),
    )


def write_artifacts(files: DataFrame, path: str) -> None:
    files.write.mode("overwrite").partitionBy("host").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
