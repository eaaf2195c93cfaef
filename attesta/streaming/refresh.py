"""Refresh of stored claims from new file versions, by whole runs over the repositories that changed.

A batch of file versions goes through these steps: of each path the newest version is taken, inside the batch and against
the version that is stored, so an older one that comes late changes nothing; the repositories with a changed path
are extracted again from their newest files, by every extractor; evidence rows are the reference counts of the
claims, so a claim whose last supporting file went, or no longer shows it, is gone; what humans decided stays; and one
row per claim says what the batch did to it.

Every table has one folder per batch, which a batch that runs again overwrites. The rows of a repository are those of
the newest batch that looked at it. ``repos`` is written last and makes a batch count. Every ``compact_every``-th batch
carries the rows of all repositories forward, and older folders are not read any more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attesta import dims
from attesta.functions.base import blob_id
from attesta.operators.maintenance import CLAIM_KEY, first_by, merge_claims, refresh_diff
from attesta.plans import runs

PATH_KEY = ["repo_id", "path"]
Extract = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def newest_versions(files: DataFrame) -> DataFrame:
    """One row per path: the highest version; of equal versions a fresh one, then the greatest content, a deletion last."""
    order = [F.col("version").desc_nulls_last(), F.col("fresh").desc(), F.col("content").desc_nulls_last()]
    return first_by(files, PATH_KEY, order)


def _read(spark: SparkSession, target: str, name: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", f"{target}/{name}").parquet(f"{target}/{name}/batch=*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(spark: SparkSession, target: str, name: str, before: int | None = None) -> DataFrame | None:
    """Rows of ``files``, ``claims`` or ``evidence`` as they stand (before a batch); none if nothing has been written."""
    marks = _read(spark, target, "repos")
    if marks is None:
        return None
    if before is not None:
        marks = marks.filter(F.col("batch") < before)
    base = marks.filter("compacted").agg(F.max("batch")).first()[0] or 0
    last = marks.filter(F.col("batch") >= base).groupBy("repo_id").agg(F.max("batch").alias("batch"))
    rows = _read(spark, target, name).filter(F.col("batch") >= base)
    return rows.join(last, ["repo_id", "batch"], "left_semi").drop("batch")


def changes(spark: SparkSession, target: str) -> DataFrame:
    """``(batch, repo_id, claim_id, change)``: what each batch did to the claims it looked at."""
    return _read(spark, target, "changes")


def supported(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """The claims with ``support``, the number of files that show each; 0 for those drawn from the repository as a whole."""
    count = evidence.groupBy(*CLAIM_KEY).agg(F.count_distinct("file_path").alias("support"))
    return claims.join(count, CLAIM_KEY, "left").withColumn("support", F.coalesce("support", F.lit(0).cast("bigint")))


def kept_decisions(known: DataFrame, found: DataFrame) -> DataFrame:
    """The new extraction, where a claim was known before: its decision, its edited text and its time of creation stay,
    evidence level and confidence do not go down."""
    merged = merge_claims(known, found).select(*CLAIM_KEY, *[F.col(c).alias(f"m_{c}") for c in ("confidence", "evidence_level")])
    decided = ("needs-declaration", *dims.REVIEW_STATES[2:])
    old = known.select(
        *CLAIM_KEY, F.when(F.col("review_state").isin(*decided), F.col("review_state")).alias("o_state"),
        F.when(F.col("review_state") == "edited", F.col("content")).alias("o_content"), F.col("created_at").alias("o_created"),
    )
    return (
        found.join(old, CLAIM_KEY, "left").join(merged, CLAIM_KEY, "left")
        .withColumn("review_state", F.coalesce("o_state", "review_state"))
        .withColumn("content", F.coalesce("o_content", "content"))
        .withColumn("created_at", F.coalesce("o_created", "created_at"))
        .withColumn("confidence", F.coalesce("m_confidence", "confidence"))
        .withColumn("evidence_level", F.coalesce("m_evidence_level", "evidence_level"))
        .select(*found.columns)
    )


def apply_batch(batch: DataFrame, batch_id: int, target: str, extract: Extract, compact_every: int) -> None:
    spark = batch.sparkSession

    def put(rows: DataFrame, name: str) -> DataFrame:
        path = f"{target}/{name}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    version = F.col("version") if "version" in batch.columns else F.lit(batch_id)
    seen = newest_versions(batch.select(*PATH_KEY, "content", version.cast("bigint").alias("version"), F.lit(1).alias("fresh")))
    stored = current(spark, target, "files", batch_id)
    known = stored.withColumn("fresh", F.lit(0)) if stored is not None else seen.limit(0)
    seen = put(seen, "arrived")
    both = known.join(seen.select("repo_id").distinct(), "repo_id", "left_semi").unionByName(seen)
    newest = newest_versions(both)
    same = known.select(*PATH_KEY, F.col("content").alias("was"), F.lit(True).alias("there"))
    told = newest.join(same, PATH_KEY, "left")
    changed = told.filter((F.col("fresh") == 1) & ~(F.col("there").isNotNull() & F.col("content").eqNullSafe(F.col("was"))))
    touched = put(changed.select("repo_id").distinct(), "touched")
    files = put(newest.join(touched, "repo_id", "left_semi").select(*PATH_KEY, "content", "version"), "files")

    there = files.filter("content IS NOT NULL").select(*PATH_KEY, "content", F.length("content").cast("bigint").alias("size"))
    found, evidence = extract(there)
    evidence = put(evidence, "evidence")
    claims = supported(found, evidence)
    past, past_evidence = current(spark, target, "claims", batch_id), current(spark, target, "evidence", batch_id)
    if past is None:
        past, past_evidence = claims.limit(0), evidence.limit(0)
    before = past.join(touched, "repo_id", "left_semi")
    hashes = there.select("repo_id", F.col("path").alias("file_path"), blob_id(F.col("content")).alias("now"))
    moved = past_evidence.join(touched, "repo_id", "left_semi").join(hashes, ["repo_id", "file_path"], "left").filter(~F.col("file_hash").eqNullSafe(F.col("now")))
    after = put(kept_decisions(before, claims), "claims")
    put(refresh_diff(before, after, moved), "changes")

    compacted = (batch_id + 1) % compact_every == 0
    marks = touched.withColumn("compacted", F.lit(compacted))
    if compacted and stored is not None:
        for name in ("files", "claims", "evidence"):
            others = current(spark, target, name, batch_id).join(touched, "repo_id", "left_anti")
            others.write.mode("append").parquet(f"{target}/{name}/batch={batch_id}")
        repos = current(spark, target, "files", batch_id).select("repo_id").distinct()
        marks = marks.unionByName(repos.join(touched, "repo_id", "left_anti").withColumn("compacted", F.lit(True)))
    put(marks, "repos")


def refresh(
    files: DataFrame, target: str, checkpoint: str, extract: Extract = runs.run_extraction_with_evidence, compact_every: int = 50
) -> StreamingQuery:
    """Keep ``target`` in step with a stream of file versions ``(repo_id, path, content[, version])``.

    A row without content says that the file is gone. Without ``version`` a later batch is newer. ``extract`` takes the
    files of the touched repositories and returns their claims and evidence.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, batch_id, target, extract, compact_every)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
