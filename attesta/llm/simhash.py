"""SimHash near-duplicates by a pivot distance table.

Each distinct fingerprint gets its Hamming distances to fixed reference fingerprints: zero, and one per two-bit block.
By the triangle inequality two fingerprints within ``radius`` differ by at most ``radius`` in every coordinate. The
distance to zero minus that to a block's reference depends on that block alone, and ``radius`` differing bits touch at
most ``radius`` groups of blocks, so of ``groups`` groups at least ``groups - radius`` agree in all their coordinates.
Fingerprints meet under each such choice of groups; pairs whose largest coordinate difference is above ``radius`` go,
and the rest is verified. Only spanning links of a bucket are put out.

A bucket of more than ``limit`` fingerprints is not compared pair by pair. Its members put out all fingerprints one bit
away; two that link share one of these, and at most 65 can share it, so the exact answer stays linear.

Defined cases: a text without words (null, empty, blanks) has fingerprint zero, linked like any other; rows with a null
id take part but are never named; equal rows share a component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import by_batch, packed_row, stored, words_of
from attesta.llm.components import components, stars

SHINGLE = 3
SEED = 42
RADIUS = 2
GROUPS = 4
LIMIT = 256
BLOCK = 2  # bits
AT_ONCE = 1 << 18
PIVOTS = [0, *(((1 << BLOCK) - 1) << i for i in range(0, 64, BLOCK))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a whole text; only A-Z are lower-cased."""
    words = words_of(text)
    if not words:
        return 0
    line = b" ".join(words).lower()
    starts = np.cumsum([0, *map(len, words[:-1])]) + np.arange(len(words))
    ends = starts + np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    n = max(1, len(words) - shingle + 1)
    begin, end = starts[:n].tolist(), ends[len(words) - n :].tolist()
    votes = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, AT_ONCE):
        spans = zip(begin[i : i + AT_ONCE], end[i : i + AT_ONCE], strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` per row, the fingerprint as a signed long."""

    def work(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        texts = batch.column("text").to_pylist()
        yield {"doc_id": batch.column("doc_id").to_pylist(), "fp": [_signed(fingerprint(t, shingle)) for t in texts]}

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, fp long", work)


def group_keys(fp: Column, groups: int, radius: int) -> Column:
    """One key per choice of ``groups - radius`` groups of blocks, from the differences of pivot distances."""
    distance = [F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))) for p in PIVOTS]
    per = (len(PIVOTS) - 1) // groups
    keys = []
    for no, chosen in enumerate(combinations(range(groups), groups - radius)):
        coordinates = [distance[0] - distance[1 + g * per + i] for g in chosen for i in range(per)]
        keys.append(F.xxhash64(F.lit(no), *coordinates))
    return F.array(*keys)


def _close(fps: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Which index pairs link: pivot filter first, then the distance itself."""
    table = np.stack([np.bitwise_count(fps ^ np.uint64(p)) for p in PIVOTS]).astype(np.int8)
    ok = np.ones(len(left), dtype=bool)
    for row in table:
        ok[ok] = np.abs(row[left[ok]] - row[right[ok]]) <= radius
    ok[ok] = np.bitwise_count(fps[left[ok]] ^ fps[right[ok]]) <= radius
    return ok


def _bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corner: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            lists = batch.column("fps")
            sizes = np.diff(lists.offsets.to_numpy())
            fps = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
            left, right, held = [], [], 0
            for at, n in zip(begins.tolist(), sizes.tolist(), strict=True):
                i, j = corner.setdefault(n, np.triu_indices(n, 1)) if n not in corner else corner[n]
                left.append(i + at)
                right.append(j + at)
                held += len(i)
                if held > 2_000_000:
                    yield from _links(fps, left, right, radius)
                    left, right, held = [], [], 0
            yield from _links(fps, left, right, radius)

    return buckets.select("fps").mapInArrow(run, "a long, b long")


def _links(fps: np.ndarray, left: list, right: list, radius: int) -> Iterator[pa.RecordBatch]:
    if not left:
        return
    i, j = np.concatenate(left), np.concatenate(right)
    used, where = np.unique(np.concatenate([i, j]), return_inverse=True)
    ok = _close(fps[used], where[: len(i)], where[len(i) :], radius)
    if ok.any():
        node, centre = stars(fps[i[ok]].view(np.int64), fps[j[ok]].view(np.int64), 0)
        apart = node != centre
        yield pa.RecordBatch.from_arrays([pa.array(node[apart]), pa.array(centre[apart])], names=["a", "b"])


def links(distinct: DataFrame, radius: int = RADIUS, groups: int = GROUPS, limit: int = LIMIT) -> DataFrame:
    """Links ``(a, b)`` that join every two of the distinct fingerprints ``fp`` within ``radius`` (2 at most)."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius is from 0 to {RADIUS}: crowded buckets go by fingerprints one bit away")
    keys = stored(distinct.select("fp", F.explode(group_keys(F.col("fp"), groups, radius)).alias("key")), "simhash-keys")
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stored(keys.join(counts, "key"), "simhash-met")
    small = met.filter(F.col("n") <= limit).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    near = [F.lit(_signed(m)) for m in (0, *(1 << i for i in range(64)))]
    crowded = met.filter(F.col("n") > limit).select("fp").distinct()
    meeting = crowded.select("fp", F.explode(F.array(*near)).alias("m")).groupBy(F.col("fp").bitwiseXOR(F.col("m")).alias("at"))
    shared = meeting.agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    exact = shared.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a <> b")
    return _bucket_links(small, radius).unionByName(exact)


def grouped(prints: DataFrame, radius: int = RADIUS, groups: int = GROUPS, limit: int = LIMIT) -> DataFrame:
    """Adds ``component_id``, the smallest id reachable by links, to ``(doc_id, fp)``."""
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = components(links(classes.select("fp"), radius, groups, limit))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row."""
    found = grouped(stored(fingerprints(docs, shingle), "simhash-prints"), radius)
    return found.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents without those that another one stands for: one row of each component stays.

    It is the row with the smallest id (null last); of several rows with that id, the one with the smallest fingerprint, then
    the smallest hash of all its columns. Rows are judged one by one, so unrelated texts under one id all stay.
    """
    rows = docs.select(packed_row(docs).alias("row")).withColumn("place", F.xxhash64("row", *[F.col("row")[c].isNull() for c in docs.columns]))
    keyed = rows.select("place", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"))
    places = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "place")

    def work(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        prints = [_signed(fingerprint(t, shingle)) for t in batch.column("text").to_pylist()]
        yield {"place": batch.column("place").to_pylist(), "doc_id": batch.column("doc_id").to_pylist(), "fp": prints}

    prints = stored(by_batch(keyed, "place long, doc_id long, fp long", work), "simhash-prints")
    classes = stored(prints.groupBy("fp").agg(F.min(places).alias("first")), "simhash-classes")
    roots = components(links(classes.select("fp"), radius))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    order = F.struct("first.null", "first.doc_id", "fp", "first.place")
    kept = rooted.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.place").alias("kept"))
    rest = prints.groupBy("place").agg(F.count(F.lit(1)).alias("n")).join(kept, F.col("place") == F.col("kept"), "left")
    # rows that are equal in every column share their place; of those that stay one does
    apart = stored(rest.filter("kept IS NULL OR n > 1").select("place", (F.col("kept").isNotNull()).alias("again")), "simhash-apart")
    left = rows.join(apart.select("place"), "place", "left_anti")
    again = rows.join(apart.filter("again").select("place"), "place", "left_semi").dropDuplicates(["place"])
    return left.unionByName(again).select("row.*")
