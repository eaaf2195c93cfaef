"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds, for blocks of documents, one bitmap row per signature bit: bit ``d`` of a row says that document ``d`` of
the block has set it. A term sets ``HASHES`` rows for every level of ``LEVELS`` that its count in the document reaches, so
the rows of a term and level, joined by AND, hold every document with that count and a few more. With the length and the
highest count of each document beside them, the levels give a count that the true one never passes; the weighted sum
over an item's terms is an upper bound of the document's score.

A search reads the bitmaps twice and texts only by id. The ten best bounds of each item are scored exactly, and the
tenth score is a threshold; then every document whose bound is not below it (at equal scores: whose id is not behind) is
scored exactly. Nothing else can be among the first ten, so the result is whole and exact.

Items are the stated query set: they are taken in blocks of at most ``BLOCK`` characters, and each block meets all
documents. Document counts of terms are partial counts in the index; those of a block's terms are summed when asked.

Defined cases: null texts, and texts without a term, are documents without terms and never found; rows count one by one, so
equal rows or ids are ranked one by one; ids that are null come last among equal scores; equal item rows count once, items
of one id with different texts are ranked each by itself; an item without terms, and an empty table, give no rows; other
columns are not read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heappush, heapreplace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from attesta.session import shared_folder

TOP = 10
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)
HASHES = 3
BITS = 10  # signature bits per entry of the fullest document of a block
BLOCK_DOCS = 1024
DOCS_AT_ONCE = 8192
ENTRIES_AT_ONCE = 2_000_000
TERMS_AT_ONCE = 400_000
BLOCK = 4_000_000  # characters of items
ITEMS_AT_ONCE = 64
BROADCAST_DOCS = 200_000  # wanted documents that are sent to the tasks; beyond, they are joined by a shuffle

#: A-Z to a-z; every other ASCII character that is no digit or letter parts terms.
TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

BITMAPS, COUNTS, TOTALS = 0, 1, 2
INDEX = (
    "kind int, rows int, ids array<long>, sizes array<int>, most array<int>, bits binary,"
    " term binary, df long, docs long, terms long"
)


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERMS).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_term(n: int, n_docs: int, total: int) -> int:
    return 10 + (90 * n * n_docs) // total


def part(tf: int, m: int) -> int:
    """What one term adds, before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def signature_rows(keys: np.ndarray, rows: int) -> np.ndarray:
    """``HASHES`` row numbers for each key, by double hashing."""
    x = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    step = (x >> np.uint64(32)) | np.uint64(1)
    first = x & np.uint64(0xFFFFFFFF)
    return ((first[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(rows)).astype(np.int64)


def entry_keys(counts: dict[bytes, int]) -> np.ndarray:
    """One key per term and level that the term's count reaches."""
    crc = np.fromiter(map(zlib.crc32, counts), dtype=np.uint64, count=len(counts))
    times = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    parts = [crc]
    for level, least in enumerate(LEVELS[1:], 1):
        crc = crc[times >= least]
        if not len(crc):
            break
        times = times[times >= least]
        parts.append(crc | np.uint64(level << 32))
    return np.concatenate(parts)


class Signed(NamedTuple):
    id: int | None
    size: int
    most: int
    keys: np.ndarray


def bitmaps(docs: list[Signed]) -> Iterator[tuple]:
    """Blocks of documents with about as many entries each: ``(rows, ids, sizes, most, bits)``."""
    docs = sorted(docs, key=lambda d: len(d.keys))
    begin = 0
    while begin < len(docs):
        end = begin + 1
        while end < len(docs) and end - begin < BLOCK_DOCS and len(docs[end].keys) <= 2 * len(docs[begin].keys):
            end += 1
        block = docs[begin:end]
        begin = end
        rows = BITS * len(block[-1].keys)
        dense = np.zeros((rows, -(-len(block) // 8) * 8), dtype=bool)
        for d, doc in enumerate(block):
            dense[signature_rows(doc.keys, rows).ravel(), d] = True
        yield rows, [d.id for d in block], [d.size for d in block], [d.most for d in block], np.packbits(dense, axis=1).tobytes()


class Index:
    """Written bitmaps, partial term counts and totals of a document table."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        rows = spark.read.schema(INDEX).parquet(path)
        self.bitmaps = rows.filter(F.col("kind") == BITMAPS).select("rows", "ids", "sizes", "most", "bits")
        self.counts = rows.filter(F.col("kind") == COUNTS).select("term", "df")
        total = rows.filter(F.col("kind") == TOTALS).agg(F.sum("docs"), F.sum("terms")).first()
        self.docs, self.terms = total[0] or 0, total[1] or 0


def index(docs: DataFrame) -> Index:
    """One pass over ``docs(doc_id, text)``."""
    struct = _parse_datatype_string(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(struct)
        held: list[Signed] = []
        df: Counter[bytes] = Counter()
        entries = n_docs = n_terms = 0

        def put(kind: int, n: int, **columns: list) -> pa.RecordBatch:
            given = {"kind": [kind] * n, **columns}
            return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in arrow], schema=arrow)

        def put_bitmaps() -> Iterator[pa.RecordBatch]:
            for block in bitmaps(held):
                yield put(BITMAPS, 1, **{name: [x] for name, x in zip(("rows", "ids", "sizes", "most", "bits"), block, strict=True)})
            held.clear()

        def put_counts() -> pa.RecordBatch:
            out = put(COUNTS, len(df), term=list(df), df=list(df.values()))
            df.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts = Counter(terms_of(text))
                if not counts:
                    continue
                size = sum(counts.values())
                held.append(Signed(key, size, max(counts.values()), entry_keys(counts)))
                df.update(counts.keys())
                n_docs, n_terms, entries = n_docs + 1, n_terms + size, entries + len(held[-1].keys)
                if len(held) >= DOCS_AT_ONCE or entries >= ENTRIES_AT_ONCE:
                    yield from put_bitmaps()
                    entries = 0
                if len(df) >= TERMS_AT_ONCE:
                    yield put_counts()
        yield from put_bitmaps()
        if df:
            yield put_counts()
        if n_docs:
            yield put(TOTALS, 1, docs=[n_docs], terms=[n_terms])

    path = shared_folder(docs.sparkSession, "lexical")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    narrow.mapInArrow(run, struct).write.partitionBy("kind").parquet(path)
    return Index(docs.sparkSession, path)


class Queries(NamedTuple):
    """A block of items: the distinct terms with their weights, and the places of each item's terms among them."""

    name: str
    n_docs: int
    total: int
    terms: list[bytes]
    weights: list[int]
    items: list[tuple[int, list[int]]]

    def scores(self, text: str | None, wanted: list[int]) -> Iterator[tuple[int, int]]:
        """``(number of the item, exact score)``."""
        counts = Counter(terms_of(text))
        m = length_term(sum(counts.values()), self.n_docs, self.total)
        for no in wanted:
            yield no, sum(self.weights[t] * part(counts[self.terms[t]], m) for t in self.items[no][1] if self.terms[t] in counts)

    def bounds(self, rows: int, sizes: list[int], most: list[int], bits: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """``(number of the item, upper bound of every document of the block)``; items that no document can meet are left out."""
        width = -(-len(sizes) // 8)
        slices = np.frombuffer(bits, dtype=np.uint8).reshape(rows, width)
        m = np.array([length_term(n, self.n_docs, self.total) for n in sizes], dtype=np.int64)
        top = np.array(most, dtype=np.int64)
        bound_at = np.zeros((len(LEVELS) + 1, len(sizes)))
        for level in range(len(LEVELS)):  # what the highest count below the next level can add
            tf = np.minimum(top, LEVELS[level + 1] - 1) if level + 1 < len(LEVELS) else top
            bound_at[level + 1] = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
        for begin in range(0, len(self.items), ITEMS_AT_ONCE):
            some = range(begin, min(begin + ITEMS_AT_ONCE, len(self.items)))
            used = sorted({t for no in some for t in self.items[no][1]})
            place = {t: i for i, t in enumerate(used)}
            keys = np.array([zlib.crc32(self.terms[t]) for t in used], dtype=np.uint64)
            level_of = np.zeros((len(used), len(sizes)), dtype=np.uint8)
            alive, above = np.arange(len(used)), None
            for level in range(len(LEVELS)):
                found = np.bitwise_and.reduce(slices[signature_rows(keys[alive] | np.uint64(level << 32), rows)], axis=1)
                above = found if above is None else above & found
                some_bit = above.any(axis=1)
                alive, above = alive[some_bit], above[some_bit]
                if not len(alive):
                    break
                level_of[alive] += np.unpackbits(above, axis=1, count=len(sizes))
            adds = bound_at[level_of, np.arange(len(sizes))]
            held = level_of.any(axis=1)
            for no in some:
                at = [place[t] for t in self.items[no][1]]
                if any(held[i] for i in at):
                    weights = np.array([self.weights[t] for t in self.items[no][1]], dtype=np.float64)
                    yield no, weights @ adds[at]  # whole numbers below 2^53: exact


def _behind(key: int | None) -> tuple[bool, int]:
    """Order of ids at equal scores."""
    return key is None, key or 0


class _Best:
    """The best ``(score, id)`` of each item, equal scores by ascending id."""

    def __init__(self, size: int) -> None:
        self.size, self.kept = size, defaultdict(list)

    def add(self, no: int, score: int, key: int | None) -> None:
        null, value = _behind(key)
        entry = (score, not null, -value)
        kept = self.kept[no]
        if len(kept) < self.size:
            heappush(kept, entry)
        elif entry > kept[0]:
            heapreplace(kept, entry)

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for no, kept in self.kept.items():
            for score, known, value in kept:
                yield no, -value if known else None, score


def _put(rows: list[tuple], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


FOUND = (("no", "doc_id", "score"), (pa.int32(), pa.int64(), pa.int64()))


def _first(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def best_bounds(built: Index, sent, top: int) -> DataFrame:
    """``(no, doc_id, score)``: the documents with the highest bounds of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(top)
        for batch in batches:
            for rows, ids, sizes, most, bits in zip(*(batch.column(c).to_pylist() for c in ("rows", "ids", "sizes", "most", "bits")), strict=True):
                for no, bound in sent.value.bounds(rows, sizes, most, bits):
                    count = min(top, len(bound))
                    edge = max(np.partition(bound, len(bound) - count)[len(bound) - count], 1)
                    for d in np.flatnonzero(bound >= edge).tolist():
                        best.add(no, int(bound[d]), ids[d])
        yield from _put(list(best.rows()), *FOUND)

    return _first(built.bitmaps.mapInArrow(run, "no int, doc_id long, score long"), top)


def not_excluded(built: Index, sent, least: dict[int, tuple[int, tuple[bool, int]]]) -> DataFrame:
    """``(no, doc_id)`` of every document whose bound reaches the item's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, ids, sizes, most, bits in zip(*(batch.column(c).to_pylist() for c in ("rows", "ids", "sizes", "most", "bits")), strict=True):
                out = []
                for no, bound in sent.value.bounds(rows, sizes, most, bits):
                    score, last = least.get(no, (0, (True, 0)))
                    for d in np.flatnonzero(bound >= max(score, 1)).tolist():
                        if bound[d] > score or _behind(ids[d]) <= last:
                            out.append((no, ids[d]))
                yield from _put(out, ("no", "doc_id"), (pa.int32(), pa.int64()))

    return built.bitmaps.mapInArrow(run, "no int, doc_id long")


def scored(docs: DataFrame, wanted: DataFrame, sent, top: int) -> DataFrame:
    """Exact scores of ``wanted(no, doc_id)``: the ``top`` best of each item."""
    lists = wanted.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("no").alias("_nos"))
    small = wanted.select("doc_id").distinct().count() <= BROADCAST_DOCS
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = narrow.join(F.broadcast(lists) if small else lists, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", "_nos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(top)
        for batch in batches:
            for key, text, nos in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_nos")), strict=True):
                for no, score in sent.value.scores(text, nos):
                    if score > 0:
                        best.add(no, score, key)
        yield from _put(list(best.rows()), *FOUND)

    return _first(met.mapInArrow(run, "no int, doc_id long, score long"), top)


def blocks(items: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items ``(item_id, distinct terms)`` in parts of about ``size`` characters, one at a time."""
    known = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // size))
    for no in range(parts):
        rows = known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == no).collect()
        found = [(r["item_id"], sorted(set(terms_of(r["text"])))) for r in rows]
        yield sorted((x for x in found if x[1]), key=lambda x: (_behind(x[0]), x[1]))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, built: Index | None = None) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each item; ``built`` is their index, if there is one."""
    spark = docs.sparkSession
    built = built or index(docs)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks(items):
        words = sorted({t for _, terms in block for t in terms})
        if not words or not built.docs:
            continue
        asked = spark.createDataFrame([(bytearray(w),) for w in words], "term binary")
        counted = built.counts.join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("df").alias("df")).collect()
        df = {bytes(r["term"]): r["df"] for r in counted}
        terms = sorted(df)
        place = {t: i for i, t in enumerate(terms)}
        weights = [weight(built.docs, df[t]) for t in terms]
        queries = Queries(uuid.uuid4().hex, built.docs, built.terms, terms, weights, [(i, [place[t] for t in own if t in place]) for i, own in block])
        sent = spark.sparkContext.broadcast(queries)
        tenth = scored(docs, best_bounds(built, sent, top), sent, top).filter(F.col("rank") == top).collect()
        least = {r["no"]: (r["score"], _behind(r["doc_id"])) for r in tenth}
        names = spark.createDataFrame([(no, i) for no, (i, _) in enumerate(block)], "no int, item_id long")
        found = scored(docs, not_excluded(built, sent, least), sent, top)
        out = out.unionByName(found.join(F.broadcast(names), "no").select("item_id", "rank", "doc_id", "score"))
    return out
