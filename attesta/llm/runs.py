"""Periodic runs of words, found on tiles of every scale.

A run of period ``q`` is a stretch in which words ``q`` apart are equal; it is ``max(least, 2 * q)`` words long at least, so
its matches (places whose word comes again ``q`` later) form a stretch of ``max(least - q, q)`` places or more. For each
octave of periods ``[lo, 2 * lo)`` a document is cut into blocks of half that stretch: every run of the octave holds a
whole block of matches. A tile is one block with the words that all periods of the octave can reach around it; tiles
overlap and are solved without each other. Two Z-functions at the block's border, one to the right and one to the left,
give for every period how far the words match. Tiles whose block does not come again at a distance of the octave hold
no matches and are not made.

Matches that a tile finds are fragments ``(document, period, begin, end)``. They are joined as far as a task sees
neighbouring tiles, shuffled by document and period, and stitched there; of a stretch's period and its multiples the
smallest stays. Only documents with a tile are kept and moved; all others are settled where they are read.

Defined cases: a null or empty text has no words and no runs; each row is a text of its own, equal rows included; null
ids stay; an empty table gives an empty result; of other columns none is read. A text's words and runs are held by one
task at a time, whatever its length; its tiles are spread over the cluster.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from attesta.llm.common import words_of
from attesta.llm.substrings import BASE, _powers, window_hashes
from attesta.session import shared_folder

LEAST = 12
WORDS_AT_ONCE = 400_000
CODES_AT_ONCE = 500_000
#: Row groups of the written tiles, so that the tiles of one long text are read by many tasks.
GROUP_BYTES = 8_000_000

Run = tuple[int, int, int]  # start, length, period
Words = Callable[[object, str | None], list[bytes]]
Emit = Callable[[object, list[bytes], list[Run]], tuple]

SETTLED, OPEN, TILE = 0, 1, 2


def matched(lo: int, least: int = LEAST) -> int:
    """Least number of matches in a run of any period from ``lo`` up to twice that."""
    return min(max(least - q, q) for q in range(lo, 2 * lo)) if 2 * lo <= 2 * least else lo


def octaves(n: int, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """(least period, block length) of every octave with periods up to half of ``n`` words."""
    lo = 1
    while 2 * lo <= n:
        yield lo, (matched(lo, least) + 1) // 2
        lo *= 2


def repeating(hashes: np.ndarray, sizes: list[int], length: int) -> set[int]:
    """Which of the texts laid end to end hold some window of ``length`` words twice."""
    if len(hashes) < length:
        return set()
    owner = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    whole = owner[: len(owner) - length + 1] == owner[length - 1 :]
    keys = (window_hashes(hashes, length) + owner[: len(whole)] * np.uint64(0xD6E8FEB86659FD93))[whole]
    order = np.argsort(keys, kind="stable")
    again = keys[order[1:]] == keys[order[:-1]]
    return set(owner[: len(whole)][whole][order[1:][again]].astype(np.int64).tolist())


def tile_places(hashes: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, int, np.ndarray]]:
    """(least period, block length, block starts) of the blocks that come again at a distance of their octave.

    A tile whose words all repeat with one period below the octave, no longer than the block, is left to that period:
    in it the block comes again at multiples of the period only.
    """
    n = len(hashes)
    powers = _powers(BASE, n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * powers[:n], out=sums[1:])
    for lo, block in octaves(n, least):
        if n < block + lo:
            break
        windows = window_hashes(hashes, block)
        order = np.argsort(windows, kind="stable")
        fresh = windows[order[1:]] != windows[order[:-1]]
        if fresh.all() and 2 * block >= least:
            break  # no window of this length comes twice, so no longer one does
        rank = np.concatenate([[0], np.cumsum(fresh)])
        group = np.empty(len(order), dtype=np.int64)
        group[order] = rank
        keys = rank * (n + 1) + order
        begins = np.arange(0, len(windows), block)
        first = group[begins] * (n + 1) + begins + lo
        at = np.searchsorted(keys, first)
        begins = begins[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] < first + lo)]
        step = np.full(len(order), n)
        step[order[:-1][~fresh]] = np.diff(order)[~fresh]
        period = step[begins]
        small = (period < lo) & (period <= block)
        period = np.where(small, period, 1)
        left, right = np.maximum(0, begins - block), np.minimum(n, begins + 2 * lo - 1 + 2 * block)
        alike = (sums[right - period] - sums[left]) * powers[period] == sums[right] - sums[left + period]
        begins = begins[~(small & alike)]
        if len(begins):
            yield lo, block, begins


def z_function(s: list[int]) -> list[int]:
    """Length of the longest start of ``s`` that stands at each place."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def boundary(tile: list[int], at: int, lo: int, block: int) -> list[tuple[int, int, int]]:
    """(period, matches before, matches from) the border ``at``, for periods whose block matches as a whole."""
    start = tile[at : at + 2 * block]
    right = z_function([*start, -1, *tile[at + lo : at + 2 * lo - 1 + 2 * block]])[len(start) + 1 :]
    found = [(lo + i, k) for i, k in enumerate(right[:lo]) if k >= block]
    if not found:
        return []
    before = tile[max(0, at - block) : at][::-1]
    end = min(len(tile), at + 2 * lo - 1)
    left = z_function([*before, -1, *tile[at + lo - len(before) : end][::-1]])[len(before) + 1 :]
    return [(q, left[end - at - q] if end - at - q < len(left) else 0, k) for q, k in found]


def opened(docs: DataFrame, emit: Emit, schema: str, words: Words, least: int) -> DataFrame:
    """Written once: results of texts without tiles, the other texts, and tiles."""
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("rid"), "text")
    out = _parse_datatype_string(schema)
    fields = _parse_datatype_string("kind int, rid long, z binary, lo int, block int, at long, first long, tile array<int>").fields
    whole = StructType([*fields, StructField("id", rows.schema["id"].dataType), StructField("out", out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(whole)
        result = to_arrow_schema(out)
        pack = zstandard.ZstdCompressor(level=3)

        def put(kind: int, n: int, **columns: object) -> pa.RecordBatch:
            held = {"kind": pa.array(np.full(n, kind, dtype=np.int32)), **columns}
            return pa.RecordBatch.from_arrays([pa.array(held[f.name], f.type) if f.name in held else pa.nulls(n, f.type) for f in arrow], schema=arrow)

        def put_tiles(tiles: list[tuple]) -> pa.RecordBatch:
            rid, lo, block, at, first, codes = zip(*tiles, strict=True)
            edges = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(codes).astype(np.int32)), type=arrow.field("tile").type)
            return put(TILE, len(tiles), rid=list(rid), lo=list(lo), block=list(block), at=list(at), first=list(first), tile=lists)

        def chunk(ids: list, rids: list[int], lists: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
            sizes = [len(x) for x in lists]
            flat = np.array([w for x in lists for w in x], dtype=object)
            hashes = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
            ends = np.cumsum(sizes)
            some = repeating(hashes, sizes, -(-least // 2))
            settled, unsettled, tiles, held = [], [], [], 0
            for i, (key, rid, text, n) in enumerate(zip(ids, rids, lists, sizes, strict=True)):
                has_tile = False
                own = hashes[ends[i] - n : ends[i]] if i in some else None
                for lo, block, begins in tile_places(own, least) if own is not None else ():
                    if not has_tile:
                        codes = np.unique(own, return_inverse=True)[1].astype(np.int32)
                        has_tile = True
                    for b in begins.tolist():
                        first = max(0, b - block)
                        tiles.append((rid, lo, block, b, first, codes[first : b + 2 * lo - 1 + 2 * block]))
                        held += len(tiles[-1][-1])
                        if held >= CODES_AT_ONCE:
                            yield put_tiles(tiles)
                            tiles, held = [], 0
                if has_tile:
                    unsettled.append((rid, key, pack.compress(b" ".join(text))))
                else:
                    settled.append((key, emit(key, text, [])))
            if tiles:
                yield put_tiles(tiles)
            if unsettled:
                rid, key, z = zip(*unsettled, strict=True)
                yield put(OPEN, len(rid), rid=list(rid), id=list(key), z=list(z))
            if settled:
                columns = [pa.array(list(c), f.type) for c, f in zip(zip(*(r for _, r in settled), strict=True), result, strict=True)]
                yield put(SETTLED, len(settled), id=[k for k, _ in settled], out=pa.StructArray.from_arrays(columns, fields=list(result)))

        for batch in batches:
            ids, rids, lists, held = [], [], [], 0
            for key, rid, text in zip(*(batch.column(c).to_pylist() for c in ("id", "rid", "text")), strict=True):
                ids.append(key)
                rids.append(rid)
                lists.append(words(key, text))
                held += len(lists[-1])
                if held >= WORDS_AT_ONCE:
                    yield from chunk(ids, rids, lists)
                    ids, rids, lists, held = [], [], [], 0
            if ids:
                yield from chunk(ids, rids, lists)

    path = shared_folder(docs.sparkSession, "runs")
    rows.mapInArrow(run, whole).write.option("parquet.block.size", GROUP_BYTES).partitionBy("kind").parquet(path)
    return docs.sparkSession.read.schema(whole).parquet(path)


def fragments(tiles: DataFrame) -> DataFrame:
    """``(rid, period, begin, end)``: stretches of matches, joined over neighbouring tiles of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, int, int, int]] = []
        known: dict[int, tuple[int, int]] = {}
        here = None

        def put() -> pa.RecordBatch:
            columns = [pa.array(list(c), pa.int64()) for c in zip(*done, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=["rid", "period", "begin", "end"])

        for batch in batches:
            tiles = batch.column("tile")
            edges, flat = tiles.offsets.to_pylist(), tiles.values.to_pylist()
            rows = zip(*(batch.column(c).to_pylist() for c in ("rid", "lo", "block", "at", "first")), strict=True)
            for no, (rid, lo, block, at, first) in enumerate(rows):
                codes = flat[edges[no] : edges[no + 1]]
                if (rid, lo) != here:
                    done.extend((here[0], q, a, b) for q, (a, b) in known.items())
                    known.clear()
                    here = (rid, lo)
                for q, back, ahead in boundary(codes, at - first, lo, block):
                    begin, end = at - back, at + ahead
                    if q in known:
                        a, b = known[q]
                        if a <= begin <= b:
                            begin, end = a, max(b, end)
                        else:
                            done.append((rid, q, a, b))
                    known[q] = (begin, end)
                if len(done) >= 50_000:
                    yield put()
        done.extend((here[0], q, a, b) for q, (a, b) in known.items())
        if done:
            yield put()

    return tiles.select("rid", "lo", "block", "at", "first", "tile").mapInArrow(run, "rid long, period long, begin long, end long")


def stitched(parts: DataFrame, least: int = LEAST) -> DataFrame:
    """``(rid, start, length, period)``: whole runs with their smallest period, and parts of such under its multiples."""
    order = Window.partitionBy("rid", "period").orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = parts.withColumn("fresh", F.when(F.col("begin") <= before, 0).otherwise(1))
    island = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = island.groupBy("rid", "period", "island").agg(F.min("begin").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start") + F.col("period")
    runs = whole.select("rid", "start", length.alias("length"), "period").filter(F.col("length") >= F.greatest(F.lit(least), 2 * F.col("period")))
    return runs.groupBy("rid", "start", "length").agg(F.min("period").alias("period"))


def smallest(runs: list[Run]) -> list[Run]:
    """The runs of a text without those that lie in a run of a divisor of their period."""
    by_period: dict[int, tuple[list[int], list[int]]] = {}
    for start, length, period in sorted(runs):
        starts, ends = by_period.setdefault(period, ([], []))
        starts.append(start)
        ends.append(start + length)
    divisors = {q: [p for p in by_period if p < q and q % p == 0] for q in by_period}
    out = []
    for start, length, period in runs:
        for p in divisors[period]:
            starts, ends = by_period[p]
            i = bisect_right(starts, start) - 1
            if i >= 0 and ends[i] >= start + length:
                break
        else:
            out.append((start, length, period))
    return out


def periodic_runs(docs: DataFrame, emit: Emit, schema: str, words: Words = lambda _, text: words_of(text), least: int = LEAST) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: ``emit(doc_id, words, runs)`` as columns of ``schema``.

    ``words`` takes a text apart, ``runs`` are ``(start, length, period)`` by start, then period.
    """
    work = opened(docs, emit, schema, words, least)
    runs = stitched(fragments(work.filter(F.col("kind") == TILE)), least)
    lists = runs.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    texts = work.filter(F.col("kind") == OPEN).select("rid", "id", "z").join(lists, "rid", "left").select("id", "z", "runs")
    out = _parse_datatype_string(schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            made = []
            for key, z, found in zip(*(batch.column(c).to_pylist() for c in ("id", "z", "runs")), strict=True):
                made.append(emit(key, unpack.decompress(z).split(), smallest([(r["start"], r["length"], r["period"]) for r in found or ()])))
            columns = list(zip(*made, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return work.filter(F.col("kind") == SETTLED).select("out.*").unionByName(texts.mapInArrow(finish, out))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without what any run repeats after its first period."""
    if not runs:
        return words
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        marks[start + period] += 1
        marks[start + length] -= 1
    gone = np.cumsum(marks[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def collapsed_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, n_runs)``: texts with each run cut to its first period; a text without runs stays as it is."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def emit(doc_id: object, words: list[bytes], runs: list[Run]) -> tuple:
        return doc_id, b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass"), len(runs)

    return periodic_runs(docs, emit, f"doc_id {key}, text string, n_runs long")


DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digests(doc_id: object, words: list[bytes], runs: list[Run]) -> tuple:
    """The longest run, and hashes of all runs and of the collapsed text."""
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *longest, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()


def with_planted_runs(doc_id: int | None, text: str | None) -> list[bytes]:
    """The words of a text; in one document of ten, by the CRC of its id, the tail repeats an earlier stretch."""
    words = words_of(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def run_digests(docs: DataFrame) -> DataFrame:
    """Runs of the documents, planted ones included; a null id plants none."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return periodic_runs(ids, digests, DIGESTS, with_planted_runs)
