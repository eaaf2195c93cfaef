"""Removal of repeated passages by difference-cover anchors.

A passage is a window of ``WINDOW`` words. Hashes are taken only at word positions whose remainder modulo ``PERIOD`` lies
in a difference cover: for any two positions there is one shift below the period that brings both into the cover. Two
equal windows therefore share an equal anchor of ``WINDOW - PERIOD + 1`` words at one shift. Anchors that occur once end
the matter for about every text that is new. Around the others, and only there, the windows are extended to full length
and hashed, and those that start twice anywhere cover the words to remove.

Both rounds run alike: a task packs its (hash, row, position) entries by hash range into one binary value per range, so
a shuffled entry takes some eleven bytes; settled places travel back packed by ranges of rows. Equal hashes inside a
task are settled there, so a passage that every text holds sends one entry per task. Texts move once, compressed, and unaffected ones not again. Hashes have 64 bits; a wrong
removal needs an anchor and a window that both collide.

Defined cases: a null or empty text has no words; each row counts as a text of its own, equal rows and equal ids
included, so a repeated row of ``WINDOW`` words loses them all; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import col, stored, words_of

WINDOW = 35
PERIOD = 21
COVER = (0, 1, 6, 8, 18)  # every difference modulo 21 occurs among these
WORDS_AT_ONCE = 200_000
ENTRIES_AT_ONCE = 1_000_000
RANGE_BYTES = 4_000_000
BASE = 0x9E3779B97F4A7C15
Picker = Callable[[int, object], np.ndarray]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` word hashes (polynomial modulo 2^64)."""
    n = len(words)
    if n < length:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * _powers(BASE, n), out=sums[1:])
    found = (sums[length:] - sums[:-length]) * _powers(pow(BASE, -1, 2**64), n - length + 1)
    return (found ^ (found >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def _ranges(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def cover_positions(n: int, _: object) -> np.ndarray:
    """Anchor starts in a text of ``n`` words."""
    at = np.arange(max(0, n - (WINDOW - PERIOD)))
    return at[np.isin(at % PERIOD, COVER)] if n >= WINDOW else at[:0]


def near_positions(n: int, anchors: object) -> np.ndarray:
    """Window starts that hold one of the anchors."""
    if n < WINDOW or anchors is None or not len(anchors):
        return np.zeros(0, dtype=np.int64)
    marks = np.zeros(n + 1, dtype=np.int64)
    a = np.unique(np.asarray(anchors, dtype=np.int64))
    np.add.at(marks, np.maximum(a - PERIOD + 1, 0), 1)
    np.add.at(marks, a + 1, -1)
    at = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
    return at[at <= n - WINDOW]


SENT = pa.schema([("part", pa.int32()), ("hashes", pa.binary()), ("rows", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])
FOUND = pa.schema([("rid", pa.int64()), ("places", pa.list_(pa.int32()))])


class _Sender:
    """Collects entries of a task and packs them by hash range."""

    def __init__(self, parts: int) -> None:
        self.parts, self.kept, self.held = parts, [], 0
        self.pack = zstandard.ZstdCompressor(level=3)

    def add(self, rids: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.kept.append((hashes, rids, places))
        self.held += len(hashes)
        if self.held >= ENTRIES_AT_ONCE:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        hashes, rids, places = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        self.kept, self.held = [], 0
        _, first, code, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        again = times[code] > 1
        yield from _packed_places(rids[again], places[again], self.parts)
        one = np.sort(first)
        part = _ranges(hashes[one], self.parts)
        one = one[np.argsort(part, kind="stable")]
        part = np.sort(part)
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=self.parts))
        out: list[list] = [[], [], [], [], []]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            at = one[a:b]
            rows, counts, steps = _steps(rids[at], places[at])
            for column, value in zip(out, (int(part[a]), hashes[at].astype("<u8").tobytes(), rows, counts, self.pack.compress(steps)), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, SENT, strict=True)], schema=SENT)


def _mix(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * np.uint64(BASE)


def _steps(rids: np.ndarray, places: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Rows, places per row and place differences, of entries whose rows stand together."""
    starts = np.flatnonzero(np.diff(rids, prepend=rids[0] ^ 1))
    return rids[starts].astype("<i8").tobytes(), np.diff(starts, append=len(rids)).astype("<i4").tobytes(), np.diff(places, prepend=0).astype("<i4").tobytes()


def _entries(rows: bytes, counts: bytes, steps: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.frombuffer(rows, "<i8"), np.frombuffer(counts, "<i4")), np.cumsum(np.frombuffer(steps, "<i4"), dtype=np.int64)


def _packed_places(rids: np.ndarray, places: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Settled places as one row per range of row ids, without hashes."""
    if not len(rids):
        return
    pack = zstandard.ZstdCompressor(level=3)
    part = _ranges(_mix(rids.view(np.uint64)), parts)
    order = np.lexsort((rids, part))
    rids, places, part = rids[order], places[order], part[order]
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    out: list[list] = [[], [], [], [], []]
    for a, b in zip(edges, edges[1:], strict=False):
        rows, counts, steps = _steps(rids[a:b], places[a:b])
        for column, value in zip(out, (int(part[a]), None, rows, counts, pack.compress(steps)), strict=True):
            column.append(value)
    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, SENT, strict=True)], schema=SENT)


def _hashed(texts: DataFrame, length: int, pick: Picker, parts: int) -> DataFrame:
    """Packed entries of the picked positions of ``(rid, z, hint)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, unpack = _Sender(parts), zstandard.ZstdDecompressor()

        def chunk(rids: list[int], lists: list[list[bytes]], hints: list) -> Iterator[pa.RecordBatch]:
            sizes = [len(x) for x in lists]
            flat = np.array([w for x in lists for w in x], dtype=object)
            found = window_hashes(pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64), length)
            picked = [pick(n, h) for n, h in zip(sizes, hints, strict=True)]
            places = np.concatenate(picked)
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            per = [len(p) for p in picked]
            if len(places):
                yield from sender.add(np.repeat(np.array(rids, dtype=np.int64), per), found[places + np.repeat(begins, per)], places)

        for batch in batches:
            rids, lists, hints, held = [], [], [], 0
            for rid, z, hint in zip(*(batch.column(c).to_pylist() for c in ("rid", "z", "hint")), strict=True):
                words = unpack.decompress(z).split() if isinstance(z, bytes) else words_of(z)
                if len(words) < WINDOW:
                    continue
                rids.append(rid)
                lists.append(words)
                hints.append(hint)
                held += len(words)
                if held >= WORDS_AT_ONCE:
                    yield from chunk(rids, lists, hints)
                    rids, lists, hints, held = [], [], [], 0
            if rids:
                yield from chunk(rids, lists, hints)
        yield from sender.flush()

    return texts.mapInArrow(run, "part int, hashes binary, rows binary, counts binary, places binary")


def _settled(packed: DataFrame, parts: int) -> DataFrame:
    """Packed places of the entries whose hash occurs twice; all entries of a hash range meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        range_no = None

        def settle() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            hashes, rids, places = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(hashes, kind="stable")
            h = hashes[order]
            twin = np.zeros(len(h), dtype=bool)
            twin[1:] = h[1:] == h[:-1]
            twin[:-1] |= twin[1:]
            at = order[twin]
            yield from _packed_places(rids[at], places[at], parts)

        for batch in batches:
            known = batch.filter(batch.column("hashes").is_null())
            if known.num_rows:
                yield known
            for part, hashes, rows, counts, places in zip(*(batch.column(c).to_pylist() for c in SENT.names), strict=True):
                if hashes is None:
                    continue
                if part != range_no:
                    yield from settle()
                    held.clear()
                    range_no = part
                held.append((np.frombuffer(hashes, "<u8"), *_entries(rows, counts, unpack.decompress(places))))
        yield from settle()

    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, packed.schema)


def _gathered(packed: DataFrame, parts: int) -> DataFrame:
    """``(rid, places)``, one row per affected text; a range of row ids meets in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        range_no = None

        def gather() -> Iterator[pa.RecordBatch]:
            if held:
                rids, places = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((places, rids))
                rids, places = rids[order], places[order]
                starts = np.flatnonzero(np.diff(rids, prepend=rids[0] ^ 1))
                offsets = pa.array(np.append(starts, len(rids)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(rids[starts]), pa.ListArray.from_arrays(offsets, pa.array(places.astype(np.int32)))], schema=FOUND)

        for batch in batches:
            for part, rows, counts, places in zip(*(batch.column(c).to_pylist() for c in ("part", "rows", "counts", "places")), strict=True):
                if part != range_no:
                    yield from gather()
                    held.clear()
                    range_no = part
                held.append(_entries(rows, counts, unpack.decompress(places)))
        yield from gather()

    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "rid long, places array<int>")


def ranges_for(docs: DataFrame) -> int:
    """Number of hash ranges, so that one holds about the anchors of ``RANGE_BYTES`` of text, whatever the cluster's settings."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // RANGE_BYTES))


def repeats(texts: DataFrame, length: int, pick: Picker, parts: int) -> DataFrame:
    """``(rid, places)``: the picked positions at which a run of ``length`` words starts that starts elsewhere too."""
    return _gathered(_settled(_hashed(texts, length, pick, parts), parts), parts)


def _compressed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [None if t is None else pack.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("row"), pa.array(packed, pa.binary())], names=["rid", "row", "z"])

    schema = T.StructType([rows.schema["rid"], rows.schema["row"], T.StructField("z", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``row`` (the columns of ``docs`` but the text), ``text``, ``n_words``, ``n_removed`` and ``kept``, the words that
    stay joined by one blank."""
    others = [col(c) for c in docs.columns if c != "text"]
    parts = ranges_for(docs)
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.struct(*others).alias("row"), "text")
    anchors = repeats(rows.select("rid", F.col("text").alias("z"), F.lit(None).cast("array<int>").alias("hint")), WINDOW - PERIOD + 1, cover_positions, parts)
    known = stored(_compressed(rows).join(anchors, "rid", "left").withColumnRenamed("places", "hint"), "repeats-texts")
    windows = repeats(known.filter("hint IS NOT NULL").select("rid", "z", "hint"), WINDOW, near_positions, parts)
    plain = known.filter("hint IS NULL").select("row", "z", F.col("hint").alias("places"))
    touched = known.filter("hint IS NOT NULL").drop("hint").join(windows, "rid", "left").select("row", "z", "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            texts, kept, sizes, gone = [], [], [], []
            for z, places in zip(batch.column("z").to_pylist(), batch.column("places").to_pylist(), strict=True):
                raw = None if z is None else unpack.decompress(z)
                words = raw.split() if raw else []
                n = len(words)
                if places:
                    marks = np.zeros(n + 1, dtype=np.int64)
                    at = np.unique(np.asarray(places, dtype=np.int64))
                    np.add.at(marks, at, 1)
                    np.add.at(marks, at + WINDOW, -1)
                    covered = np.cumsum(marks[:-1]) > 0
                    words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                texts.append(None if raw is None else raw.decode("utf-8", "surrogatepass"))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                sizes.append(n)
                gone.append(n - len(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=["row", "text", "n_words", "n_removed", "kept"],
            )

    out = T._parse_datatype_string("text string, n_words long, n_removed long, kept string")
    return plain.unionByName(touched).mapInArrow(cut, T.StructType([rows.schema["row"], *out.fields]))


def substring_digests(docs: DataFrame) -> DataFrame:
    out = without_repeats(docs.select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut out; a text without any stays as it is, ``n_chars`` follows the text."""
    out = without_repeats(docs)
    whole = F.col("n_removed") == 0
    text = F.when(whole, F.col("text")).otherwise(F.col("kept"))

    def value(name: str) -> Column:
        own = F.col("row")[name]
        if name == "n_chars":
            own = F.when(whole, own).otherwise(F.length("kept").cast(docs.schema["n_chars"].dataType))
        return (text if name == "text" else own).alias(name)

    return out.select(*[value(c) for c in docs.columns])
