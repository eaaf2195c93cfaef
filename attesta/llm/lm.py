"""Language-model scores by deleted interpolation of word trigrams.

``P3 = a3 * c(u v w) / c(u v) + (1 - a3) * P2``, ``P2 = a2 * c(v w) / c(v) + (1 - a2) * P1``; ``P1`` is the additive
unigram estimate. The weights ``a3`` and ``a2`` depend on the bucket (power of two) of how often the context was seen.
They are learned by expectation-maximisation: one document of ``DELETED`` is taken out of the counts, and the weights
are those that make it most likely under the counts of the rest. Scores then use the counts of all training documents.

Texts become chunks of about ``CHUNK`` tokens: sorted hashes of the chunk's words and a code per token, written once. Each
chunk sends its distinct n-grams with their counts, packed by hash range, and gets back only those that other chunks
have too; its own counts hold for the rest. So what moves are a few bytes per distinct n-gram of a chunk, a common
n-gram moves once per chunk, and no range or chunk holds more than a stated number of entries.

N-grams meet by hashes of ``SPARE`` bits more than the tokens need to be numbered: one n-gram in a million shares its
count with another. Equal hashes of words within 64 bits are taken for equal words.

Defined cases: a null or empty text is the end token alone; each row is a text of its own, equal rows included; null ids
are trained on; where nothing is trained on, every token has the base probability 1; other columns are not read. A text is
held by one task at a time, whatever its length; a text longer than ``CHUNK`` is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import stored
from attesta.session import shared_folder

CHUNK = 1_000_000
WORDS = 50_000  # words held as texts; beyond that their hashes are
RANGE_TOKENS = 1_000_000  # tokens of the corpus per hash range
SPARE = 20
DELETED = 20
BUCKETS = 32
ROUNDS = 10
MOST = 0.999  # no weight leaves nothing to the lower order
ADDED = 0.1

MAIN, FOLD, HELD = 0, 1, 2
#: A-Z to a-z.
LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
END = b"\n"  # no word holds it

CHUNKS = "chunk long, fold boolean, ids array<long>, kinds array<int>, sizes array<int>, vocab binary, codes binary, main_docs long, fold_docs long, main_tokens long, fold_tokens long"
PACKED = "part int, chunk long, keys binary, main binary, fold binary"
RETURNS = "chunk long, part int, places binary, main binary, fold binary, main_words long, words long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def hashed(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


START = np.uint64(hashed([b" "])[0])


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes, as many as the largest needs."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(value: bytes) -> np.ndarray:
    width = value[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(value[1:]), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and the place of each value among them: as ``np.unique`` gives them, in less than half the memory."""
    order = np.argsort(values)
    values = values[order]
    first = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    small = np.int32 if len(values) < 1 << 31 else np.int64
    at = np.empty(len(values), dtype=small)
    at[order] = np.cumsum(first, dtype=small) - small(1)
    return values[first], at


class Held:
    """What a chunk in the making holds: its documents, and the hashes of their words."""

    def __init__(self) -> None:
        self.ids: list = []
        self.kinds: list[int] = []
        self.sizes: list[int] = []
        self.tokens = 0
        self._words: list[bytes] = []
        self._hashes: list[np.ndarray] = []

    def add(self, doc_id: int | None, kind: int, words: list[bytes]) -> None:
        self.ids.append(doc_id)
        self.kinds.append(kind)
        self.sizes.append(len(words) + 1)
        self.tokens += len(words) + 1
        self._words.extend(words)
        self._words.append(END)
        if len(self._words) >= WORDS:
            self._settle()

    def _settle(self) -> None:
        if self._words:
            self._hashes.append(hashed(self._words))
            self._words = []

    def taken(self) -> np.ndarray:
        self._settle()
        out, self._hashes = np.concatenate(self._hashes), []
        return out


def least(counts: np.ndarray) -> np.ndarray:
    """Counts of one chunk in four bytes each where they fit."""
    return counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.int64)


def kind_of(doc_id: F.Column) -> F.Column:
    """Held out (one in ten, by the CRC of the id), deleted for the weights, or counted."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.when(crc % 10 == 0, HELD).when(F.floor(crc / 10) % DELETED == 0, FOLD).otherwise(MAIN)


def chunks(docs: DataFrame) -> DataFrame:
    """Written chunks of ``docs(doc_id, text)``; those of deleted documents are apart and have odd numbers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), kind_of(F.col("doc_id")).alias("kind"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId() << 32
        held: dict[bool, Held] = {fold: Held() for fold in (False, True)}
        made = 0

        def put(fold: bool) -> pa.RecordBatch:
            nonlocal made
            kind, size = np.array(held[fold].kinds), np.array(held[fold].sizes)
            ids, kinds, sizes = held[fold].ids, held[fold].kinds, held[fold].sizes
            vocab, codes = distinct(held[fold].taken())
            held[fold] = Held()
            sums = [[int(x[kind == k].sum())] for x in (np.ones_like(size), size) for k in (MAIN, FOLD)]
            values = [[2 * (here + made) + fold], [fold], [ids], [kinds], [sizes], [packed(np.diff(vocab, prepend=np.uint64(0)))], [packed(codes)], *sums]
            made += 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)

        names = ["chunk", "fold", "ids", "kinds", "sizes", "vocab", "codes", "main_docs", "fold_docs", "main_tokens", "fold_tokens"]
        types = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), *[pa.int64()] * 4]
        for batch in batches:
            for doc_id, kind, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "kind", "text")), strict=True):
                fold = kind == FOLD
                own = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
                if held[fold].tokens and held[fold].tokens + len(own) >= CHUNK:
                    yield put(fold)
                held[fold].add(doc_id, kind, own)
        for fold in held:
            if held[fold].ids:
                yield put(fold)

    path = shared_folder(docs.sparkSession, "lm-chunks")
    rows.mapInArrow(run, CHUNKS).write.partitionBy("fold").parquet(path)
    return docs.sparkSession.read.schema(CHUNKS).parquet(path)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Shape(NamedTuple):
    """Width of the hashes and number of hash ranges, from the number of tokens."""

    bits: int
    parts: int

    @classmethod
    def of(cls, tokens: int) -> Shape:
        return cls(min(61, max(40, (3 * tokens).bit_length() + SPARE)), max(1, -(-tokens // RANGE_TOKENS)))

    def edges(self, keys: np.ndarray) -> np.ndarray:
        """Where each range begins among sorted keys."""
        width = (1 << (self.bits + 2)) // self.parts + 1
        return np.searchsorted(keys, np.arange(self.parts + 1, dtype=np.uint64) * np.uint64(width))


class Grams:
    """Distinct n-grams of a chunk (order in the low two bits of their keys) and where they stand."""

    def __init__(self, row: dict, shape: Shape) -> None:
        sizes = np.array(row["sizes"], dtype=np.int64)
        vocab = np.cumsum(unpacked(row["vocab"]), dtype=np.uint64)
        self.starts = np.cumsum(sizes) - sizes
        self.kinds = np.array(row["kinds"], dtype=np.int8)
        self.sizes, self.tokens = sizes, int(sizes.sum())
        word = vocab[unpacked(row["codes"]).astype(np.int64)]
        before = np.concatenate([word[:1], word[:-1]])
        before[self.starts] = START
        earlier = np.concatenate([before[:1], before[:-1]])
        earlier[self.starts] = START
        cut = np.uint64(64 - shape.bits)
        keys = np.empty(3 * self.tokens, dtype=np.uint64)
        for n, at in enumerate(np.split(keys, 3), 1):
            grams = word if n == 1 else _pair(before if n == 2 else _pair(earlier, before), word)
            at[:] = (_pair(np.full(1, n, dtype=np.uint64), grams) >> cut) << np.uint64(2) | np.uint64(n)
        del word, before, earlier, grams
        self.keys, self.at = distinct(keys)
        del keys
        kind = np.tile(np.repeat(self.kinds, sizes), 3)
        self.main = np.bincount(self.at[kind == MAIN], minlength=len(self.keys))
        self.fold = np.bincount(self.at[kind == FOLD], minlength=len(self.keys))

    def counts(self, counts: np.ndarray, docs: int) -> list[np.ndarray]:
        """Per token: counts of trigram, its context, bigram, its context, word. ``docs`` counts the start."""
        one, two, three = counts[self.at].reshape(3, -1)
        contexts = []
        for lower in (two, one):
            context = np.concatenate([lower[:1], lower[:-1]])
            context[self.starts] = docs
            contexts.append(context)
        return [three, contexts[0], two, contexts[1], one]


def sent(parts: DataFrame, shape: Shape) -> DataFrame:
    """The distinct n-grams of each chunk by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row, shape)
                edges = shape.edges(grams.keys)
                out: list[tuple] = []
                for part in np.flatnonzero(np.diff(edges)).tolist():
                    a, b = int(edges[part]), int(edges[part + 1])
                    keys = np.diff(grams.keys[a:b], prepend=np.uint64(0))
                    out.append((part, row["chunk"], packed(keys), packed(grams.main[a:b]), packed(grams.fold[a:b])))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)], names=["part", "chunk", "keys", "main", "fold"])

    return parts.select("chunk", "kinds", "sizes", "vocab", "codes").mapInArrow(run, PACKED)


def summed(pieces: DataFrame, shape: Shape) -> DataFrame:
    """Counts over all chunks, for the n-grams whose count is not that of their chunk; and the number of words counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: list[int] = []
        held: tuple[list[np.ndarray], ...] = ([], [], [])
        here = None

        def settle() -> Iterator[pa.RecordBatch]:
            if not chunks:
                return
            ends = np.cumsum([len(x) for x in held[0]]).tolist()
            begins = [0, *ends[:-1]]
            joined = []
            for arrays in held:
                joined.append(np.concatenate(arrays))
                arrays.clear()
            found, at = distinct(joined.pop(0))
            main, fold = joined
            totals = [np.zeros(len(found), dtype=np.int64) for _ in joined]
            for begin, end in zip(begins, ends, strict=True):
                for total, own in zip(totals, joined, strict=True):
                    total[at[begin:end]] += own[begin:end]  # a chunk has an n-gram once
            words = (found & np.uint64(3)) == 1
            del found
            known = (int((words & (totals[0] > 0)).sum()), int((words & (totals[0] + totals[1] > 0)).sum()))
            out: list[tuple] = [(None, here, b"", b"", b"", *known)]
            for chunk, begin, end in zip(chunks, begins, ends, strict=True):
                all_main, all_fold = (total[at[begin:end]] for total in totals)
                told = np.flatnonzero((all_main != main[begin:end]) | (all_fold != fold[begin:end]))
                if len(told):
                    out.append((chunk, here, packed(np.diff(told, prepend=0)), packed(all_main[told]), packed(all_fold[told]), 0, 0))
            chunks.clear()
            types = (pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["chunk", "part", "places", "main", "fold", "main_words", "words"])

        for batch in batches:
            for part, chunk, keys, main, fold in zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "keys", "main", "fold")), strict=True):
                if part != here:
                    yield from settle()
                    here = part
                chunks.append(chunk)
                for arrays, values in zip(held, (np.cumsum(unpacked(keys), dtype=np.uint64), least(unpacked(main)), least(unpacked(fold))), strict=True):
                    arrays.append(values)
        yield from settle()

    return pieces.repartition(shape.parts, "part").sortWithinPartitions("part").mapInArrow(run, RETURNS)


def _resolved(left: pa.Table, right: pa.Table, shape: Shape) -> Grams:
    """A chunk's n-grams with the counts of all chunks."""
    grams = Grams(left.to_pylist()[0], shape)
    edges = shape.edges(grams.keys)
    for row in right.to_pylist():
        at = int(edges[row["part"]]) + np.cumsum(unpacked(row["places"]).astype(np.int64))
        grams.main[at] = unpacked(row["main"])
        grams.fold[at] = unpacked(row["fold"])
    return grams


class Base(NamedTuple):
    """What the additive unigram estimate and the contexts of a text's start need."""

    tokens: int
    words: int
    docs: int

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADDED) / (self.tokens + ADDED * (self.words + 1))


def bucket(counts: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than the power of two below its count."""
    return np.where(counts > 0, np.minimum(1 + np.floor(np.log2(np.maximum(counts, 1))), BUCKETS - 1), 0).astype(np.int64)


def orders(counts: list[np.ndarray], base: Base) -> tuple[np.ndarray, ...]:
    """Estimates of the three orders and the buckets of the two contexts."""
    three, of_three, two, of_two, one = counts
    return three / np.maximum(of_three, 1), two / np.maximum(of_two, 1), base.probability(one), bucket(of_three), bucket(of_two)


def expected(counts: list[np.ndarray], base: Base, weights: np.ndarray) -> np.ndarray:
    """Sums for one round: per order and bucket, how often its estimate made the token, and how often it was asked."""
    p3, p2, p1, b3, b2 = orders(counts, base)
    a3, a2 = weights[1][b3], weights[0][b2]
    first = a3 * p3
    second = (1 - a3) * a2 * p2
    third = (1 - a3) * (1 - a2) * p1
    whole = first + second + third
    out = np.zeros((2, 2, BUCKETS))
    out[1, 0] = np.bincount(b3, first / whole, BUCKETS)
    out[1, 1] = np.bincount(b3, minlength=BUCKETS)
    out[0, 0] = np.bincount(b2, second / whole, BUCKETS)
    out[0, 1] = np.bincount(b2, (second + third) / whole, BUCKETS)
    return out


def updated(sums: np.ndarray) -> np.ndarray:
    """Weights from such sums. A bucket that nothing asked for takes the weight of the next lower one."""
    out = np.zeros((2, BUCKETS))
    for order in range(2):
        last = 0.5
        for b in range(1, BUCKETS):
            used, asked = sums[order, 0, b], sums[order, 1, b]
            last = min(MOST, used / asked) if asked > 0 else last
            out[order, b] = last
    return out


def first_weights() -> np.ndarray:
    out = np.full((2, BUCKETS), 0.5)
    out[:, 0] = 0
    return out


EVENTS = ("three", "of_three", "two", "of_two", "one")


def learned(events: DataFrame, base: Base, rounds: int = ROUNDS) -> np.ndarray:
    """Weights by expectation-maximisation; a round is one pass over the written counts of the deleted documents."""
    weights = first_weights()
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, 2, BUCKETS))
            for batch in batches:
                for row in batch.to_pylist():
                    sums += expected([unpacked(row[c]).astype(np.int64) for c in EVENTS], base, weights)
            yield pa.RecordBatch.from_arrays([pa.array(range(sums.size), pa.int32()), pa.array(sums.ravel())], names=["place", "value"])

        found = events.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        sums = np.zeros(4 * BUCKETS)
        sums[[r["place"] for r in found]] = [r["value"] for r in found]
        weights = updated(sums.reshape(2, 2, BUCKETS))
    return weights


def language_scores(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``, columns as in ``SCORES``; logarithms to base ten."""
    parts = chunks(docs)
    sums = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("main_docs", "fold_docs", "main_tokens", "fold_tokens")], F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("tokens")).first()
    shape = Shape.of(sums["tokens"])
    told = stored(summed(sent(parts, shape), shape), "lm-counts")
    words = told.agg(F.coalesce(F.sum("main_words"), F.lit(0)).alias("main"), F.coalesce(F.sum("words"), F.lit(0)).alias("all")).first()
    rest = Base(sums["main_tokens"], words["main"], sums["main_docs"])
    base = Base(sums["main_tokens"] + sums["fold_tokens"], words["all"], sums["main_docs"] + sums["fold_docs"])
    returned = told.filter("chunk IS NOT NULL").select("chunk", "part", "places", "main", "fold")
    read = parts.select("chunk", "fold", "ids", "kinds", "sizes", "vocab", "codes")

    def deleted(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c: pa.array([], pa.binary()) for c in EVENTS})
        grams = _resolved(left, right, shape)
        return pa.table({c: pa.array([packed(x)], pa.binary()) for c, x in zip(EVENTS, grams.counts(grams.main, rest.docs), strict=True)})

    folds = read.filter("fold")
    back = returned.filter("chunk % 2 = 1")
    events = stored(folds.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(deleted, ", ".join(f"{c} binary" for c in EVENTS)), "lm-events")
    weights = learned(events, rest)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in SCORES.split(", ")]
        types = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64()]
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types, strict=True)})
        grams = _resolved(left, right, shape)
        counts = grams.counts(grams.main + grams.fold, base.docs)
        p3, p2, p1, b3, b2 = orders(counts, base)
        a3, a2 = weights[1][b3], weights[0][b2]
        whole = a3 * p3 + (1 - a3) * (a2 * p2 + (1 - a2) * p1)
        per_text = [np.add.reduceat(x, grams.starts) for x in ((counts[4] > 0).astype(np.int64), np.log10(p1), np.log10(whole))]
        values = [left.column("ids")[0].values, grams.kinds == HELD, grams.sizes, per_text[0], np.full(len(grams.sizes), base.tokens), per_text[1], per_text[2]]
        return pa.table({n: pa.array(v, t) if isinstance(v, np.ndarray) else v for n, v, t in zip(names, values, types, strict=True)})

    return read.groupBy("chunk").cogroup(returned.groupBy("chunk")).applyInArrow(finish, SCORES)


def perplexity(scores: DataFrame) -> DataFrame:
    """``(held_out, n_tokens, base, model)``: perplexity per token of both estimates."""
    tokens = F.sum("n_tokens")
    return scores.groupBy("held_out").agg(
        tokens.alias("n_tokens"), F.pow(F.lit(10.0), -F.sum("base_score") / tokens).alias("base"), F.pow(F.lit(10.0), -F.sum("score") / tokens).alias("model")
    )

