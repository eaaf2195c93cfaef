"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their beginnings (stems carry endings), each once, hashed to 63 bits. From
a bounded sample of labelled rows the terms that tell the labels apart are counted in tasks and ranked by their
likelihood ratio, and after them terms that do so only among the rows that hold some other term. The machine learns a weight and a short vector per chosen term; the inner products of the vectors are
the weights of pairs, so an insult together with a group weighs more than both alone. Scoring reads whole texts, one pass.

Bounds, all parameters: ``sample`` labelled rows, ``terms`` chosen terms, ``rank`` numbers per vector. The fit on this
bounded sample runs in the driver on the chosen terms alone; counts and scores are Spark jobs.

Defined cases: rows without id or label teach nothing; an id labelled twice is toxic if one label says so; without both
labels in the sample every text gets the smoothed share of label 1 (0.5 for no rows); a null or empty text has no terms
and gets the bias; ids, labels, language and source never enter a score; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import by_batch, packed_row, stored

SAMPLE = 12_000
TERMS = 2_048
RANK = 8
LEAST_G = 7.0
LEAST_LIFT = 2.5
LEAST_PAIR_G = 40.0
SEEDS = 16
COMPANY = 1_024
SAMPLE_TASKS = 8
THRESHOLD = 0.7
HELD_OUT = 1
STARTS = (4, 5, 6)
MEMO = 100_000
WORDS = re.compile(r"[^\W_]+")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose CRC-32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == HELD_OUT, F.lit(False))


def terms_of(word: str) -> list[int]:
    """Hashes of a lower-cased word and of its beginnings."""
    texts = [word, *(f"{word[:n]}*" for n in STARTS if len(word) > n)]
    return [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t in texts]


def words(text: str | None) -> set[str]:
    return set(WORDS.findall(text.lower())) if text else set()


@dataclass(frozen=True)
class Machine:
    index: dict[int, int]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, rows: np.ndarray) -> float:
        v = self.vectors[rows]
        x = self.bias + self.weights[rows].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(text, y)`` of at most about ``sample`` labelled rows outside the held-out third, picked by the hash of the id."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = known.filter(~held_out())
    share = min(1.0, sample / max(1, known.count()))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    chosen = known.filter(place < share).select(F.col("doc_id").alias("_id"), "y")
    # bounded by ``sample`` rows of two numbers, so it may be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "y")


def _counts(rows: DataFrame) -> DataFrame:
    def work(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        ys, texts = batch.column("y").to_pylist(), batch.column("text").to_pylist()
        for i in range(0, len(ys), 1000):
            found = [np.unique([h for w in words(t) for h in terms_of(w)]).astype(np.int64) for t in texts[i : i + 1000]]
            terms, where = np.unique(np.concatenate(found), return_inverse=True)
            toxic = np.repeat(np.array(ys[i : i + 1000]), [len(f) for f in found])
            yield {"term": terms, "pos": np.bincount(where[toxic == 1], minlength=len(terms)), "neg": np.bincount(where[toxic != 1], minlength=len(terms))}

    return by_batch(rows, "term long, pos long, neg long", work).groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def chosen_terms(rows: DataFrame, positive: int, negative: int, terms: int = TERMS) -> list[int]:
    """The ``terms`` terms with the largest likelihood ratio G between the labels, of those that shift the odds.

    A term counts where its share of texts differs between the labels by the factor ``LEAST_LIFT`` or more, so words of
    a language that is only a little more often toxic stay out; G ranks what is left by evidence.
    """
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    every = float(positive + negative)
    share = (pos + neg) / every

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g = 2 * (
        part(pos, share * positive) + part(neg, share * negative)
        + part(positive - pos, (1 - share) * positive) + part(negative - neg, (1 - share) * negative)
    )
    lift = ((pos + 0.5) / (positive + 1.0)) / ((neg + 0.5) / (negative + 1.0))
    told = (lift >= LEAST_LIFT) | (lift <= 1 / LEAST_LIFT)
    ranked = _counts(rows).filter("pos + neg > 2").select("term", g.alias("g"), told.alias("told")).filter(F.col("told") & (F.col("g") >= LEAST_G))
    return [r["term"] for r in ranked.orderBy(F.desc("g"), "term").limit(terms).collect()]


def _split(rows: DataFrame, seeds: list[int], common: list[int]) -> DataFrame:
    """``(seed, term, pos, neg)``, both by number: rows of the sample that hold both; the seeds are among ``common``. A task counts in one table of fixed size."""
    sizes = (2, len(seeds), len(common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_term = _indexer({h: i for i, h in enumerate(common)})
        seed_of = np.full(len(common), -1)
        seed_of[[common.index(h) for h in seeds]] = np.arange(len(seeds))
        table = np.zeros(sizes, dtype=np.int64)
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = of_term(text)
                held = seed_of[found]
                if (held >= 0).any():
                    table[int(y == 1)][np.ix_(held[held >= 0], found)] += 1
        seed, term = np.nonzero(table.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seed, pa.int32()), pa.array(term, pa.int32()), *(pa.array(table[k][seed, term]) for k in (1, 0))], names=["seed", "term", "pos", "neg"])

    counted = rows.coalesce(SAMPLE_TASKS).mapInArrow(run, "seed int, term int, pos long, neg long")
    return counted.groupBy("seed", "term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def company_terms(rows: DataFrame, known: list[int], positive: int, negative: int) -> list[int]:
    """Terms that tell the labels apart only in company: their share differs among the rows that hold some other term.

    Looked at are the ``COMPANY`` terms that split the sample most evenly, beside the ``SEEDS`` most even and the ``SEEDS`` best chosen
    ones. There are as many trials as pairs, so the evidence asked for is higher (``LEAST_PAIR_G``).
    """
    even = F.least(F.col("pos") + F.col("neg"), F.lit(positive + negative) - F.col("pos") - F.col("neg"))
    common = [r["term"] for r in _counts(rows).orderBy(F.desc(even), "term").limit(COMPANY).collect()]
    seeds = list(dict.fromkeys([*known[:SEEDS], *common[:SEEDS]]))
    if not seeds or not common:
        return []
    met = {(r["seed"], r["term"]): (r["pos"], r["neg"]) for r in _split(rows, seeds, list(dict.fromkeys([*common, *seeds]))).collect()}
    place = {h: i for i, h in enumerate(dict.fromkeys([*common, *seeds]))}
    best: dict[int, tuple[float, int]] = {}
    for s, seed in enumerate(seeds):
        all_pos, all_neg = met.get((s, place[seed]), (0, 0))
        if not all_pos or not all_neg:
            continue
        for h, t in place.items():
            pos, neg = met.get((s, t), (0, 0))
            lift = ((pos + 0.5) / (all_pos + 1)) / ((neg + 0.5) / (all_neg + 1))
            if 1 / LEAST_LIFT < lift < LEAST_LIFT:
                continue
            share = (pos + neg) / (all_pos + all_neg)
            cells = ((pos, share * all_pos), (neg, share * all_neg), (all_pos - pos, (1 - share) * all_pos), (all_neg - neg, (1 - share) * all_neg))
            g = 2 * sum(seen * np.log(seen / expected) for seen, expected in cells if seen > 0)
            if g >= LEAST_PAIR_G:
                best[h] = max(best.get(h, (0.0, 0)), (g, -s))
    ranked = sorted(best, key=lambda h: (-best[h][0], h))
    return list(dict.fromkeys(x for h in ranked for x in (seeds[-best[h][1]], h)))


def _indexer(index: dict[int, int]):
    memo: dict[str, tuple[int, ...]] = {}

    def rows(text: str | None) -> np.ndarray:
        found: set[int] = set()
        for w in words(text):
            at = memo.get(w)
            if at is None:
                if len(memo) >= MEMO:
                    memo.clear()
                at = memo[w] = tuple(index[h] for h in terms_of(w) if h in index)
            if at:
                found.update(at)
        return np.array(sorted(found), dtype=np.int64)

    return rows


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS, rank: int = RANK, epochs: int = 30) -> Machine:
    rows = stored(labelled_sample(docs, labels, sample), "toxic-sample")
    count = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive, negative = count.get(1, 0), sum(n for y, n in count.items() if y != 1)
    share = (positive + 1) / (positive + negative + 2)
    flat = Machine({}, float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, rank)))
    if not positive or not negative:
        return flat
    alone = chosen_terms(rows, positive, negative, terms)
    company = company_terms(rows, alone, positive, negative)
    index = {h: i for i, h in enumerate(list(dict.fromkeys([*alone, *company]))[:terms])}
    if not index:
        return flat

    def work(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        of = _indexer(index)
        yield {"y": batch.column("y").to_pylist(), "at": [of(t).tolist() for t in batch.column("text").to_pylist()]}

    seen = by_batch(rows, "y int, at array<int>", work).groupBy("y", "at").agg(F.count(F.lit(1)).alias("n")).collect()
    seen.sort(key=lambda r: (r["y"], r["at"]))
    return Machine(index, *_learn([r["at"] for r in seen], np.array([r["y"] == 1 for r in seen], dtype=np.float32), np.array([r["n"] for r in seen], dtype=np.float32), len(index), rank, epochs))


def _learn(at: list[list[int]], y: np.ndarray, n: np.ndarray, size: int, rank: int, epochs: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss with L2, by Adam over seeded mini-batches; equal rows come once with their number."""
    random = np.random.default_rng(7)
    x = np.zeros((len(y), size), dtype=np.float32)
    for i, cols in enumerate(at):
        x[i, cols] = 1
    share = float((y * n).sum() / n.sum())
    state = [np.array([np.log(share / (1 - share))], dtype=np.float32), np.zeros(size, dtype=np.float32), random.normal(0, 0.05, (size, rank)).astype(np.float32)]
    first, second, step = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state], 0
    batch = 512
    for _ in range(max(epochs, 400 * batch // max(len(y), 1))):
        order = random.permutation(len(y))
        for i in range(0, len(y), batch):
            part = order[i : i + batch]
            xb, (b, w, v) = x[part], state
            xv = xb @ v
            pair = 0.5 * (xv**2 - xb @ v**2).sum(axis=1)
            p = 1 / (1 + np.exp(-np.clip(b + xb @ w + pair, -30, 30)))
            err = (p - y[part]) * n[part] / n[part].sum()
            col = xb.T @ err
            grads = [np.array([err.sum()]), col + 1e-5 * w, xb.T @ (err[:, None] * xv) - col[:, None] * v + 1e-4 * v]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                state[k] = state[k] - 0.03 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return float(state[0][0]), state[1].astype(np.float64), state[2].astype(np.float64)


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """``(doc_id, score)`` per row."""

    def work(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        of = _indexer(machine.index)
        yield {"doc_id": batch.column("doc_id").to_pylist(), "score": [machine.score(of(t)) for t in batch.column("text").to_pylist()]}

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, score double", work)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, rows as they are."""
    machine = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _indexer(machine.index)
        for batch in batches:
            yield batch.filter(pa.array([machine.score(of(t)) < threshold for t in batch.column("row").field("text").to_pylist()], type=pa.bool_()))

    rows = docs.select(packed_row(docs).alias("row"))
    return rows.mapInArrow(run, rows.schema).select("row.*")
