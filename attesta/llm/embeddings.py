"""Near-duplicate vectors by rotated binary codes with correction factors.

Equal vectors of a label are one class. A class gets the signs of its randomly rotated unit vector as a code, and the
inner product of code and vector as its correction factor. Candidates come from the codes: classes of a label meet when
they agree in one of several runs of sign bits. The length of a run grows with the logarithm of the table and the
number of runs with the recall wanted, by ``bands``. Of two that meet, code and factor of one and the rotated vector of
the other give an unbiased estimate of their cosine with an error bound; only pairs whose upper bound reaches the
threshold are computed again, in double precision, and those at or above it link.

A run shared by many classes is cut into blocks of ``TILE``; pairs of blocks are tasks of bounded size, and a pair that
shares several runs counts in the first. Tasks put out counts per class and spanning links, never pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers, and rows without label, link with
nothing and are kept; vectors of different lengths do not link; every row is a vector, so a repeated row links with its
twin; a null id is never named as component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import stored
from attesta.llm.components import components, stars

COSINE = 0.93
RECALL = 0.97
SURE = 4.0  # standard errors of the confidence bound
TILE = 512
SEED = 11
PAIRS_AT_ONCE = 400_000


def bands(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(bits per run, runs): a pair at the threshold shares a run with probability ``recall``."""
    bits = max(6, math.ceil(math.log2(max(n, 2))) - 2)
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def rotation(size: int, no: int) -> np.ndarray:
    """A seeded random rotation."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, size, no)).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _coded(classes: DataFrame, bits: int, runs: int) -> DataFrame:
    """Adds ``code``, ``factor`` and ``keys``, one number per run of sign bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, list[np.ndarray]] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                if size not in turns:
                    turns[size] = [rotation(size, k) for k in range(-(-bits * runs // size))]
                x = _unit(part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size))
                turned = [x @ r for r in turns[size]]
                signs = np.concatenate([t > 0 for t in turned], axis=1)[:, : bits * runs]
                keys = signs.reshape(len(x), runs, bits) @ weights
                factor = np.abs(turned[0]).sum(axis=1) / math.sqrt(size)
                codes = np.packbits(turned[0] > 0, axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * runs), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factor), lists],
                    names=[*part.schema.names, "code", "factor", "keys"],
                )

    added = T._parse_datatype_string("code binary, factor double, keys array<long>")
    return classes.mapInArrow(run, T.StructType([*classes.schema.fields, *added.fields]))


class _Group:
    """Rows of the tiles at hand as arrays."""

    def __init__(self, batch: pa.RecordBatch | pa.Table) -> None:
        get = lambda c: batch.column(c).combine_chunks() if isinstance(batch, pa.Table) else batch.column(c)
        number = lambda c: get(c).to_numpy(zero_copy_only=False)
        self.cid, self.rows, self.run, self.block = number("cid"), number("rows"), number("run"), number("block")
        self.tile = np.stack([number("key"), number("i"), number("j")], axis=1)
        self.size = number("size")
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = get("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        lists = get("keys")
        self.keys = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(self.cid), -1)
        self.factor, self.code = number("factor"), get("code").to_pylist()

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        size = int(self.size[rows[0]])
        return _unit(self.flat[self.at[rows][:, None] + np.arange(size)])

    def signs(self, rows: np.ndarray) -> np.ndarray:
        size = int(self.size[rows[0]])
        raw = np.frombuffer(b"".join(self.code[i] for i in rows.tolist()), dtype=np.uint8).reshape(len(rows), -1)
        return np.unpackbits(raw, axis=1, count=size) * 2.0 - 1.0


def _linked(group: _Group, left: np.ndarray, right: np.ndarray, cosine: float) -> np.ndarray:
    """Which of these index pairs (one vector length) link and meet here first."""
    rows, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    i, j = where[: len(left)], where[len(left) :]
    size = int(group.size[rows[0]])
    ok = np.argmax(group.keys[left] == group.keys[right], axis=1) == group.run[left]
    x = group.vectors(rows)
    turned, signs, f = x @ rotation(size, 0), group.signs(rows), group.factor[rows]
    bound = np.sqrt(np.maximum(1 - f**2, 0)) / f * (SURE / math.sqrt(size - 1) if size > 1 else math.inf)
    k = np.flatnonzero(ok)
    for a in range(0, len(k), 50_000):
        part = k[a : a + 50_000]
        estimate = np.einsum("nd,nd->n", turned[i[part]], signs[j[part]]) / (math.sqrt(size) * f[j[part]])
        part_ok = ~(estimate + bound[j[part]] < cosine)
        again = part[part_ok]
        part_ok[part_ok] = np.einsum("nd,nd->n", x[i[again]], x[j[again]]) >= cosine
        ok[part] = part_ok
    return ok


def _links(tiles: DataFrame, cosine: float) -> DataFrame:
    """``(cid, links, a, b)``: rows linked per class, and spanning links, from rows sorted by tile."""

    def settle(group: _Group) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.any(np.diff(group.tile, axis=0) != 0, axis=1)) + 1
        begins, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(group.cid)]])
        left: dict[int, list] = {}
        right: dict[int, list] = {}
        held = 0
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            rows = np.arange(a, b)
            if group.tile[a, 1] == group.tile[a, 2]:
                i, j = np.triu_indices(b - a, 1)
                i, j = i + a, j + a
            else:
                one, two = rows[group.block[a:b] == group.tile[a, 1]], rows[group.block[a:b] == group.tile[a, 2]]
                i, j = np.repeat(one, len(two)), np.tile(two, len(one))
            size = int(group.size[a])
            left.setdefault(size, []).append(i)
            right.setdefault(size, []).append(j)
            held += len(i)
            if held >= PAIRS_AT_ONCE:
                yield from out(group, left, right)
                left, right, held = {}, {}, 0
        yield from out(group, left, right)

    def out(group: _Group, left: dict[int, list], right: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for size in left:
            i, j = np.concatenate(left[size]), np.concatenate(right[size])
            if not len(i):
                continue
            ok = _linked(group, i, j, cosine)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            ids, code = np.unique(np.concatenate([group.cid[i], group.cid[j]]), return_inverse=True)
            sums = np.bincount(code, weights=np.concatenate([group.rows[j], group.rows[i]])).astype(np.int64)
            node, centre = stars(group.cid[i], group.cid[j], 0)
            order = np.argsort(node)
            to = centre[order][np.searchsorted(node[order], ids)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums), pa.array(to)], names=["cid", "links", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j")], axis=1)
            edge = np.flatnonzero(np.any(np.diff(tile, axis=0) != 0, axis=1)) + 1
            cut = int(edge[-1]) if len(edge) else 0
            if not cut and last is not None and tuple(tile[0]) != last:
                cut = -1  # the batch is one tile, and another than the kept one
            if cut:
                ready = [*kept, batch.slice(0, cut)] if cut > 0 else kept
                yield from settle(_Group(pa.Table.from_batches(ready)))
                kept = [batch.slice(max(cut, 0))]
            else:
                kept.append(batch)
            last = tuple(tile[-1])
        if kept:
            yield from settle(_Group(pa.Table.from_batches(kept)))

    return tiles.mapInArrow(run, "cid long, links long, b long")


def _tiles(coded: DataFrame, tile: int) -> DataFrame:
    """Rows of each run that two classes share, dealt to tiles (key, i, j) of at most two blocks."""
    met = coded.select("cid", "label", "size", F.posexplode("keys").alias("run", "bits"))
    keyed = stored(met.select("cid", "run", F.xxhash64("label", "size", "run", "bits").alias("key")), "vectors-keys")
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / F.lit(tile)).cast("long")
    placed = keyed.join(counts, "key").select("cid", "run", "key", F.pmod(F.xxhash64("cid", "key"), parts).alias("block"), parts.alias("parts"))
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    pairs = dealt.select("cid", "run", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return pairs.join(coded, "cid")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors(vec_id, embedding, label)``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label"))
    usable = F.coalesce(_usable(F.col("vector")) & F.col("label").isNotNull(), F.lit(False))
    hashed = rows.select(
        "vec_id", "vector", "label", usable.alias("usable"),
        F.when(usable, F.struct(F.xxhash64("label", "vector").alias("x"), F.xxhash64("vector", "label", F.lit(SEED)).alias("y"))).alias("same"),
    )
    grouped = hashed.filter("usable").groupBy("same").agg(
        F.first("vector").alias("vector"), F.first("label").alias("label"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("rows")
    )
    classes = stored(grouped.withColumn("cid", F.monotonically_increasing_id()).withColumn("size", F.size("vector")), "vectors-classes")
    bits, runs = bands(classes.count(), cosine, recall)
    coded = stored(_coded(classes.select("cid", "rows", "label", "size", "vector"), bits, runs), "vectors-codes")
    tiles = _tiles(coded, tile).drop("label")
    found = stored(_links(tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), cosine), "vectors-links")
    roots = components(found.select(F.col("cid").alias("a"), "b"))
    counted = found.groupBy("cid").agg(F.sum("links").alias("links"))
    rooted = classes.join(counted, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
    rooted = rooted.select("same", "first_id", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("same").alias("_same"), "n_links", "component_id")
    joined = hashed.select("vec_id", "same").join(named, F.col("same") == F.col("_same"), "left")
    component = F.when(F.col("_same").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
