"""Connected components of an edge table, by rounds of contraction.

Each task joins the edges it reads with a union-find over at most ``CHUNK`` edges and puts out a star for each part.
A node then has one star centre per chunk that saw it; these centres are the nodes of the next, smaller graph. Centres
are picked by a hash that changes with the round, so a long chain shrinks by a constant factor as well. No round moves
more than its edges, no list grows beyond the number of chunks, and nothing of the graph is on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import stored

CHUNK = 200_000


def _mixed(nodes: np.ndarray, salt: int) -> np.ndarray:
    x = nodes.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stars(a: np.ndarray, b: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, centre) for every node of these edges; the centre has the least hash of its part."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    rank = np.empty(len(nodes), dtype=np.int64)
    rank[np.argsort(_mixed(nodes, salt), kind="stable")] = np.arange(len(nodes))
    at = np.empty(len(nodes), dtype=nodes.dtype)
    at[rank] = nodes
    ends = rank[code]
    parent = list(range(len(nodes)))
    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    root = np.asarray(parent, dtype=np.int64)
    while True:
        up = root[root]
        if np.array_equal(up, root):
            break
        root = up
    return at, at[root]


def _contract(edges: DataFrame, salt: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            node, centre = stars(np.concatenate(left), np.concatenate(right), salt)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(centre)], names=["node", "centre"])

        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            for i in range(0, len(a), CHUNK):
                left.append(a[i : i + CHUNK])
                right.append(b[i : i + CHUNK])
                held += len(left[-1])
                if held >= CHUNK:
                    yield out()
                    left, right, held = [], [], 0
        if held:
            yield out()

    found = edges.select("a", "b").mapInArrow(run, "node long, centre long")
    order = F.struct(F.xxhash64("centre", F.lit(salt)), F.col("centre"))
    return found.groupBy("node").agg(F.min_by("centre", order).alias("up"), F.collect_set("centre").alias("centres"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: nodes that links join, directly or not, share one root.

    The root is some node of the component. Repeated edges and loops change nothing; an empty table gives an empty one.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    levels: list[DataFrame] = []
    while True:
        level = stored(_contract(edges, len(levels)), "components")
        levels.append(level.select("node", "up"))
        edges = level.select(F.col("up").alias("a"), F.explode("centres").alias("b")).filter("a <> b")
        if edges.isEmpty():
            break
    out = levels[0].withColumnRenamed("up", "root")
    for level in levels[1:]:
        out = out.join(level.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return out
