import math
import random

import numpy as np
import pytest

from attesta.llm import embeddings

from .test_components import brute as union

VECTORS = "vec_id long, embedding array<float>, label int, key string, size string, vector string, rows int"


def brute(rows, cosine=0.93):
    """n_links and component of every row by all pairs."""
    good = []
    for i, (_, e, label, *_) in enumerate(rows):
        if e and label is not None and all(x is not None and math.isfinite(x) for x in e) and any(e):
            good.append((i, np.array(e, dtype=np.float32).astype(np.float64), label))
    edges, links = [(i, i) for i in range(len(rows))], [0] * len(rows)
    for a, (i, x, l) in enumerate(good):
        for j, y, m in good[a + 1 :]:
            if l == m and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                edges.append((i, j))
                links[i] += 1
                links[j] += 1
    least = {i: min((rows[j][0] for j in g if rows[j][0] is not None), default=None) for g in union(edges) for i in g}
    return sorted(((str(r[0]), links[i], least[i]) for i, r in enumerate(rows)), key=str)


def around(r, centre, spread, n, start, label):
    return [(start + i, (centre + r.normal(0, spread, len(centre))).tolist(), label, None, None, None, 1) for i in range(n)]


def rows_of(seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        rows += around(r, r.normal(0, 1, 32), 0.12, 15, 1000 * (c + 1), c % 3)
    rows += around(r, np.zeros(32), 1, 120, 1, 0)
    rows += [(50_000 + i, rows[0][1], 0, None, None, None, 1) for i in range(30)] + [rows[3], (None, rows[0][1], 0, None, None, None, 1), (None, [1.0, 2.0], 7, None, None, None, 1)]
    rows += [(60_000, None, 0), (60_001, [], 0), (60_002, [0.0] * 32, 0), (60_003, [math.nan] + [1.0] * 31, 0), (60_004, [math.inf] * 32, 0), (60_005, [None] + [1.0] * 31, 0), (60_006, rows[0][1], None)]
    rows += [(70_000, [2.0, 0.0], 1), (70_001, [1.0, 1e-3], 1), (70_002, [5.0], 1), (70_003, [7.0], 1), (70_004, [-7.0], 1), (70_005, [1e-30] * 32, 2), (70_006, [1e30] * 32, 2)]
    return [(*x, None, None, None, 1)[:7] for x in rows]


@pytest.mark.parametrize("tile", [512, 7])
def test_against_all_pairs(make, tile):
    rows = rows_of()
    out = embeddings.near_vectors(make(VECTORS, rows), recall=0.9999, tile=tile).collect()
    assert sorted(((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in out), key=str) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_recall_at_the_threshold(make):
    """Pairs just above the threshold, the hardest there are."""
    r, rows = np.random.default_rng(9), []
    for i in range(300):
        x = r.normal(0, 1, 64)
        x /= np.linalg.norm(x)
        y = r.normal(0, 1, 64)
        y -= y @ x * x
        y /= np.linalg.norm(y)
        rows += [(2 * i, x.tolist(), 1, None, None, None, 1), (2 * i + 1, (0.932 * x + math.sqrt(1 - 0.932**2) * y).tolist(), 1, None, None, None, 1)]
    out = embeddings.near_vectors(make(VECTORS, rows)).collect()
    assert sum(x["n_links"] for x in out) >= 0.9 * 600
    assert all(x["component_id"] == x["vec_id"] // 2 * 2 for x in out if x["n_links"])


def test_estimate_is_unbiased_and_bounded():
    r = np.random.default_rng(3)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in r.normal(0, 1, (2, 4000, 64)))
    turn = embeddings.rotation(64, 0)
    code, factor = np.sign(y @ turn), np.abs(y @ turn).sum(axis=1) / 8
    error = np.einsum("nd,nd->n", x @ turn, code) / (8 * factor) - np.einsum("nd,nd->n", x, y)
    bound = np.sqrt(1 - factor**2) / factor * embeddings.SURE / math.sqrt(63)
    assert abs(error.mean()) < 0.01 and (np.abs(error) <= bound).mean() > 0.999


def test_empty(make):
    assert embeddings.near_vectors(make(VECTORS, [])).count() == 0
    random.seed(0)
