import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from attesta.llm import simhash
from attesta.llm.components import components

from .conftest import DOCS, ODD
from .test_components import brute as union


def plain(text):
    """The fingerprint by one counter per bit."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def grouped(rows):
    """doc_id to (fingerprint, component) by comparing all pairs."""
    prints = [(d, plain(t)) for d, t, *_ in rows]
    distinct = sorted({p for _, p in prints})
    edges = [(p, p) for p in distinct] + [(a, b) for a, b in combinations(distinct, 2) if (a ^ b).bit_count() <= 2]
    of = {p: g for g in union(edges) for p in g}
    least = lambda p: min((d for d, q in prints if q in of[p] and d is not None), default=None)
    return sorted((str(d), f"{p:016x}", least(p)) for d, p in prints)


def test_fingerprints_and_components(make, prose, doc_rows):
    texts = [prose(i) for i in range(30)]
    near = [t.replace(t.split()[5], "changed", 1) for t in texts[:10]]
    long = prose(77, 20000)
    rows = doc_rows([*texts, *near, texts[0], texts[0].upper(), None, "", " \t\n", "one", "one two", "ONE two", "É É", "é é", long, long + " more"])
    rows += [(None, texts[1], "en", "s", 1), rows[3], (None, "alone without id", "en", "s", 1)]
    out = simhash.near_duplicates(make(DOCS, rows)).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in out) == grouped(rows)


@pytest.mark.parametrize("limit", [256, 3])
def test_links_join_all_within_two_bits(make, limit):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = {b ^ sum(1 << x for x in r.sample(range(64), r.randrange(4))) for b in base for _ in range(12)} | {0, 2**64 - 1}
    signed = sorted(int(np.uint64(p).view(np.int64)) if p else 0 for p in prints)
    edges = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    found = {}
    for x in components(simhash.links(make("fp long", [(s,) for s in signed]), limit=limit)).collect():
        found.setdefault(x["root"], set()).add(x["node"])
    assert sorted(map(sorted, found.values())) == union(edges)


def test_stage_keeps_one_of_each_group(make, prose, doc_rows):
    rows = doc_rows([prose(1), prose(2), prose(1), prose(3), prose(2) + "", None, ""])
    rows += [rows[0], (None, prose(9), "en", "s", 1)]
    kept = simhash.deduplicated(make(DOCS, rows))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "1", "3", "5", "None"]
    odd = [(*x, "r", "k", 1, "s", "z", "p", "q", "f") for x in rows]
    assert simhash.deduplicated(make(ODD, odd)).count() == 5


def test_unrelated_texts_under_one_id_all_stay(make, prose):
    texts = [prose(1), prose(2), prose(3)]
    rows = [(1, texts[0], "en", "s", 1), (1, texts[1], "en", "s", 1), (2, texts[2], "en", "s", 1), (2, texts[0], "en", "t", 1), (None, texts[1], "en", "s", 1), (1, texts[0], "en", "s", 1)]
    kept = simhash.deduplicated(make(DOCS, rows).withColumn("a.b", F.lit(1)).withColumn("place", F.lit("x")).withColumn("row", F.lit("y")))
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in kept.collect()) == sorted([(1, texts[0], "s"), (1, texts[1], "s"), (2, texts[2], "s")])
    # which row stays does not hang on how the rows are dealt
    again = simhash.deduplicated(make(DOCS, rows[::-1]).repartition(3))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, kept.select(*again.columns).collect()))


def test_a_wider_radius_is_refused(make):
    with pytest.raises(ValueError, match="radius"):
        simhash.links(make("fp long", [(1,)]), radius=3)


def test_empty(make):
    assert simhash.near_duplicates(make(DOCS, [])).count() == 0
    assert simhash.deduplicated(make(DOCS, [])).count() == 0
