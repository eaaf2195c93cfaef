"""Reach over imports, one-to-one matches in rounds, and places in groups whose key is null."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from attesta.operators import graph, ordering
from attesta.plans import quality

EDGES = "repo_id string, source string, target string, edge_type string"


def brute_reach(edges, starts, depth=None, reverse=False):
    out = set()
    for repo, start in set(starts):
        near = defaultdict(set)
        for r, a, b, kind in edges:
            if r == repo and kind == "imports":
                near[b if reverse else a].add(a if reverse else b)
        seen, line = {start: 0}, deque([start])
        while line:
            at = line.popleft()
            if depth is None or seen[at] < depth:
                for to in near[at] - seen.keys():
                    seen[to] = seen[at] + 1
                    line.append(to)
        out |= {(repo, start, m, d) for m, d in seen.items() if d}
    return out


@pytest.mark.parametrize("depth", [None, 2])
@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("most_edges", [2_000_000, 60])
def test_reach_against_brute_force(spark, depth, reverse, most_edges):
    r = random.Random(6)
    edges = [(f"r{i % 3}", f"m{r.randrange(30)}", f"m{r.randrange(30)}", "imports") for i in range(130)] + [("r0", "m0", "x", "contains"), ("r2", "m1", "m1", "imports")]
    starts = [("r0", "m1"), ("r1", "m2"), ("r2", "m1"), ("r2", "m29"), ("r9", "m1"), ("r0", "nowhere"), ("r0", "m1")]
    out = graph.reachable(spark.createDataFrame(edges, EDGES), spark.createDataFrame(starts, "repo_id string, module string"), depth, reverse, most_edges)
    rows = [tuple(x) for x in out.select("repo_id", "start", "module", "distance").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_reach(edges, starts, depth, reverse)


def test_a_long_cycle_is_one_step(spark):
    n = 100_000
    ring = spark.range(n).select(F.lit("r").alias("repo_id"), F.col("id").cast("string").alias("source"), ((F.col("id") + 1) % n).cast("string").alias("target"), F.lit("imports").alias("edge_type"))
    out = graph.reachable(ring, spark.createDataFrame([("r", "7")], "repo_id string, module string"))
    row = out.agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"), F.sum("distance").alias("sum")).first()
    assert tuple(row) == (n - 1, n - 1, n * (n - 1) // 2)


def test_matches_are_those_of_taking_turns(spark):
    r = random.Random(9)
    expected, extracted = [], []
    for repo in range(12):
        for no in range(r.randrange(1, 9)):
            expected.append((f"r{repo}", no, r.choice(["a", "b"]), r.choice(["x", "y", "z", "x.*y", "[xz]"]), r.choice([None, 0.5])))
        for k in range(r.randrange(0, 12)):
            extracted.append((f"r{repo}", f"c{k:02}", r.choice(["a", "b"]), r.choice(["x", "y", "z", "xy", "zx", "q"]), r.choice([0.4, 0.9]), r.randrange(5)))
    import re

    want = set()
    taken = set()
    for repo, no, kind, pattern, least in sorted(expected):
        fits = sorted((place, c) for rp, c, k, content, sure, place in extracted if (rp, k) == (repo, kind) and (pattern in content or re.search(pattern, content)) and (least is None or sure >= least))
        for _, c in fits:
            if (repo, c) not in taken:
                taken.add((repo, c))
                want.add((repo, kind, no, c))
                break
    out = quality.match_expected(
        spark.createDataFrame(expected, "repo_id string, no int, claim_type string, pattern string, min_confidence double"),
        spark.createDataFrame(extracted, "repo_id string, claim_id string, claim_type string, content string, confidence double, place int"),
    )
    assert {tuple(x) for x in out.collect()} == want and want


def test_places_in_a_null_group(spark):
    rows = spark.createDataFrame([(None, 3), ("a", 1), (None, 1), ("a", 2), (None, 2)], "g string, v int").repartition(3)
    out = {(x["g"], x["v"], x["rank"]) for x in ordering.placed(rows, ["g"], [F.col("v").desc()]).collect()}
    assert out == {(None, 3, 1), (None, 2, 2), (None, 1, 3), ("a", 2, 1), ("a", 1, 2)}
