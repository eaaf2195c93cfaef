import random

import pytest

from attesta.llm import components as c


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(1, 1)],
        [(i, i + 1) for i in range(300)],
        [(0, i) for i in range(200)] + [(500, 501), (501, 500)],
        [(random.Random(i).randrange(400), random.Random(i + 999).randrange(400)) for i in range(300)],
        [(-(2**63), 2**63 - 1), (5, -(2**63))],
    ],
)
def test_against_union_find(make, monkeypatch, edges):
    monkeypatch.setattr(c, "CHUNK", 20)
    found = {}
    for r in c.components(make("a long, b long", edges)).collect():
        found.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, found.values())) == brute(edges)
