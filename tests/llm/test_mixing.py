import random

from attesta.llm import mixing

from .conftest import DOCS, ODD


def filled(sizes, epochs=3.0):
    """Water-filling by repeated clamping, sources in order with null last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, budget = {}, set(names), sum(sizes.values())
    while free:
        level = budget / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > epochs * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = epochs * sizes[s]
            budget -= target[s]
        free -= over
    return target


def test_targets_and_taken(make):
    r = random.Random(3)
    shares = {"a": 900, "b": 20, "é": 40, "z": 300, None: 5, "": 60}
    rows, doc = [], 0
    for source, n in shares.items():
        for _ in range(n):
            rows.append((doc, " \t".join(["w"] * r.randrange(1, 30)), "en", source, 1))
            doc += 1
    out = mixing.mix(make(DOCS, rows)).collect()
    size = {}
    for x in out:
        size[x["source"]] = size.get(x["source"], 0) + x["size"]
    want = filled(size)
    assert len(out) == len(rows)
    for source in shares:
        mine = [x for x in out if x["source"] == source]
        assert all(abs(x["target"] - want[source]) < 1e-6 and x["source_size"] == size[source] for x in mine)
        assert abs(sum(x["taken"] for x in mine) - want[source]) <= 30
    assert all(x["taken"] <= 3 * x["size"] for x in out)


def test_reruns_agree_and_other_columns_pass(make):
    rows = [(i, "w " * (i % 7 + 1), "en", f"s{i % 4}", 1, "r", "k", 1, "s", "z", "p", "q", "f") for i in range(200)]
    a, b = (sorted(map(tuple, mixing.mixed(make(ODD, rows)).collect())) for _ in range(2))
    assert a == b and a
    assert mixing.mixed(make(ODD, rows)).columns == [*make(ODD, rows).columns, "mix_copies"]


def test_nulls_ties_and_empty(make):
    assert mixing.mix(make(DOCS, [])).count() == 0
    rows = [(None, None, None, None, None), (None, "a b", None, None, None), (1, "", "en", "s", 0), (2, "\x0b  x", "en", "s", 1), (2, "\x0b  x", "en", "s", 1)]
    out = {(x["doc_id"], x["size"]) for x in mixing.mix(make(DOCS, rows)).collect()}
    assert out == {(None, 0), (None, 2), (1, 0), (2, 2)}
    only_empty = mixing.mix(make(DOCS, [(1, "", "en", "s", 0), (2, None, "en", None, 0)])).collect()
    assert [(x["target"], x["taken"]) for x in only_empty] == [(0.0, 0), (0.0, 0)]


def test_stated_weights(make):
    rows = mixing.sized(make(DOCS, [(i, "w", "en", "ab"[i % 2], 1) for i in range(100)]))
    plan = mixing.plan(rows, make("source string, weight double", [("a", 1.0), ("b", 4.0)])).collect()
    assert {x["source"]: x["target"] for x in plan} == {"a": 20.0, "b": 80.0}


def test_any_column_name_passes_through(make, prose, doc_rows):
    frame = make(DOCS, doc_rows([prose(i, 20) for i in range(9)]))
    names = ("_key", "_below", "_repeats", "mix_copies", "row", "own_source", "mixed_source", "below", "a.b")
    out = mixing.mixed(frame.withColumns({n: frame["lang"] for n in names}))
    assert sorted(out.columns) == sorted({*frame.columns, *names})
    assert {r["a.b"] for r in out.collect()} == {"en"} and out.filter("mix_copies < 1").isEmpty()
