import random

import pytest

from attesta.llm import decontamination as d

from .conftest import DOCS, ODD

ITEMS = "item_id long, text string, note string"


def edits(pattern, text):
    """Least edit distance of the pattern to any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def changed(text, n, r):
    s = list(text)
    for _ in range(n):
        i = r.randrange(len(s))
        kind = r.randrange(3)
        if kind == 0:
            s[i] = r.choice("abcdef")
        elif kind == 1:
            del s[i]
        else:
            s.insert(i, r.choice("abcdef"))
    return "".join(s)


def test_myers_is_the_edit_distance():
    r = random.Random(1)
    for _ in range(150):
        p, t = ("".join(r.choice("abc") for _ in range(r.randrange(1, 90))) for _ in range(2))
        assert d.myers(p, t, len(p))[0] == edits(p, t)


@pytest.mark.parametrize("size", [4_000_000, 100])
def test_against_all_pairs(make, prose, doc_rows, size):
    r = random.Random(4)
    items = [(i, prose(i, 12).capitalize() + ".", None) for i in range(8)] + [(8, "tiny item", None), (9, None, None), (10, "", None), (None, "no id here", None)]
    texts = [None, "", "Tiny, ITEM!", "a tiny item here", prose(90, 4000), prose(3, 12) * 2]
    for i in range(8):
        body = d.reduced(items[i][1])
        for n in (0, 3, d.budget(len(body)), d.budget(len(body)) + 9):
            texts.append(f"{prose(50 + i, 15)} {changed(body, n, r)} {prose(60 + i, 9)}")
        texts.append(body[: len(body) // 2])
    rows = [*doc_rows(texts), (None, prose(2, 12), "en", "s", 1)]
    want = set()
    for doc, text, *_ in rows:
        line = d.reduced(text)
        for item, body, _ in items:
            body = d.reduced(body)
            if item is None or not body:
                continue
            if len(body) < d.SHORT:
                if f" {body} " in f" {line} ":
                    want.add((doc, item, 0))
            elif (e := edits(body, line)) <= d.budget(len(body)):
                want.add((doc, item, e))
    out = d.contaminated(make(DOCS, rows), make(ITEMS, items), size=size).collect()
    assert {(x["doc_id"], x["item_id"], x["edits"]) for x in out} == want
    assert len(out) == len(want)
    clean = d.decontaminated(make(DOCS, rows), make(ITEMS, items), size=size).collect()
    dirty = {w[0] for w in want}
    assert sorted(str(x["doc_id"]) for x in clean) == sorted(str(x[0]) for x in rows if x[0] not in dirty)


def test_texts_that_begin_or_end_inside_an_item(make, doc_rows, prose):
    items = [(i, f"what {prose(20 + i, 11)}", None) for i in range(3)]
    texts, want = [], set()
    for i, body, _ in items:
        body = d.reduced(body)
        for cut in (1, 2, 5, d.budget(len(body)), d.budget(len(body)) + 1):
            for text in (f"{body[cut:]} {prose(70 + i, 30)}", f"{prose(80 + i, 30)} {body[: len(body) - cut]}", body[cut:], body[: len(body) - cut]):
                e = edits(body, d.reduced(text))
                if e <= d.budget(len(body)):
                    want.add((len(texts), i, e))
                texts.append(text)
    rows = doc_rows(texts)
    out = d.contaminated(make(DOCS, rows), make(ITEMS, items)).collect()
    assert {(x["doc_id"], x["item_id"], x["edits"]) for x in out} == want
    left = {x["doc_id"] for x in d.decontaminated(make(DOCS, rows), make(ITEMS, items)).collect()}
    assert left == set(range(len(texts))) - {w[0] for w in want}


def test_short_items_are_found_inside_texts(make, doc_rows, prose):
    item = "What is the capital of"
    texts = [item, f"{prose(1, 20)}. {item}, {prose(2, 20)}", f"{prose(1, 9)} what is the capital off {prose(2, 9)}", f"somewhat is the capital of {prose(3, 9)}", prose(4, 30), f"{prose(5, 9)} {item}", f"{item} {prose(6, 9)}"]
    out = d.contaminated(make(DOCS, doc_rows(texts)), make(ITEMS, [(1, item, None)])).collect()
    assert {(x["doc_id"], x["edits"]) for x in out} == {(0, 0), (1, 0), (5, 0), (6, 0)}


def test_empty_and_other_columns(make, prose):
    none = make(ITEMS, [])
    assert d.contaminated(make(DOCS, []), make(ITEMS, [(1, prose(1, 12), None)])).count() == 0
    assert d.contaminated(make(DOCS, [(1, "x", "en", "s", 1)]), none).count() == 0
    rows = [(1, prose(1, 30), "en", "s", 7, "r", "k", 1, "s", "z", "p", "q", "f")] * 2
    out = d.decontaminated(make(ODD, rows), none)
    assert sorted(map(tuple, out.collect())) == sorted(rows)


def test_any_column_name_passes_through(make, prose, doc_rows):
    frame = make(DOCS, doc_rows([prose(1, 30), prose(2, 30)]))
    names = ("item_id", "edits", "begin", "a.b")
    out = d.decontaminated(frame.withColumns({n: frame["lang"] for n in names}), make(ITEMS, [(1, prose(1, 30), None)]))
    assert out.columns == [*frame.columns, *names] and [r["text"] for r in out.collect()] == [prose(2, 30)]
