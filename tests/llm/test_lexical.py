import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from attesta.llm import lexical

from .conftest import DOCS, ODD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, top=10):
    lists = [(d, Counter(terms(t))) for d, t, *_ in docs]
    n_docs, total = sum(bool(c) for _, c in lists), sum(sum(c.values()) for _, c in lists)
    df = Counter(t for _, c in lists for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for d, counts in lists:
            n = sum(counts.values())
            m = 10 + 90 * n * n_docs // total if total else 0
            score = sum(lexical.weight(n_docs, df[t]) * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in set(terms(text)) if t in counts)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:top], 1)]
    return sorted(out, key=str)


def answers(docs, items, **given):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(docs, items, **given).collect()), key=str)


def corpus(prose):
    r = random.Random(11)
    words = "the of and a in to it".split() + prose(1, 300).split()
    texts = [" ".join(r.choice(words[: r.randrange(3, len(words))]) for _ in range(r.randrange(1, 120))) for _ in range(150)]
    texts += [texts[3]] * 14 + [None, "", " ...--- ", "É é ÉCOLE école x", "don't-stop 42nd", "the " * 3000 + texts[5], "THE Of", "x\x00y"]
    return texts


def questions(prose):
    texts = corpus(prose)
    return [(i, " ".join(texts[i].split()[:25])) for i in range(0, 60, 4)] + [
        (100, None), (101, ""), (102, "?!"), (103, "nowhere unknown"), (104, "The the THE of"), (105, "école É x"), (106, "42nd stop y"), (None, "the of and"),
        (100, "a in it"), (104, "The the THE of"), (107, texts[3]),
    ]


def test_against_brute_force(make, prose, doc_rows):
    rows = doc_rows(corpus(prose))
    rows += [rows[3], rows[5], (None, rows[3][1], "en", "s", 1), (4, rows[3][1], "en", "s", 1)]
    assert answers(make(DOCS, rows), make(ITEMS, questions(prose))) == brute(rows, questions(prose))


def test_small_blocks_and_joined_documents_agree(make, prose, doc_rows, monkeypatch):
    rows = doc_rows(corpus(prose))
    for name, value in (("BLOCK_DOCS", 9), ("DOCS_AT_ONCE", 20), ("TERMS_AT_ONCE", 30), ("ITEMS_AT_ONCE", 4), ("BROADCAST_DOCS", 0)):
        monkeypatch.setattr(lexical, name, value)
    monkeypatch.setattr(lexical.blocks, "__defaults__", (300,))
    assert answers(make(DOCS, rows), make(ITEMS, questions(prose)), top=3) == brute(rows, questions(prose), 3)


def test_bounds_are_never_below_scores(prose):
    texts = [t for t in corpus(prose) if terms(t)]
    counts = [Counter(lexical.terms_of(t)) for t in texts]
    signed = [lexical.Signed(i, sum(c.values()), max(c.values()), lexical.entry_keys(c)) for i, c in enumerate(counts)]
    words = sorted({t for c in counts for t in c})
    total = sum(s.size for s in signed)
    df = Counter(t for c in counts for t in c)
    items = [(i, [words.index(t) for t in set(lexical.terms_of(texts[i]))]) for i in range(0, len(texts), 9)]
    asked = lexical.Queries("q", len(texts), total, words, [lexical.weight(len(texts), df[t]) for t in words], items)
    bound = defaultdict(dict)
    for rows, ids, sizes, most, bits in lexical.bitmaps(signed):
        for no, found in asked.bounds(rows, sizes, most, bits):
            bound[no].update(zip(ids, found.tolist(), strict=True))
    close = []
    for no in range(len(items)):
        for i, text in enumerate(texts):
            ((_, score),) = asked.scores(text, [no])
            assert bound[no].get(i, 0) >= score
            if score:
                close.append(bound[no][i] / score)
    assert np.median(close) < 1.25  # close enough to exclude most documents


def test_rescored_documents_are_few(make, spark, prose, doc_rows):
    rows = doc_rows([prose(i, 80) for i in range(400)])
    docs, items = make(DOCS, rows), make(ITEMS, [(i, prose(i, 30)) for i in range(5)])
    built = lexical.index(docs)
    assert (built.docs, built.terms) == (400, sum(len(terms(r[1])) for r in rows))
    assert built.counts.groupBy("term").sum("df").count() == len({t for r in rows for t in terms(r[1])})
    (block,) = lexical.blocks(items)
    assert [i for i, _ in block] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a b", "en", "s", 3)], []), ([(1, None, "en", "s", 3)], [(1, "a")]), ([], [])])
def test_empty(make, docs, items):
    assert lexical.search(make(DOCS, docs), make(ITEMS, items)).count() == 0


def test_clashing_columns(make):
    rows = [(1, "alpha beta", "en", "s", 7, "r", "k", 1, "s", "z", "p", "q", "f")]
    docs = make(ODD, rows)
    docs = docs.withColumns({c: docs["rid"] for c in ("no", "_id", "_nos", "rank", "item_id", "bits", "a.b")})
    items = make(ITEMS, [(5, "beta")]).selectExpr("*", "item_id AS doc_id", "text AS no", "text AS `c.d`")
    assert [(i, r, d) for i, r, d, _ in answers(docs, items)] == [(5, 1, 1)]
