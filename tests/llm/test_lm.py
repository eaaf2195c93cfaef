import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np

from attesta.llm import lm

from .conftest import DOCS, ODD


def kind(doc_id):
    if doc_id is None:
        return lm.MAIN
    crc = zlib.crc32(str(doc_id).encode())
    return lm.HELD if crc % 10 == 0 else lm.FOLD if crc // 10 % lm.DELETED == 0 else lm.MAIN


def brute(rows):
    texts = [(d, kind(d), ["".join(c.lower() if c.isascii() else c for c in w.decode()) for w in (t or "").encode().split()] + ["\n"]) for d, t, *_ in rows]

    def count(kinds):
        grams = Counter()
        for _, k, tokens in texts:
            if k in kinds:
                line = ["<s>", "<s>", *tokens]
                for i in range(2, len(line)):
                    grams.update([(line[i],), tuple(line[i - 1 : i + 1]), tuple(line[i - 2 : i + 1])])
        docs = grams[("\n",)]
        words = [g for g in grams if len(g) == 1]
        tokens, types = sum(grams[g] for g in words), len(words)
        grams[("<s>",)] = grams["<s>", "<s>"] = docs
        return grams, lambda w: (grams[w,] + 0.1) / (tokens + 0.1 * (types + 1)), tokens

    def estimates(grams, base, line, i):
        u, v, w = line[i - 2 : i + 1]
        out = [grams[u, v, w] / max(1, grams[u, v]), grams[v, w] / max(1, grams[v,]), base(w)]
        return out, [0 if not n else 1 + int(math.log2(n)) for n in (grams[u, v], grams[v,])]

    grams, base, _ = count({lm.MAIN})
    events = [estimates(grams, base, ["<s>", "<s>", *tokens], i) for _, k, tokens in texts if k == lm.FOLD for i in range(2, len(tokens) + 2)]
    weights = lm.first_weights()
    for _ in range(lm.ROUNDS):
        sums = np.zeros((2, 2, lm.BUCKETS))
        for (p3, p2, p1), (b3, b2) in events:
            a3, a2 = weights[1, b3], weights[0, b2]
            shares = np.array([a3 * p3, (1 - a3) * a2 * p2, (1 - a3) * (1 - a2) * p1])
            shares = shares / shares.sum()
            sums[1, :, b3] += [shares[0], 1]
            sums[0, :, b2] += [shares[1], shares[1] + shares[2]]
        weights = lm.updated(sums)
    grams, base, n_train = count({lm.MAIN, lm.FOLD})
    out = []
    for d, k, tokens in texts:
        line, score = ["<s>", "<s>", *tokens], 0.0
        for i in range(2, len(line)):
            (p3, p2, p1), (b3, b2) = estimates(grams, base, line, i)
            a3, a2 = weights[1, b3], weights[0, b2]
            score += math.log10(a3 * p3 + (1 - a3) * (a2 * p2 + (1 - a2) * p1))
        out.append((str(d), k == lm.HELD, len(tokens), sum(grams[w,] > 0 for w in tokens), n_train, round(sum(math.log10(base(w)) for w in tokens), 7), round(score, 7)))
    return sorted(out)


def found(df):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 7), round(r["score"], 7)) for r in df.collect())


def corpus(n=400):
    """Sentences of a small grammar, so that contexts tell something about the next word."""
    r = random.Random(12)
    names, verbs, things = "Ann Bob Cid Dee Eve".split(), "eats sees likes finds".split(), "apples pears plums figs dates".split()
    texts = []
    for i in range(n):
        line = [f"{a} {verbs[(i + j) % 4] if r.random() < 0.5 else verbs[names.index(a) % 4]} {r.choice(things)} ." for j, a in enumerate(r.choices(names, k=r.randrange(1, 8)))]
        texts.append(" ".join(line))
    texts += [texts[5]] * 9 + [None, "", " \x0b\x0c\t", "É é UNSEEN", "never\x1cseen words\xa0here", "a " * 500]
    return texts


def test_against_brute_force(make, doc_rows):
    rows = doc_rows(corpus())
    rows += [rows[3], (None, corpus()[4], "en", "s", 1), (3, "another text", "en", "s", 1)]
    assert {kind(d) for d, *_ in rows} == {lm.MAIN, lm.FOLD, lm.HELD}
    assert found(lm.language_scores(make(DOCS, rows))) == brute(rows)


def test_small_chunks_and_many_ranges_agree(make, doc_rows, monkeypatch):
    rows = doc_rows(corpus())
    monkeypatch.setattr(lm, "CHUNK", 200)
    monkeypatch.setattr(lm, "RANGE_TOKENS", 500)
    assert found(lm.language_scores(make(DOCS, rows).repartition(5))) == brute(rows)


def test_model_beats_the_base_on_held_out_texts(make, doc_rows):
    rows = {r["held_out"]: r for r in lm.perplexity(lm.language_scores(make(DOCS, doc_rows(corpus(1500))))).collect()}
    assert rows[True]["model"] < 0.5 * rows[True]["base"]


def test_estimates_sum_to_one(make):
    """Over all words and the unknown one, after any context."""
    counts = {(3, 7): 2, (3, 8): 1, (7, 1): 4}
    base = lm.Base(tokens=20, words=3, docs=2)
    one = {7: 9, 8: 6, 1: 5}
    for of_three, threes in ((5, {7: 3, 8: 2}), (0, {})):
        weights = np.random.default_rng(1).uniform(0, 0.99, (2, lm.BUCKETS))
        weights[:, 0] = 0
        line = [np.array(x) for x in zip(*[(threes.get(w, 0), of_three, counts.get((3, w), 0), 3, one.get(w, 0)) for w in (7, 8, 1, None)], strict=True)]
        p3, p2, p1, b3, b2 = lm.orders(line, base)
        whole = weights[1][b3] * p3 + (1 - weights[1][b3]) * (weights[0][b2] * p2 + (1 - weights[0][b2]) * p1)
        assert abs(whole.sum() - 1) < 1e-12


def test_packing():
    r = np.random.default_rng(2)
    for values in ([], [0], [1, 255, 256], r.integers(0, 2**63, 100), np.array([2**64 - 1, 5], dtype=np.uint64)):
        values = np.array(values, dtype=np.uint64)
        assert lm.unpacked(lm.packed(values)).tolist() == values.tolist()


def test_ranges_hold_every_key():
    for tokens in (1, 10**6, 10**9, 10**13):
        shape = lm.Shape.of(tokens)
        keys = np.array([0, 1, 2 ** (shape.bits + 2) - 1], dtype=np.uint64)
        edges = shape.edges(keys)
        assert edges[0] == 0 and edges[-1] == 3


def test_long_text_clashing_columns_and_nothing_to_learn_from(make):
    held = next(i for i in range(100) if kind(i) == lm.HELD)
    frame = make(ODD, [(held, "to be or not " * 60_000, "en", "s", 7, "r", "k", 1, "s", "z", "p", "q", "f"), (held, None, "en", "s", 7, "r", "k", 1, "s", "z", "p", "q", "f")])
    frame = frame.withColumns({c: frame["rid"] for c in ("kind", "chunk", "fold", "ids", "sizes", "held_out", "a.b")})
    assert found(lm.language_scores(frame)) == [(str(held), True, 1, 0, 0, 0.0, 0.0), (str(held), True, 240_001, 0, 0, 0.0, 0.0)]


def test_empty(make):
    assert lm.language_scores(make(DOCS, [])).count() == 0


def test_a_task_holds_few_bytes_a_token():
    numbers = np.random.default_rng(1)
    vocab, codes = np.unique(numbers.integers(0, 2**62, 20_000).astype(np.uint64)[numbers.integers(0, 20_000, 100_000)], return_inverse=True)
    row = {"sizes": [10_000] * 10, "kinds": [lm.MAIN] * 9 + [lm.FOLD], "vocab": lm.packed(np.diff(vocab, prepend=np.uint64(0))), "codes": lm.packed(codes)}
    tracemalloc.start()
    grams = lm.Grams(row, lm.Shape.of(100_000))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 130 * 100_000
    assert (grams.keys[grams.at].reshape(3, -1) & np.uint64(3) == np.arange(1, 4, dtype=np.uint64)[:, None]).all()


def test_words_of_a_chunk_in_the_making_are_held_as_hashes():
    held, words = lm.Held(), [f"w{i % 70}".encode() for i in range(lm.WORDS)]
    held.add(1, lm.MAIN, words)
    held.add(2, lm.MAIN, [])
    assert len(held._words) == 1 and held.tokens == lm.WORDS + 2 and held.sizes == [lm.WORDS + 1, 1]
    vocab, codes = lm.distinct(held.taken())
    assert (vocab[codes] == lm.hashed([*words, lm.END, lm.END])).all()
    assert all((a == b).all() for a, b in zip(lm.distinct(vocab[codes]), np.unique(vocab[codes], return_inverse=True), strict=True))
