import random
import zlib

from attesta.llm import toxicity

from .conftest import DOCS, ODD

LABELS = "doc_id long, quality int, toxic int, text string"
INSULTS = ["grumbletoad", "snotwizard", "mudbrain"]


def corpus(prose, n=600):
    r = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        words = prose(i, r.randrange(5, 120)).split()
        toxic = i % 5 == 0
        for _ in range(2 if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(INSULTS) + r.choice(["", "s", "ish"]))
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic), "label text"))
    return docs, labels


def test_held_out_accuracy(make, prose):
    docs, labels = corpus(prose)
    out = toxicity.toxicity(make(DOCS, docs), make(LABELS, labels)).collect()
    assert len(out) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r["held_out"]]
    right = sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)


def test_held_out_labels_teach_nothing(make, prose):
    docs, labels = corpus(prose, 300)
    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t, x) for d, q, t, x in labels]
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.toxicity(make(DOCS, docs), make(LABELS, x)).collect()} for x in (labels, turned))
    assert a == b


def test_pairs_are_learnt_beyond_sums():
    """Two terms that are harmless alone: the labels are their product, which no sum of weights separates this well."""
    import numpy as np

    at = [[0], [1], [0, 1], []] * 50
    y = np.array([0, 0, 1, 0] * 50, dtype=np.float32)
    machine = toxicity.Machine({}, *toxicity._learn(at, y, np.ones(len(at), dtype=np.float32), 2, 8, 30))
    scores = [machine.score(np.array(a, dtype=np.int64)) for a in at[:4]]
    assert scores[2] > 0.9 and max(scores[0], scores[1], scores[3]) < 0.1


def _accuracy(make, prose, label, n=2400):
    r = random.Random(18)
    docs, labels = [], []
    for i in range(n):
        a, b = r.random() < 0.5, r.random() < 0.5
        words = [*prose(i, r.randrange(5, 60)).split(), *["kestrelgroup"] * a, *["waspword"] * b]
        r.shuffle(words)
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(label(a, b)), "label text"))
    toxic = {d: t for d, _, t, _ in labels}
    held = toxicity.toxicity(make(DOCS, docs), make(LABELS, labels)).filter("held_out").collect()
    assert len(held) > n / 4
    return sum(r["predicted"] == toxic[r["doc_id"]] for r in held) / len(held)


def test_both_words_are_found(make, prose):
    assert _accuracy(make, prose, lambda a, b: a and b) >= 0.95


def test_exactly_one_of_two_words_is_found(make, prose):
    """Neither word shifts the labels by itself, and no sum of weights gives these labels."""
    assert _accuracy(make, prose, lambda a, b: a != b) >= 0.95


def test_scores_are_those_of_a_double_loop(make, prose):
    """Every pair by itself, over the whole table."""
    import math

    docs, labels = corpus(prose, 250)
    table = make(DOCS, docs)
    machine = toxicity.fit(table, make(LABELS, labels))
    found = {r["doc_id"]: r["score"] for r in toxicity.scored(table, machine).collect()}
    assert len(machine.index) > 1
    for doc, text, *_ in docs:
        at = sorted({machine.index[h] for w in toxicity.words(text) for h in toxicity.terms_of(w) if h in machine.index})
        x = machine.bias + sum(machine.weights[i] for i in at)
        for no, i in enumerate(at):
            for j in at[:no]:
                x += sum(a * b for a, b in zip(machine.vectors[i].tolist(), machine.vectors[j].tolist(), strict=True))
        assert abs(found[doc] - 1 / (1 + math.exp(-max(-30, min(30, x))))) < 1e-9


def test_odd_rows(make, prose):
    docs, labels = corpus(prose, 200)
    odd = [(None, "no id", "en", "s", 1), (900, None, None, None, None), (901, "", "en", "s", 1), (902, "é" * 50000 + " mudbrain snotwizard", "en", "s", 1), docs[0]]
    labels = [*labels, (None, 1, 1, None), (3, 1, None, None), (999, 1, 1, None), labels[0]]
    out = {str(r["doc_id"]): r for r in toxicity.toxicity(make(DOCS, docs + odd), make(LABELS, labels)).collect()}
    assert out["900"]["score"] == out["901"]["score"] < 0.5
    assert out["902"]["predicted"] == 1
    assert out["None"]["held_out"] is False


def test_without_labels_or_rows(make, prose):
    docs, labels = corpus(prose, 20)
    assert {r["score"] for r in toxicity.toxicity(make(DOCS, docs), make(LABELS, [])).collect()} == {0.5}
    assert {r["predicted"] for r in toxicity.toxicity(make(DOCS, docs), make(LABELS, [x for x in labels if not x[2]])).collect()} == {0}
    assert toxicity.toxicity(make(DOCS, []), make(LABELS, labels)).count() == 0


def test_stage(make, prose):
    docs, labels = corpus(prose)
    wide = [(*d, "r", "k", 1, "s", "z", "p", "q", "f") for d in docs]
    kept = toxicity.clean(make(ODD, wide), make(LABELS, labels))
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == make(ODD, wide).columns
    assert len(ids & {i for i in range(600) if i % 5}) >= 475
    assert len(ids & {i for i in range(600) if i % 5 == 0}) <= 4
