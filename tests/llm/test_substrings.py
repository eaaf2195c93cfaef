import hashlib
import random
from collections import Counter

from attesta.llm import substrings

from .conftest import DOCS, ODD

W = substrings.WINDOW


def brute(rows):
    lists = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    seen = Counter(tuple(w[i : i + W]) for _, w in lists for i in range(len(w) - W + 1))
    out = []
    for d, words in lists:
        gone = set()
        for i in range(len(words) - W + 1):
            if seen[tuple(words[i : i + W])] > 1:
                gone.update(range(i, i + W))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((str(d), len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def cases(prose):
    r = random.Random(2)
    passage, other = prose(1, 50), prose(2, W)
    texts = [
        f"{prose(3, 33)} {passage} {prose(4, 7)}", f"{passage}\n{prose(5, 61)}", prose(6, 20) + " " + passage, passage,
        other, other + " tail", "head " + other, " ".join(other.split()[:-1]),  # the last is one word short
        "same " * 90, prose(7, 40) + " x " + prose(7, 40), None, "", " \x0b\x0c\t", "a\x1cb\x85c\xa0d " * 40,
        prose(8, 5000) + " " + passage, f"{prose(9, 100)} {passage} {prose(10, 3)} {passage}",
    ]
    for i in range(25):  # passages of every length around the window, at every offset
        texts.append(f"{prose(100 + i, r.randrange(40))} {' '.join(prose(999, 80).split()[i : i + 25 + i])} {prose(200 + i, r.randrange(40))}")
    return texts


def digests(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.substring_digests(df).collect())


def test_against_brute_force(make, prose, doc_rows):
    rows = doc_rows(cases(prose))
    rows += [rows[20], (None, prose(50, 60), "en", "s", 1), (None, prose(50, 60), "en", "s", 1), (5, prose(51, 70), "en", "s", 1)]
    assert digests(make(DOCS, rows)) == brute(rows)


def test_small_flushes_agree(make, prose, doc_rows, monkeypatch):
    rows = doc_rows(cases(prose))
    monkeypatch.setattr(substrings, "ENTRIES_AT_ONCE", 50)
    monkeypatch.setattr(substrings, "WORDS_AT_ONCE", 100)
    assert digests(make(DOCS, rows)) == brute(rows)


def test_cover_meets_at_one_shift():
    p = substrings.PERIOD
    for a in range(p):
        for b in range(p):
            assert any((a + s) % p in substrings.COVER and (b + s) % p in substrings.COVER for s in range(p))


def test_stage_keeps_columns_and_untouched_texts(make, prose):
    line = "Kept as it is:\n\n  two  blanks"
    rows = [(1, line, "en", "s", 7, "r", "k", 1, "s", "z", "p", "q", "f"), (2, prose(1, 40) + " end", "en", "s", 7, "r", "k", 1, "s", "z", "p", "q", "f"), (3, "new " + prose(1, 40), "en", "s", 7, "r", "k", 1, "s", "z", "p", "q", "f")]
    out = substrings.deduplicated(make(ODD, rows))
    assert out.columns == make(ODD, rows).columns
    assert sorted((r["doc_id"], r["text"], r["n_chars"], r["rid"], r["places"]) for r in out.collect()) == [(1, line, 7, "r", "q"), (2, "end", 3, "r", "q"), (3, "new", 3, "r", "q")]


def test_empty(make):
    assert substrings.substring_digests(make(DOCS, [])).count() == 0


def test_any_column_name_passes_through(make, prose, doc_rows):
    frame = make(DOCS, doc_rows([prose(1, 40) + " end", prose(1, 40), prose(2, 9)]))
    names = ("n_removed", "n_words", "kept", "row", "rid", "z", "hint", "places", "part", "a.b")
    out = substrings.deduplicated(frame.withColumns({n: frame["lang"] for n in names}))
    assert out.columns == [*frame.columns, *names]
    assert sorted((r["text"], r["n_removed"], r["a.b"]) for r in out.collect()) == sorted([("end", "en", "en"), ("", "en", "en"), (prose(2, 9), "en", "en")])


def test_many_small_ranges_agree(make, prose, doc_rows, monkeypatch, spark):
    """The number of ranges follows the text, not the cluster's settings."""
    rows = doc_rows(cases(prose))
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    monkeypatch.setattr(substrings, "RANGE_BYTES", 2000)
    assert substrings.ranges_for(make(DOCS, rows)) > 20
    assert digests(make(DOCS, rows)) == brute(rows)
