import hashlib
import random
import zlib

from attesta.llm import runs

from .conftest import DOCS, ODD


def brute_runs(words, least=runs.LEAST):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def brute(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in found)]
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    top = (*best[0], best[0][1] * 1000 // best[0][2]) if best else (None,) * 4
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (str(doc_id), len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return " ".join(b[:n])


def cases(prose):
    r = random.Random(13)
    texts = [None, "", " \x0b\x0c\t", "one", "same " * 11, "same " * 12, "same " * 500, "a b " * 5 + "a", "a b " * 6, "a b " * 6 + "a", fibonacci(300), fibonacci(1000)]
    texts += ["a\x1cb\x85c\xa0d e " * 9, "x " * 30 + "y " + "x " * 30, " ".join("ab"[bin(i).count("1") % 2] for i in range(512))]
    for period in (1, 2, 3, 4, 5, 6, 7, 8, 9, 15, 16, 17, 31, 33, 64, 100):
        for extra in (-1, 0, 1, r.randrange(period) + period):
            unit = prose(period, period).split()
            length = max(12, 2 * period) + extra
            body = [unit[i % period] for i in range(length)]
            texts.append(" ".join([*prose(500 + period, r.randrange(40)).split(), *body, *prose(900 + period, r.randrange(40)).split()]))
    for seed in range(60):
        size = random.Random(seed).randrange(1, 4)
        texts.append(" ".join(random.Random(seed).choice("abcd"[:size]) for _ in range(random.Random(seed).randrange(5, 160))))
    nested = ("a a b " * 6 + "c ") * 5
    texts += [nested, prose(1, 40) + " " + nested + nested, prose(2, 3000), prose(3, 700) + " " + prose(3, 700) + " " + prose(3, 650)]
    return texts


def digests(df):
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return sorted((str(r["doc_id"]), *(r[c] for c in names)) for r in runs.run_digests(df).collect())


def key(row):
    return (row[0], str(row))


def test_against_brute_force(make, prose, doc_rows):
    rows = doc_rows(cases(prose))
    rows += [rows[6], rows[20], (None, "a b c d e f g " * 4, "en", "s", 1), (None, "same " * 40, "en", "s", 1), (7, fibonacci(200), "en", "s", 1)]
    assert sorted(digests(make(DOCS, rows)), key=key) == sorted((brute(d, t) for d, t, *_ in rows), key=key)


def test_small_chunks_agree(make, prose, doc_rows, monkeypatch):
    rows = doc_rows(cases(prose))
    monkeypatch.setattr(runs, "CODES_AT_ONCE", 30)
    monkeypatch.setattr(runs, "WORDS_AT_ONCE", 50)
    assert digests(make(DOCS, rows)) == sorted(brute(d, t) for d, t, *_ in rows)


def test_tiles_of_one_text_may_part(make, prose, spark):
    """Fragments of a run that every tile of a text finds alone are stitched."""
    text = prose(1, 37) + " " + " ".join([prose(2, 50)] * 9)
    parts = []
    words = text.encode().split()
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    line = [codes[w] for w in words]
    for lo, block in runs.octaves(len(line)):
        for at in range(0, len(line) - block + 1, block):
            first = max(0, at - block)
            tile = line[first : at + 2 * lo - 1 + 2 * block]
            parts += [(1, q, at - back, at + ahead) for q, back, ahead in runs.boundary(tile, at - first, lo, block)]
    random.Random(1).shuffle(parts)
    found = runs.stitched(make("rid long, period long, begin long, end long", parts))
    assert sorted((r["start"], r["length"], r["period"]) for r in found.collect()) == brute_runs(words)


def test_long_text(make, prose):
    text = prose(1, 60_000) + " " + " ".join([prose(2, 30_000)] * 3)
    (row,) = runs.run_digests(make(DOCS, [(1, text, "en", "s", 1)])).collect()
    assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == (1, 60_000, 90_000, 30_000, 3000)


def test_octaves_cover_every_period():
    for lo, block in runs.octaves(5000):
        for q in range(lo, min(2 * lo, 2500)):
            assert max(runs.LEAST - q, q) >= 2 * block - 1


def test_collapsed_texts_and_clashing_columns(make, prose):
    rows = [(1, "go " * 20 + "on", "en", "s", 7, "r", "k", 1, "s", "z", "p", "q", "f"), (2, prose(1, 9), "en", "s", 7, "r", "k", 1, "s", "z", "p", "q", "f")]
    frame = make(ODD, rows)
    frame = frame.withColumns({c: frame["rid"] for c in ("kind", "id", "z", "lo", "block", "at", "first", "tile", "out", "runs", "a.b")})
    assert sorted(map(tuple, runs.collapsed_texts(frame).collect())) == [(1, "go on", 1), (2, prose(1, 9), 0)]
    assert runs.run_digests(frame).count() == 2


def test_empty(make):
    assert runs.run_digests(make(DOCS, [])).count() == 0
