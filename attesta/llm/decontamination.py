"""Benchmark decontamination by pigeonhole edit matching.

Both sides are reduced to lower-case letters and digits with single blanks. An item of ``n`` characters may be met with
``k = n * RATE`` edits. It is split into ``k + 1`` pieces; ``k`` edits leave one piece untouched, so every match holds an
exact piece hit at a known place. Texts are scanned once for all pieces of a block of items (Aho-Corasick). Before a
hit is verified its neighbours are asked: of two pieces joined, some pair holds at most one edit. The survivor is
verified with Myers' bit-parallel distance over the span that the item can cover around the hit.

Items are the stated query set. They are taken in blocks of at most ``BLOCK`` characters, each of which is sent to the
tasks as one bounded value and meets all texts; nothing of the documents leaves its task but matches.

Defined cases: items that reduce to fewer than ``SHORT`` characters have no budget and match where they stand whole between
word borders; null and
empty texts and items match nothing; equal items count one by one under their ids; rows are judged one by one; other
columns pass through; empty tables give empty results.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import by_batch, packed_row

RATE = 0.1
SHORT = 24
BLOCK = 4_000_000
WORDS = re.compile(r"[^\W_]+")


def reduced(text: str | None) -> str:
    return " ".join(WORDS.findall(text.lower())) if text else ""


def budget(n: int, rate: float = RATE) -> int:
    return int(n * rate)


def pieces(text: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of about equal length, with their places."""
    n, parts = len(text), errors + 1
    edges = [n * i // parts for i in range(parts + 1)]
    return [(a, text[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def myers(pattern: str, text: str, most: int) -> tuple[int, int]:
    """(least edits, end) of ``pattern`` against any part of ``text``; ``most + 1`` if none is within ``most``."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    pv, mv, score, best, end = full, 0, m, most + 1, -1
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += bool(ph & top) - bool(mh & top)
        if score < best:
            best, end = score, j + 1
            if not best:
                break
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
    return best, end


def one_edit(piece: str, text: str) -> bool:
    """Whether ``piece`` and some start of ``text`` are within one edit."""
    n = len(piece)
    i = 0
    while i < n and i < len(text) and piece[i] == text[i]:
        i += 1
    if i >= n - 1:
        return True
    return text.startswith(piece[i + 1 :], i + 1) or text.startswith(piece[i + 1 :], i) or text.startswith(piece[i:], i + 1)


class Items:
    """Automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [(i, t, budget(len(t), rate) if len(t) >= SHORT else 0) for i, t in items if t]
        places: dict[str, list[tuple[int, int]]] = {}
        self.cut = [pieces(t, k) for _, t, k in self.items]
        for no, cut in enumerate(self.cut):
            for nth, (_, piece) in enumerate(cut):
                places.setdefault(piece, []).append((no, nth))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.some = bool(places)

    def _neighbour(self, no: int, nth: int, line: str, begin: int) -> bool:
        """Whether the piece paired with the hit is there with one edit at most; a last piece without a pair passes."""
        cut = self.cut[no]
        pair = nth ^ 1
        if pair >= len(cut):
            return True
        other = cut[pair][1]
        size, half = len(other), len(other) // 2
        if pair > nth:
            a = begin + len(cut[nth][1])
            near, far = line.startswith(other[:half], a), line.find(other[half:], a + half - 1, a + size + 1) >= 0
            return (near or far) and one_edit(other, line[a : a + size + 1])
        near, far = line.startswith(other[half:], begin - size + half), line.find(other[:half], max(0, begin - size - 1), begin - size + half + 1) >= 0
        return (near or far) and one_edit(other[::-1], line[max(0, begin - size - 1) : begin][::-1])

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item, edits, budget, begin, end) of the best match of each item, places in the reduced text."""
        line = reduced(text)
        best: dict[int, tuple[int, int, int, int]] = {}
        tried: dict[int, int] = {}
        for last, (size, where) in self.automaton.iter(line) if self.some else ():
            for no, nth in where:
                item, pattern, most = self.items[no]
                begin = last - size + 1
                if size < SHORT and not most:
                    if size == len(pattern) and line[max(0, begin - 1) : begin] in ("", " ") and line[last + 1 : last + 2] in ("", " "):
                        best.setdefault(item, (0, 0, begin, last + 1))
                    continue
                if most and not self._neighbour(no, nth, line, begin):
                    continue
                start = begin - self.cut[no][nth][0]
                if start < tried.get(no, start):
                    continue  # inside the span that was verified for this item; before the first, any start counts
                a, b = max(0, start - most), start + len(pattern) + most
                exact = line.startswith(pattern, start) if start >= 0 else False
                edits, end = (0, start + len(pattern) - a) if exact else myers(pattern, line[a:b], most)
                if edits <= most:
                    tried[no] = start + most
                    if item not in best or edits < best[item][0]:
                        best[item] = (edits, most, max(0, a + end - len(pattern)), a + end)
        return [(i, *found) for i, found in best.items()]


def blocks(items: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """Reduced items ``(item_id, text)`` in parts of about ``size`` characters, one at a time."""
    known = items.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // size))
    for part in range(parts):
        rows = known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        yield sorted((r["item_id"], reduced(r["text"])) for r in rows)


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, size: int = BLOCK) -> DataFrame:
    """``(doc_id, item_id, edits, budget, begin, end)``: the best match of an item in a document row."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in blocks(items, size):
        sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block, rate))

        def work(batch: pa.RecordBatch, sent=sent) -> Iterator[dict[str, list]]:
            built = _built(sent)
            found = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for m in built.matches(t)]
            yield {name: [f[k] for f in found] for k, name in enumerate(("doc_id", "item_id", "edits", "budget", "begin", "end"))}

        part = by_batch(narrow, "doc_id long, item_id long, edits int, budget int, begin int, end int", work)
        out = part if out is None else out.unionByName(part)
    return out


_BUILT: dict[str, Items] = {}


def _built(sent) -> Items:
    """The automaton of a broadcast block, built once per worker; only the last one is kept."""
    key, items, rate = sent.value
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Items(items, rate)
    return _BUILT[key]


def decontaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, size: int = BLOCK) -> DataFrame:
    """The documents that match no item, rows as they are."""
    out = docs.select(packed_row(docs).alias("row"))
    schema = out.schema
    for block in blocks(items, size):
        sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block, rate))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            built = _built(sent)
            for batch in batches:
                yield batch.filter(pa.array([not built.matches(t) for t in batch.column("row").field("text").to_pylist()], type=pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out.select("row.*")
