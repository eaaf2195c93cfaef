"""The Python helpers of the library: text formats Spark cannot read, per Arrow batch.

Each turns one text into JSON; what the document means is left to Spark.
"""

from __future__ import annotations

import ast
import json
import re
import sys
import tomllib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

# the helpers travel with the task, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

try:
    import yaml
except ImportError:  # pragma: no cover - the YAML jobs then refuse to start
    yaml = None

#: What a hostile or broken text may raise; each costs its own row only. Values such as dates out of range are ValueErrors.
BROKEN = (ValueError, TypeError, LookupError, AttributeError, ArithmeticError, RecursionError, MemoryError)
#: A document may not unfold, through aliases, to more than this many nodes per character (and ``LEAST_NODES``).
NODES_PER_CHARACTER = 2
LEAST_NODES = 1_000


def _toml(text: str | None) -> str | None:
    try:
        return json.dumps(tomllib.loads(text or ""), default=str)
    except BROKEN:
        return None


def _unfolds_within(value: object, most: int) -> bool:
    """Whether the value, aliases written out, has at most ``most`` nodes; stops counting there."""
    open_nodes, seen = [value], 0
    while open_nodes:
        node = open_nodes.pop()
        seen += 1
        if seen > most:
            return False
        if isinstance(node, dict):
            open_nodes.extend(node.values())
        elif isinstance(node, list | tuple | set):
            open_nodes.extend(node)
    return True


def _built(loader: yaml.SafeLoader, scalars: dict[str, object]) -> object:
    """The value of a document, from the parser's events alone: no tree of nodes comes in between.

    Anchors, aliases, tags, merged and unhashable keys are refused, as are further documents. ``scalars`` has what plain
    scalars stand for, found by the loader's own rules once per distinct text.
    """
    get = loader.get_event

    def plain(text: str) -> object:
        tag = loader.resolve(yaml.ScalarNode, text, (True, False))
        scalars[text] = value = text if tag == loader.DEFAULT_SCALAR_TAG else loader.construct_object(yaml.ScalarNode(tag, text))
        return value

    def build(event: yaml.Event) -> object:
        kind = type(event)
        if event.anchor is not None or kind is yaml.AliasEvent or event.tag is not None:
            raise ValueError("more than plain maps, lists and scalars")
        if kind is yaml.ScalarEvent:
            text = event.value
            return text if not event.implicit[0] else scalars[text] if text in scalars else plain(text)
        if kind is yaml.SequenceStartEvent:
            items = []
            while type(event := get()) is not yaml.SequenceEndEvent:
                items.append(build(event))
            return items
        members = {}
        while type(event := get()) is not yaml.MappingEndEvent:
            key = build(event)
            members[key] = build(get())
        return members

    get()
    if type(get()) is not yaml.DocumentStartEvent:
        return None
    value = build(get())
    get()
    if type(get()) is not yaml.StreamEndEvent:
        raise ValueError("more than one document")
    return value


def _yaml(text: str | None, scalars: dict[str, object]) -> str | None:
    text = text or ""
    reader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    try:
        try:
            loaded = _built(reader(text), scalars)
        except (yaml.YAMLError, *BROKEN):
            # without aliases no node is there twice, so only these can unfold to more than their text
            loaded = yaml.load(text, Loader=reader)
            if not _unfolds_within(loaded, LEAST_NODES + NODES_PER_CHARACTER * len(text)):
                return None
        return json.dumps(loaded, default=str) if isinstance(loaded, dict) else None
    except (yaml.YAMLError, *BROKEN):
        return None


def _names(path: ast.expr) -> str:
    return ast.unparse(path)


def _function(node: ast.FunctionDef | ast.AsyncFunctionDef) -> dict:
    params = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
    params = [p for p in params if p.arg not in ("self", "cls")]
    return {
        "kind": "function",
        "name": node.name,
        "line": node.lineno,
        "last": node.end_lineno,
        "returns": node.returns is not None,
        "params": len(params),
        "annotated": sum(p.annotation is not None for p in params),
        "doc": ast.get_docstring(node, clean=False) is not None,
        "decorators": "|".join(_names(d) for d in node.decorator_list),
    }


def _python(text: str | None) -> str:
    """Functions, classes, imports and constants of a source text as JSON rows."""
    try:
        return json.dumps({"errors": False, "rows": _symbols(ast.parse(text or ""))})
    except (SyntaxError, *BROKEN):
        return json.dumps({"errors": True, "rows": []})


def _symbols(tree: ast.Module) -> list[dict]:
    rows = []
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            rows.append(_function(node))
        elif isinstance(node, ast.ClassDef):
            doc = ast.get_docstring(node, clean=False) is not None
            rows.append({"kind": "class", "name": node.name, "line": node.lineno, "last": node.end_lineno, "doc": doc})
        elif isinstance(node, ast.Import):
            rows += [{"kind": "import", "name": a.name, "line": node.lineno, "level": 0} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            rows.append({"kind": "import", "name": node.module or "", "line": node.lineno, "level": node.level})
    for node in tree.body:
        if isinstance(node, ast.Assign):
            for target in node.targets:
                if isinstance(target, ast.Name):
                    rows.append({"kind": "constant", "name": target.id, "line": node.lineno})
    return rows


# ---- JavaScript and TypeScript ---------------------------------------------------------

#: One token of script code. A quote that its line does not close is a character like any other (it stands in markup text).
_SCRIPT = re.compile(
    r"""(?P<space>[ \t\r\n\f\v\ufeff]+|//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z))
      |(?P<string>'(?:\\.|\\\n|[^'\\\n])*'|"(?:\\.|\\\n|[^"\\\n])*")
      |(?P<word>[A-Za-z_$\u0080-\U0010ffff#@][\w$\u0080-\U0010ffff]*)
      |(?P<number>\d[\w.]*)
      |(?P<mark>=>|\.\.\.|\?\.|.)""",
    re.VERBOSE | re.DOTALL,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.DOTALL)
#: Words after which a slash begins a pattern, not a division.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new instanceof do else yield await".split())
_TESTS = frozenset(("describe", "it", "test", "expect"))
#: Words that no type or parameter list goes past.
_STATEMENTS = frozenset("const let var function class import export return if for while switch try".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")


def script_tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, place) of the code of a script: words, strings, numbers and marks; comments and the texts of strings,
    templates and patterns are passed over, the code inside ``${}`` is not. One pass, linear in the text."""
    out: list[tuple[str, str, int]] = []
    templates: list[int] = []  # open braces inside each template that code was entered from
    at, n = 0, len(text)

    def template(at: int) -> int:
        """From inside a template to its end or to the code of the next ``${}``."""
        at = _TEMPLATE.match(text, at).end()
        if text.startswith("${", at):
            templates.append(0)
            out.append(("mark", "(", at))
            return at + 2
        return at + 1

    while at < n:
        c = text[at]
        if c == "`":
            out.append(("template", "", at))
            at = template(at + 1)
            continue
        if c == "/" and (not out or out[-1][0] == "mark" and out[-1][1] not in (")", "]", "}") or out[-1][0] == "word" and out[-1][1] in _BEFORE_REGEX):
            m = _REGEX.match(text, at)
            if m:
                out.append(("pattern", "", at))
                at = m.end()
                continue
        if c == "}" and templates and not templates[-1]:
            templates.pop()
            out.append(("mark", ")", at))
            at = template(at + 1)
            continue
        if templates and c in "{}":
            templates[-1] += 1 if c == "{" else -1
        m = _SCRIPT.match(text, at)
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0], at))
        at = m.end()
    return out


def _partners(tokens: list[tuple[str, str, int]]) -> list[int]:
    """For each opening bracket the place of the token that closes it (the last token where none does)."""
    partner = [len(tokens) - 1] * len(tokens)
    open_at: list[int] = []
    for i, (kind, text, _) in enumerate(tokens):
        if kind == "mark" and text in _OPEN:
            open_at.append(i)
        elif kind == "mark" and text in _CLOSE and any(_OPEN[tokens[k][1]] == text for k in open_at[-3:]):
            while _OPEN[tokens[open_at[-1]][1]] != text:
                open_at.pop()
            partner[open_at.pop()] = i
    return partner


def script_symbols(text: str) -> dict:
    """Functions, classes, imports, exports and test calls of a script, with their lines."""
    tokens = script_tokens(text)
    partner = _partners(tokens)
    ends = list(accumulate(len(x) + 1 for x in text.split("\n")))
    n = len(tokens)
    rows: list[dict] = []
    exported: set[str] = set()
    default = tests = False

    def is_(i: int, value: str) -> bool:
        return 0 <= i < n and tokens[i][1] == value and tokens[i][0] in ("word", "mark")

    def word(i: int) -> str | None:
        return tokens[i][1] if 0 <= i < n and tokens[i][0] == "word" else None

    def line(i: int) -> int:
        return bisect_right(ends, tokens[min(i, n - 1)][2]) + 1

    def past_type(i: int, stops: tuple[str, ...]) -> int:
        """Over a type, to the first of ``stops`` outside its brackets."""
        deep = 0
        while i < n and (deep or not any(is_(i, s) for s in stops)):
            if tokens[i][0] == "mark" and tokens[i][1] in _OPEN:
                i = partner[i]
            elif is_(i, "<"):
                deep += 1
            elif is_(i, ">") and deep:
                deep -= 1
            elif is_(i, ";") or is_(i, "}") or word(i) in _STATEMENTS:
                return i
            i += 1
        return i

    def body_end(i: int) -> int:
        """Where a function whose parameters begin at or after ``i`` ends."""
        i = past_type(i, ("(",))
        i = past_type(partner[i] + 1, ("{", ";")) if is_(i, "(") else i
        return partner[i] if is_(i, "{") else min(i, n - 1)

    def put(kind: str, name: str, form: str, first: int, last: int, base: str | None = None) -> None:
        rows.append({"kind": kind, "name": name, "form": form, "line": line(first), "last": line(last), "extends": base})

    def text_of(i: int) -> str | None:
        return tokens[i][1][1:-1] if 0 <= i < n and tokens[i][0] == "string" else None

    for i, (kind, value, _) in enumerate(tokens):
        if kind != "word" or is_(i - 1, ".") or is_(i - 1, "?."):
            continue
        if value in _TESTS and is_(i + 1, "(") and not is_(i - 1, "function"):
            tests = True
        elif value == "function":
            at = i + 2 if is_(i + 1, "*") else i + 1
            start = i - 1 if is_(i - 1, "async") else i
            if word(at) and not (is_(start - 1, "=") or is_(start - 1, "(") or is_(start - 1, ",") or is_(start - 1, ":") or is_(start - 1, "return")):
                put("function", word(at), "declaration", start, body_end(at))
        elif value == "class" and word(i + 1) and word(i + 1) != "extends" and not is_(i - 1, "="):
            at, base = i + 2, None
            at = past_type(at, ("extends", "{", "implements"))
            if is_(at, "extends"):
                at += 1
                base = word(at)
                while base and is_(at + 1, ".") and word(at + 2):
                    base, at = f"{base}.{word(at + 2)}", at + 2
            at = past_type(at, ("{",))
            put("class", word(i + 1), "class", i, partner[at] if is_(at, "{") else at, base)
        elif value in ("const", "let", "var") and word(i + 1):
            at = i + 2
            if is_(at, ":"):
                at = past_type(at + 1, ("=",))
            if not is_(at, "="):
                continue
            at += 1
            if is_(at, "async"):
                at += 1
            if is_(at, "function"):
                put("function", word(i + 1), "expression", i, body_end(at + 1))
                continue
            if is_(at, "<"):
                at = past_type(at, ("(",))
            if is_(at, "("):
                at = partner[at] + 1
                if is_(at, ":"):
                    at = past_type(at + 1, ("=>",))
            elif word(at):
                at += 1
            if is_(at, "=>"):
                last = partner[at + 1] if is_(at + 1, "{") or is_(at + 1, "(") else at + 1
                put("function", word(i + 1), "arrow", i, last)
        elif value == "import" and not is_(i + 1, "(") and not is_(i + 1, "."):
            at = i + 1
            while at < n and tokens[at][0] != "string" and not is_(at, ";") and at - i < 20_000 and not (at > i + 1 and is_(at, "import")):
                at = partner[at] + 1 if is_(at, "{") else at + 1
            source = text_of(at)
            if source is not None and (at == i + 1 or is_(at - 1, "from")):
                put("import", source, "import", i, at)
        elif value == "require" and is_(i + 1, "(") and text_of(i + 2) is not None and is_(i + 3, ")"):
            put("import", text_of(i + 2), "require", i, i + 3)
        elif value == "export":
            at = i + 1
            if is_(at, "default"):
                default, at = True, at + 1
            while word(at) in ("async", "abstract", "declare"):
                at += 1
            if is_(at, "function"):
                at = at + 2 if is_(at + 1, "*") else at + 1
                if word(at):
                    exported.add(word(at))
            elif word(at) in ("class", "const", "let", "var", "interface", "type", "enum") and word(at + 1):
                exported.add(word(at + 1))
            elif is_(at, "{"):
                for k in range(at + 1, partner[at]):
                    if word(k) and (is_(k + 1, ",") or is_(k + 1, "}") or is_(k + 1, "as")) and not is_(k - 1, "as"):
                        exported.add(word(k))
    seen: set[tuple[str, str]] = set()
    kept = []
    for row in sorted(rows, key=lambda r: ("declaration", "arrow", "expression", "class", "import", "require").index(r["form"])):
        if row["kind"] == "import" or (row["kind"], row["name"]) not in seen:
            seen.add((row["kind"], row["name"]))
            kept.append(row | {"exported": row["kind"] != "import" and row["name"] in exported})
    return {"tests": tests, "default": default, "rows": kept}


def _script(text: str | None) -> str:
    try:
        return json.dumps(script_symbols(text or ""))
    except BROKEN:
        return json.dumps({"tests": False, "default": False, "rows": []})


def once(udf):
    """The helper as one that runs only where it stands.

    A filter on what a helper gives is else planned as a second run of it, in front of a repartition even, where one task
    may hold the whole table. Spark moves no filter past a column that it takes for nondeterministic.
    """
    return udf.asNondeterministic()


def _each_once(texts: pd.Series, parse: Callable[[str | None], str | None]) -> pd.Series:
    """What each text gives; copies inside a batch are parsed once."""
    known: dict[str | None, str | None] = {}
    for text in texts:
        if text not in known:
            known[text] = parse(text)
    return pd.Series([known[text] for text in texts], dtype=object)


@F.pandas_udf(StringType())
def _script_udf(texts: pd.Series) -> pd.Series:
    return _each_once(texts, _script)


@F.pandas_udf(StringType())
def _toml_udf(texts: pd.Series) -> pd.Series:
    return _each_once(texts, _toml)


@F.pandas_udf(StringType())
def _yaml_udf(texts: pd.Series) -> pd.Series:
    return _each_once(texts, partial(_yaml, scalars={}))


@F.pandas_udf(StringType())
def _python_udf(texts: pd.Series) -> pd.Series:
    return _each_once(texts, _python)


script_to_json = once(_script_udf)
toml_to_json = once(_toml_udf)
python_to_json = once(_python_udf)


def yaml_to_json(text: Column | str) -> Column:
    if yaml is None:
        raise ImportError("YAML files cannot be read without PyYAML")
    return once(_yaml_udf)(text)


@F.pandas_udf(ArrayType(BooleanType()))
def first_fit(sizes: pd.Series, sections: pd.Series, budget: pd.Series, start: pd.Series, section_cost: pd.Series) -> pd.Series:
    """For each list of sizes, which fit in order; a section costs more at its first item, misfits are skipped."""

    def fold(row: tuple) -> list[bool]:
        items, names, most, used, extra = row
        opened: set[str] = set()
        flags = []
        for size, name in zip(items, names, strict=True):
            after = used + size + (0 if name in opened else extra)
            flags.append(bool(after <= most))
            if after <= most:
                used = after
                opened.add(name)
        return flags

    return pd.Series([fold(row) for row in zip(sizes, sections, budget, start, section_cost, strict=True)])


HIT = "no int, start int, stop int, line int, match string, value string, context string, fenced boolean"
HIT_TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
#: Texts taken out of a batch at once, and characters of hits after which they are given away.
TEXTS_AT_ONCE = 64
HIT_CHARACTERS = 1_000_000
FENCE = re.compile(r"\s*```", re.ASCII)


def _places(low: str, literal: str) -> list[int]:
    out, at = [], low.find(literal)
    while at >= 0:
        out.append(at)
        at = low.find(literal, at + 1)
    return out


def lowered(text: str) -> str:
    """ASCII letters in lower case, every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


class Literals:
    """What a pattern's matches must hold: literals they start with, or literals anywhere in them; nothing if none is known."""

    def __init__(self, given: str | None) -> None:
        words = (given or "").split()
        self.starts = [w[1:] for w in words if w.startswith("^")]
        self.within = [w for w in words if not w.startswith("^")]

    def matches(self, pattern: re.Pattern, text: str, low: str, seen: dict[str, list[int]]) -> Iterator[re.Match]:
        """The matches ``finditer`` gives, found from the places of the literals."""
        if self.within or not self.starts:
            if not self.within or any(w in low for w in (*self.within, *self.starts)):
                yield from pattern.finditer(text)
            return
        places: list[int] = []
        for literal in self.starts:
            if literal not in seen:
                seen[literal] = _places(low, literal)
            places += seen[literal]
        end = 0
        for at in sorted(places) if len(self.starts) > 1 else places:
            if at >= end and (m := pattern.match(text, at)):
                yield m
                end = max(m.end(), at + 1)


def text_hits(patterns: tuple[tuple[str, int, str | None], ...]) -> Callable[[str | None], Iterator[tuple]]:
    """What finds the hits of one text, pattern by pattern; see ``pattern_hits``."""
    compiled = [(no, re.compile(p, re.ASCII), group, Literals(given)) for no, (p, group, given) in enumerate(patterns)]

    def hits(text: str | None) -> Iterator[tuple]:
        ends, fenced, lines = None, [], []
        if not text:
            return
        low, seen = lowered(text), {}
        for no, pattern, group, literals in compiled:
            for m in literals.matches(pattern, text, low, seen):
                if ends is None:
                    lines = text.split("\n")
                    ends = list(accumulate(len(x) + 1 for x in lines))
                    inside = False
                    for x in lines:
                        mark = FENCE.match(x) is not None
                        fenced.append(inside or mark)
                        inside ^= mark
                at = bisect_right(ends, m.start())
                yield no, m.start(), m.end(), at + 1, m[0], m[group], lines[at], fenced[at]

    return hits


def pattern_hits(patterns: tuple[tuple[str, int, str | None], ...], text_at: int):
    """Arrow helper for ``mapInArrow``: one row per match of the patterns (regex, group, literals), in pattern order per text.

    The column at ``text_at`` is the text; it stays behind, the other columns come in front of the hit. The literals of all
    patterns are looked up once per text, and a pattern is tried only where they stand. A hit has its place, its line, the text
    of that line and whether the line stands in a fenced block; line ends and fences are found once per text. Hits leave as soon
    as they hold ``HIT_CHARACTERS``: many in one long line would each keep a copy of it.
    """
    hits = text_hits(patterns)
    fields = [f.split()[0] for f in HIT.split(", ")]

    def given(batch: pa.RecordBatch, places: list[int], found: list[tuple]) -> pa.RecordBatch:
        at = pa.array(places, pa.int64())
        rest = [i for i in range(batch.num_columns) if i != text_at]
        values = [pa.array(list(v), t) for v, t in zip(zip(*found, strict=True), HIT_TYPES, strict=True)]
        return pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in rest], *values], names=[*[batch.schema.names[i] for i in rest], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, found, held = [], [], 0
            for begin in range(0, batch.num_rows, TEXTS_AT_ONCE):
                for place, text in enumerate(batch.column(text_at).slice(begin, TEXTS_AT_ONCE).to_pylist(), begin):
                    for hit in hits(text):
                        places.append(place)
                        found.append(hit)
                        held += 100 + len(hit[4]) + len(hit[6])
                        if held >= HIT_CHARACTERS:
                            yield given(batch, places, found)
                            places, found, held = [], [], 0
            if found:
                yield given(batch, places, found)

    return run


def hit_values(severe: tuple, known: tuple, loose: tuple) -> Callable[[Column | str], Column]:
    """A column per text, ``severe, known, loose``: whether a pattern of the first kind hits outside fenced blocks, and the distinct
    values of the others' hits. A span counts once: known patterns before loose ones, in their order.

    The column has no copy of a text or line, and rows need not leave their place to meet their hits again.
    """
    marks, secrets, first_loose = text_hits(severe), text_hits((*known, *loose)), len(known)

    def values(text: str | None) -> tuple[bool, list[str], list[str]]:
        spans: dict[tuple[int, int], tuple[int, str]] = {}
        for no, start, stop, _, _, value, _, _ in secrets(text):
            spans.setdefault((start, stop), (no, value))
        parts = [list(dict.fromkeys(v for no, v in spans.values() if v is not None and (no >= first_loose) is side)) for side in (False, True)]
        return any(not hit[7] for hit in marks(text)), *parts

    def run(texts: pd.Series) -> pd.DataFrame:
        seen = {text: values(text) for text in dict.fromkeys(texts)}  # copies inside a batch are searched once
        return pd.DataFrame([seen[text] for text in texts], columns=["severe", "known", "loose"])

    return once(F.pandas_udf(run, StructType.fromDDL("severe boolean, known array<string>, loose array<string>")))
