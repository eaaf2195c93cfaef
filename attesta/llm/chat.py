"""Chat formatting: a fingerprint of the nested field paths picks the mapping to canonical turns.

A record is a JSON text of any layout. Its fingerprint is the SHA-256 of its field paths, without types and values; a
table of declared layouts says, for each known fingerprint, where roles and texts are. Turns are then written with
``<|im_start|>role\\ntext<|im_end|>\\n``. A text cannot break out: ``<``, any number of backslashes and ``|`` get one
backslash more, which reading takes away again. Roles escape ``%``, ``<`` and line feeds the way URLs do.

Everything is a Column expression. A conversation is one value of the result, so its turns meet in one row.

Defined cases: null text is empty; null role is empty; an unknown layout, broken JSON or null record gives a null layout
and no turns, and so does a given JSON text that Spark's parser refuses for its size (a variant of more than 128 MiB, a
string of more than 20 million characters). The query has no such bound: its records are columns, the fingerprint is taken
from their fields with the texts emptied, and a record without a layout is an error. Repeated turns are kept, ordered by turn, role, text; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "array<struct<role:string,text:string>>"
# fixed values: control strings of the template
START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns: a list of objects, or one field per role in speaking order."""

    name: str
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, str], ...] = ()

    def shape(self) -> str:
        """The field paths as ``schema_of_variant`` spells them, names in order, leaf types left out."""
        if self.turns:
            return f"OBJECT<{self.turns}: ARRAY<OBJECT<{', '.join(sorted([self.role, self.text]))}>>>"
        return f"OBJECT<{', '.join(sorted(path for _, path in self.fields))}>"

    def fingerprint(self) -> str:
        return hashlib.sha256(self.shape().encode()).hexdigest()

    def canonical(self, value: Column) -> Column:
        if self.turns:
            listed = F.variant_get(value, f"$.{self.turns}", f"array<struct<{self.role}:string,{self.text}:string>>")
            return F.transform(listed, lambda t: F.struct(F.coalesce(t[self.role], F.lit("")).alias("role"), F.coalesce(t[self.text], F.lit("")).alias("text")))
        said = [
            F.struct(F.lit(role).alias("role"), F.coalesce(F.variant_get(value, f"$.{path}", "string"), F.lit("")).alias("text"))
            for role, path in self.fields
        ]
        return F.array(*said)


    def mapped(self) -> Column:
        """The turns of a record whose fields are columns."""
        if self.turns:
            return F.transform(self.turns, lambda t: F.struct(t[self.role].alias("role"), t[self.text].alias("text")))
        return F.array(*[F.struct(F.lit(role).alias("role"), F.col(path).alias("text")) for role, path in self.fields])


# fixed values: layouts that public instruction and chat sets use
LAYOUTS = (
    Layout("messages", "messages", "role", "content"),
    Layout("conversations", "conversations", "from", "value"),
    Layout("prompt", fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("question", fields=(("user", "question"), ("assistant", "answer"))),
    Layout("instruction", fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("system_instruction", fields=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
)
# fixed values: names of roles in those sets
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(value: Column) -> Column:
    """SHA-256 of the nested field paths of a variant."""
    return F.sha2(F.regexp_replace(F.schema_of_variant(value), r": (?!ARRAY|OBJECT)[A-Z]+(\(\d+,\s*\d+\))?", ""), 256)


def canonical(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``fingerprint``, ``layout`` and ``turns`` (role and text, in order) to rows with a JSON text."""
    value = F.try_parse_json(F.col(record))
    print_of = F.when(value.isNotNull(), fingerprint(value))
    known = records.withColumn("fingerprint", print_of)
    layout = F.lit(None).cast("string")
    turns = F.lit(None).cast(TURN)
    for x in layouts:
        match = F.col("fingerprint") == x.fingerprint()
        layout = F.when(match, x.name).otherwise(layout)
        turns = F.when(match, x.canonical(value)).otherwise(turns)
    names = F.create_map(*[F.lit(v) for pair in ROLES.items() for v in pair])
    named = F.transform(F.coalesce(turns, F.array().cast(TURN)), lambda t: F.struct(F.coalesce(names[t["role"]], t["role"]).alias("role"), t["text"].alias("text")))
    return known.withColumn("layout", layout).withColumn("turns", F.when(F.col("layout") == "conversations", named).otherwise(F.coalesce(turns, F.array().cast(TURN))))


def _turns_as(turns: Column, layout: Layout, role: str, text: str, value: Callable[[Column], Column] = lambda c: c) -> Column:
    """A list of turns in the names of a layout."""
    return F.transform(turns, lambda t: F.struct(value(t[role]).alias(layout.role), value(t[text]).alias(layout.text)))


def emptied(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The record of a row as JSON with every text emptied: its own fields, as far as they are there, and no others.

    A record lies in columns, one per top-level field; a field that is null is not part of it.
    """
    blank = lambda value: F.when(value.isNotNull(), F.lit(""))
    fields = {}
    for x in layouts:
        for path in [x.turns] if x.turns else [path for _, path in x.fields]:
            if path not in records.columns or path in fields:
                continue
            if x.turns:
                fields[path] = F.array_distinct(_turns_as(F.col(path), x, x.role, x.text, blank)).alias(path)
            else:
                fields[path] = blank(F.col(path)).alias(path)
    return F.to_json(F.struct(*fields.values()))


def mapped(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds what ``canonical`` adds to rows whose record is columns, one per top-level field.

    The fingerprint is taken from the record's own nested fields; its texts never pass the JSON parser, so their length is not
    bounded by it. A record without a known layout is an error.
    """
    known = records.withColumn("fingerprint", fingerprint(F.parse_json(emptied(records, layouts))))
    layout, turns = F.raise_error(F.lit("a record has no known layout")).cast("string"), F.lit(None).cast(TURN)
    for x in layouts:
        if {x.turns} - {None} | {path for _, path in x.fields} <= set(records.columns):
            match = F.col("fingerprint") == x.fingerprint()
            layout, turns = F.when(match, x.name).otherwise(layout), F.when(match, x.mapped()).otherwise(turns)
    return known.withColumn("layout", layout).withColumn("turns", turns)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def formatted(turned: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds ``segments`` (text, loss) and ``formatted``, their concatenation; ``loss`` marks what is learnt from."""

    def cut(t: Column) -> Column:
        head = F.concat(F.lit(START), _role_out(t["role"]), F.lit("\n"))
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(seg(head, F.lit(False)), seg(escape(t["text"]), t["role"].isin(*learn)), seg(F.lit(END + "\n"), F.lit(False)))

    cuts = turned.withColumn("segments", F.flatten(F.transform("turns", cut)))
    return cuts.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parsed(text: Column) -> Column:
    """The turns of a formatted text."""
    body = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda p: p.startswith(START))
    role_end = lambda p: F.instr(p, "\n")
    return F.transform(
        body,
        lambda p: F.struct(
            _role_in(F.substring(p, F.lit(len(START) + 1), role_end(p) - len(START) - 1)).alias("role"),
            unescape(F.substring(p, role_end(p) + 1, F.length(p))).alias("text"),
        ),
    )


def _said(conversations: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Conversations with their turns in order; whether one is a lone question and answer, or that after a system text."""
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    lists = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("_said"))
    roles = F.transform("_said", lambda t: t["role"])
    asked = F.array(F.lit("user"), F.lit("assistant"))
    return lists, roles == asked, roles == F.concat(F.array(F.lit("system")), asked)


def _text(i: int) -> Column:
    return F.get("_said", F.lit(i))["text"]


def layout_of(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with their turns in order, and the layout that each comes in.

    A lone question and answer comes in one of the four layouts with a field per speaker, by its number; one with a system text
    first as an instruction; all others in one of the two message lists. So every layout is met.
    """
    lists, lone, led = _said(conversations)
    number = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(4))
    pairs = F.get(F.array(*[F.lit(n) for n in ("prompt", "prompt_response", "question", "instruction")]), number.cast("int"))
    lines = F.when(number % 2 == 0, "messages").otherwise("conversations")
    return lists, F.when(lone, pairs).when(led, "system_instruction").otherwise(lines)


def columns_of(conversations: DataFrame) -> DataFrame:
    """One record per conversation of ``(conv_id, turn, role, text)``, as columns: one per field that any layout has."""
    lists, layout = layout_of(conversations)
    named = lists.withColumn("_layout", layout)
    fields: dict[str, Column] = {}
    for x in LAYOUTS:
        mine = F.col("_layout") == x.name
        if x.turns:
            fields[x.turns] = F.when(mine, _turns_as(F.col("_said"), x, "role", "text"))
        for i, (_, path) in enumerate(x.fields):
            fields[path] = F.when(mine, _text(i)).otherwise(fields[path]) if path in fields else F.when(mine, _text(i))
    return named.select("conv_id", *[value.alias(path) for path, value in fields.items()])


def records_of(conversations: DataFrame) -> DataFrame:
    """The same records as JSON texts."""
    records = columns_of(conversations)
    return records.select("conv_id", F.to_json(F.struct(*[c for c in records.columns if c != "conv_id"])).alias("record"))


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Formats every conversation and reports what reading the output gives back."""
    out = formatted(mapped(columns_of(conversations)))
    back = out.withColumn("_turns", parsed(F.col("formatted")))
    whole = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return back.select("*", learnt.alias("_learnt")).select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("_learnt").cast("long").alias("loss_chars"),
        F.sha2("_learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )
