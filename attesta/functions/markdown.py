"""Markdown structure as array expressions over the text of one file.

A file is cut into segments by one regex (a fenced block, a heading line or a
blank line that belongs to neither), so no line is shuffled to its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta import dims
from attesta.functions.base import contains_any, first_match

# a block that closes on a bare fence, or a fence that never closes
_CLOSED = r"^[ \t]*```[^\n]*\n(?:[\s\S]*?\n)??[ \t]*```[ \t\r]*$"
_OPEN = r"^[ \t]*```[\s\S]*\z"
_HEADING = r"^#{1,6}[ \t]+[^\n]+$"
DOC_SEGMENTS = rf"(?m){_CLOSED}|{_OPEN}|{_HEADING}|^[^\n]+$"
# import rules: any fence closes an open block
FENCED_BLOCK = r"(?m)^[ \t]*```[^\n]*\n(?:[\s\S]*?\n)??[ \t]*```[^\n]*$"


def heading_type(heading: Column) -> Column:
    low = F.lower(heading)
    return first_match(
        ((contains_any(low, words), F.lit(kind)) for kind, words in dims.HEADING_KEYWORDS), "unknown"
    )


def is_generic_prose(text: Column) -> Column:
    bare = F.trim(text)
    return (bare == "") | bare.rlike("|".join(dims.GENERIC_PROSE))


def is_command_like(text: Column) -> Column:
    bare = F.trim(text)
    return bare.rlike(dims.PROMPT_LINE) | bare.rlike(dims.CLI_LINE)


def is_directive(text: Column) -> Column:
    return text.rlike(dims.DIRECTIVE_LINE)


def frontmatter_block(text: Column) -> Column:
    """Raw lines between the leading dashes, empty when there is no such block."""
    return F.regexp_extract(text, r"^---[^\n]*\n([\s\S]*?)(?m:^[ \t]*---[ \t]*$)", 1)


def frontmatter(text: Column) -> Column:
    """map<string,string> of the leading block; a later key wins."""
    lines = F.filter(F.split(frontmatter_block(text), "\n"), lambda x: x.contains(":"))
    entries = F.transform(
        lines,
        lambda x: F.struct(
            F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("k"),
            F.regexp_replace(
                F.trim(F.regexp_replace(x, r"^[^:]*:", "")), "^[\"']+|[\"']+$", ""
            ).alias("v"),
        ),
    )
    last = F.filter(
        F.transform(entries, lambda e, i: F.struct(e.alias("e"), i.alias("i"))),
        lambda x: ~F.exists(
            F.slice(entries, x.i + 2, F.greatest(F.size(entries) - x.i - 1, F.lit(0))),
            lambda later: later.k == x.e.k,
        ),
    )
    return F.map_from_entries(F.transform(last, lambda x: x.e))


def body_after_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"^---[^\n]*\n[\s\S]*?(?m:^[ \t]*---[ \t]*$)\n?", "")


def strip_prompt(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"^[$> ]+", ""))
