"""Commands, prerequisites, sections and instruction claims from Markdown files.

Every job is narrow: a file is cut into segments inside its own row and exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta import dims
from attesta.functions import markdown as md
from attesta.functions.commands import (
    docs_confidence,
    first_words,
    is_operational,
    normalize_docs_command,
    risk_of_docs_command,
    tags_for_docs_command,
    tags_for_imported_command,
)
from attesta.functions.scopes import instruction_source, scope_from_path
from attesta.functions.textscan import explode_hits, exploded, newline_count
from attesta.session import checkpointed

FILE_KEY = ["repo_id", "path"]
_FENCE = r"^[ \t]*```"


def _segments(files: DataFrame) -> DataFrame:
    """Blocks, headings and text lines of a file in order, headings inside fences excluded."""
    parts = F.regexp_extract_all(F.col("content"), F.lit(md.DOC_SEGMENTS), F.lit(0))
    return files.withColumn("_parts", parts)


def _heading_text(part: Column) -> Column:
    return F.trim(F.regexp_replace(part, r"^#{1,6}\s+", ""))


def _is_heading(part: Column) -> Column:
    return part.rlike(r"^#{1,6}\s+.+$") & ~part.rlike(_FENCE)


def docs_commands(docs: DataFrame) -> DataFrame:
    """Shell-fenced commands with the heading they stand under, once per file."""
    marks = _segments(docs).select(
        *FILE_KEY, F.filter("_parts", lambda p: p.rlike(_FENCE) | _is_heading(p)).alias("_marks")
    )
    # headings and blocks of one file: few next to its lines
    before = marks.select(
        "*", F.transform("_marks", lambda p: F.when(_is_heading(p), _heading_text(p))).alias("_heads")
    )
    paired = F.transform(
        "_marks",
        lambda p, i: F.struct(
            p.alias("block"),
            i.alias("no"),
            F.try_element_at(
                F.filter(F.slice("_heads", F.lit(1), i), lambda h: h.isNotNull()), F.lit(-1)
            ).alias("heading"),
        ),
    )
    rows = exploded(before, paired, "b").select(*FILE_KEY, "b").filter(
        F.col("b.block").rlike(_FENCE) & F.col("b.block").rlike(r"\n[ \t]*```[ \t\r]*$")
    )
    info = F.lower(F.trim(F.regexp_extract("b.block", r"^[ \t]*```([^\n]*)", 1)))
    lang = F.split_part(info, F.lit(" "), F.lit(1))
    body = F.slice(F.split("b.block", "\n"), F.lit(2), F.greatest(F.size(F.split("b.block", "\n")) - 2, F.lit(0)))
    lines = rows.filter(lang.isin(*dims.SHELL_LANGS)).select(
        *FILE_KEY, F.col("b.heading").alias("heading"), F.col("b.no").alias("block_no"), F.posexplode(body).alias("line_no", "raw")
    )
    command = normalize_docs_command(F.col("raw"))
    commands = lines.withColumn("command", command).filter(is_operational(F.col("command")))
    first = commands.groupBy(*FILE_KEY, "command").agg(
        F.min_by("heading", F.struct("block_no", "line_no")).alias("heading")
    )
    return first.select(
        *FILE_KEY, "command", "heading",
        first_words(F.col("command")).alias("command_name"),
        risk_of_docs_command(F.col("command")).alias("risk_class"),
        tags_for_docs_command(F.col("command")).alias("applicability"),
        docs_confidence(F.col("heading"), F.col("path")).alias("confidence"),
    )


def docs_prerequisites(docs: DataFrame) -> DataFrame:
    """Runtime requirements in prose lines outside fences, one row per pattern that matches."""
    parts = F.transform(
        F.col("_parts"), lambda p, i: F.struct(p.alias("line"), i.alias("no"))
    )
    prose = F.filter(parts, lambda s: ~s.line.rlike(_FENCE) & ~_is_heading(s.line))
    lines = _segments(docs).select(*FILE_KEY, F.explode(prose).alias("s")).filter(
        F.col("s.line").rlike("|".join(f"(?:{p})" for p in dims.DOCS_RUNTIME_PATTERNS))
    )
    found = F.array(*[
        F.struct(F.lit(i).alias("rule"), F.regexp_extract("s.line", p, 0).alias("content"))
        for i, p in enumerate(dims.DOCS_RUNTIME_PATTERNS)
    ])
    return lines.select(*FILE_KEY, F.explode(found).alias("f")).filter("f.content <> ''").select(
        *FILE_KEY, "f.rule", "f.content"
    )


def docs_prereq_claims(found: DataFrame) -> DataFrame:
    return found.select(
        *FILE_KEY, F.lit("environment-prerequisite").alias("claim_type"), "content",
        F.lit("checked-in-docs").alias("source_authority"), F.lit(0.7).alias("confidence"),
    ).distinct()


def sections(files: DataFrame, text: Column | None = None) -> DataFrame:
    """Heading sections with type and line range; here headings inside fences do split."""
    body = F.col("content") if text is None else text
    # a cut in front of every heading line; the piece before the first has no heading
    cut = files.select("*", F.split(body, r"(?m)(?=^#{1,6}[ \t]+[^\n]+$)").alias("_pieces"))
    counted = cut.select("*", F.transform("_pieces", newline_count).alias("_breaks"))
    numbered = F.transform(
        "_pieces",
        lambda p, i: F.struct(
            p.alias("piece"),
            (F.aggregate(F.slice("_breaks", F.lit(1), i), F.lit(0), lambda a, n: a + n) + 1).alias("start"),
            (i == F.size("_pieces") - 1).alias("final"),
        ),
    )
    rows = exploded(counted, numbered, "_s").drop("_pieces", "_breaks")
    piece = F.col("_s.piece")
    mark = F.regexp_extract(piece, r"^(#{1,6})[ \t]+([^\n]+)", 1)
    heading = F.trim(F.regexp_extract(piece, r"^(#{1,6})[ \t]+([^\n]+)", 2))
    rest = F.when(mark != "", F.regexp_replace(piece, r"^#{1,6}[ \t]+[^\n]+\n?", "")).otherwise(piece)
    content = F.regexp_replace(rest, r"^\s+|\s+$", "")
    # a piece that is not the last ends with the line end before the next heading
    stop = F.col("_s.start") + newline_count(piece) - F.when(F.col("_s.final"), 0).otherwise(1)
    return (
        rows.withColumn("heading", heading)
        .withColumn("level", F.length(mark))
        .withColumn("section_type", md.heading_type(F.lower(heading)))
        .withColumn("body", content)
        .withColumn("line_start", F.col("_s.start"))
        .withColumn("line_end", stop)
        .filter((F.col("heading") != "") | (F.col("body") != ""))
        .drop("_s")
    )


def code_blocks(files: DataFrame, text: Column | None = None) -> DataFrame:
    """Fenced blocks that close, with language, content and line range."""
    body = F.col("content") if text is None else text
    rows = explode_hits(files, body, F.lit(md.FENCED_BLOCK), F.lit(0), "_b", leave=() if text is not None else ("content",))
    block = F.col("_b.match")
    lines = F.split(block, "\n")
    inner = F.slice(lines, F.lit(2), F.size(lines) - 2)
    info = F.trim(F.regexp_extract(block, r"^[ \t]*```([^\n]*)", 1))
    return (
        rows.withColumn("language", F.split_part(info, F.lit(" "), F.lit(1)))
        .withColumn("block", F.array_join(inner, "\n"))
        .withColumn("line_start", F.col("_b.line"))
        .withColumn("line_end", F.col("_b.line") + newline_count(block))
        .drop("_b")
    )


# an item: bullet or number, then indented or plain lines up to a blank line or the next item
_ITEM = r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+[^\n]+(?:\n(?![ \t]*(?:[-*+]|\d+[.)])[ \t]+\S)[ \t]*\S[^\n]*)*+"


def list_items(body: Column) -> Column:
    """array<string> of list items, indented continuation lines joined."""

    def joined(raw: Column) -> Column:
        lines = F.split(raw, "\n")
        more = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: x.rlike(r"^\s{2,}\S.+$"))
        head = F.regexp_replace(F.get(lines, 0), r"^\s*(?:[-*+]|\d+[.)])\s+", "")
        tail = F.transform(more, lambda x: F.concat(F.lit(" "), F.regexp_replace(x, r"^\s+", "")))
        return F.trim(F.concat(head, F.array_join(tail, "")))

    return F.transform(F.regexp_extract_all(body, F.lit(_ITEM), F.lit(0)), joined)


def bullet_items(rows: DataFrame, body: str = "body") -> DataFrame:
    return rows.select("*", F.posexplode_outer(list_items(F.col(body))).alias("item_no", "item")).filter("item IS NOT NULL")


def file_references(files: DataFrame) -> DataFrame:
    """``@path`` mentions."""
    names = F.regexp_extract_all(F.col("content"), F.lit(r"@([\w./\-]+(?:\.\w+)?)"), F.lit(1))
    return files.select(*FILE_KEY, F.explode(F.array_distinct(names)).alias("reference"))


def _command_tags(command: Column) -> Column:
    """Tags by the kind of file the command was read from; rule files of one host give none."""
    kind = F.col("source_kind")
    return (
        F.when(kind == "agents-md", tags_for_imported_command(command))
        .when(kind == "claude-md", tags_for_imported_command(command, "claude-md"))
        .when(kind.startswith("copilot-"), tags_for_imported_command(command, "copilot-instructions"))
        .otherwise(F.array().cast("array<string>"))
    )


def _routed(items: DataFrame) -> DataFrame:
    """Section items to claims. The rules are one table: source by section type by kind of item."""
    item, kind, source = F.col("item"), F.col("section_type"), F.col("source_kind")
    full = source.isin("agents-md", "claude-md")
    bare = F.when((source == "claude-md") & (kind == "commands"), F.trim(F.regexp_replace(item, "^`+|`+$", ""))).otherwise(item)
    command = md.is_command_like(item) | md.is_command_like(bare)
    after_colon = F.regexp_replace(F.trim(F.regexp_replace(item, r"^[^:]*:", "")), "^`+|`+$", "")
    named = full & (kind == "commands") & ~command & item.contains(":") & md.is_command_like(after_colon)
    directive = (kind == "unknown") & md.is_directive(item)
    claim_type = (
        F.when(directive, "always-on-rule")
        .when(command & kind.isin("setup", "commands", "unknown"), "validated-command")
        .when(command & (kind == "testing") & (source != "cursor-rules"), "validated-command")
        .when(named, "validated-command")
        .when(kind == "setup", "environment-prerequisite")
        .when((kind == "conventions") | ((kind == "testing") & full), "always-on-rule")
        .when((kind == "architecture") & full, "module-boundary")
        .when((kind == "skills") & full, "skill-playbook")
    )
    is_command = claim_type == "validated-command"
    text = F.when(named, after_colon).when(is_command, md.strip_prompt(bare)).otherwise(item)
    eager = source.startswith("copilot-") | (source == "claude-md")
    confidence = (
        F.when(kind == "architecture", 0.6)
        .when(directive & eager, 0.9)
        .when(kind.isin("skills", "unknown"), 0.8)
        .otherwise(0.9)
    )
    tags = (
        F.when(kind == "setup", F.array(F.lit("setup")))
        .when(kind == "testing", F.array(F.lit("test")))
        .when(is_command, _command_tags(text))
        .otherwise(F.array().cast("array<string>"))
    )
    return (
        items.filter(~md.is_generic_prose(item))
        .withColumn("claim_type", claim_type)
        .withColumn("claim_text", text)
        .withColumn("confidence", confidence)
        .withColumn("applicability", tags)
        .filter("claim_type IS NOT NULL AND claim_text <> ''")
    )


def import_scope(path: Column, content: Column) -> Column:
    """Scope of an instruction file: its frontmatter glob, else its folder."""
    head = md.frontmatter(content)
    glob = F.coalesce(
        F.nullif(F.try_element_at(head, F.lit("applyTo")), F.lit("")),
        F.nullif(F.try_element_at(head, F.lit("glob")), F.lit("")),
        F.nullif(F.try_element_at(head, F.lit("globs")), F.lit("")),
    )
    always = F.lower(F.coalesce(F.try_element_at(head, F.lit("alwaysApply")), F.lit(""))).isin("true", "yes", "1")
    scoped = instruction_source(path).isin("cursor-rules", "copilot-instructions", "copilot-scoped-instructions")
    return (
        F.when(scoped & glob.isNotNull(), glob)
        .when(scoped & always, "**")
        .otherwise(scope_from_path(path))
    )


def instruction_claims(files: DataFrame) -> DataFrame:
    """Claims of hand-written instruction files: fenced shell lines and routed list items."""
    source = instruction_source(F.col("path"))
    kept = (
        files.withColumn("source_kind", source)
        .filter("source_kind IS NOT NULL AND source_kind <> 'copilot-setup-steps'")
        .withColumn("claim_scope", import_scope(F.col("path"), F.col("content")))
        .withColumn("content", md.body_after_frontmatter(F.col("content")))
    )
    base = [*FILE_KEY, "source_kind", "claim_scope"]
    lines = (
        code_blocks(kept)
        .filter(F.lower("language").isin(*dims.SHELL_LANGS))
        .select(*base, F.explode(F.split("block", "\n")).alias("raw"))
        .withColumn("raw", F.trim("raw"))
        .filter("raw <> '' AND NOT startswith(raw, '#')")
    )
    out = [*base, "claim_type", "claim_text", "confidence", "applicability"]
    command = md.strip_prompt(F.col("raw"))
    fenced = lines.filter(command != "").select(
        *base, F.lit("validated-command").alias("claim_type"), command.alias("claim_text"),
        F.lit(1.0).alias("confidence"), _command_tags(command).alias("applicability"),
    )
    return fenced.unionByName(_section_claims(sections(kept).filter("body <> ''")).select(*out))


def _section_claims(parts: DataFrame) -> DataFrame:
    """List items, back-quoted commands and directive lines of the sections, in one pass.

    The last two only count where no item of the file gave the same text.
    """
    kind, source = F.col("section_type"), F.col("source_kind")
    none = F.array().cast("array<string>")
    ticks = F.when(
        (source == "agents-md") & (kind == "commands"),
        F.regexp_extract_all("body", F.lit("`([^`]+)`"), F.lit(1)),
    ).otherwise(none)
    plain = F.when(
        (source == "claude-md") & (kind == "unknown"),
        F.transform(F.split("body", "\n"), lambda x: F.trim(x)),
    ).otherwise(none)
    found = F.concat(
        F.transform(list_items(F.col("body")), lambda x: F.struct(F.lit(0).alias("how"), x.alias("item"))),
        F.transform(ticks, lambda x: F.struct(F.lit(1).alias("how"), x.alias("item"))),
        F.transform(plain, lambda x: F.struct(F.lit(2).alias("how"), x.alias("item"))),
    )
    # kept: items are read twice, and finding them goes through every text
    rows = checkpointed(exploded(parts, found, "f").select(
        *FILE_KEY, "source_kind", "claim_scope", "section_type", "f.how", "f.item"
    ))
    item = F.col("item")
    listed = _routed(rows.filter("how = 0"))
    extra = (
        rows.filter(
            ((F.col("how") == 1) & md.is_command_like(item))
            | ((F.col("how") == 2) & (item != "") & ~item.startswith("#") & md.is_directive(item))
        )
        .withColumn("claim_type", F.when(F.col("how") == 1, "validated-command").otherwise("always-on-rule"))
        .withColumn("claim_text", item)
        .withColumn("confidence", F.lit(0.8))
        .withColumn("applicability", F.when(F.col("how") == 1, tags_for_imported_command(item)).otherwise(none))
    )
    per_text = Window.partitionBy(*FILE_KEY, "claim_text")
    ranked = listed.unionByName(extra).withColumn("_least", F.min("how").over(per_text)).withColumn(
        "_nth", F.row_number().over(per_text.orderBy("how"))
    )
    return ranked.filter("how = 0 OR (_least > 0 AND _nth = 1)")


def unparseable_sections(files: DataFrame) -> DataFrame:
    """Unclassified sections without a single directive or command, first 500 characters shown."""
    kept = files.filter(instruction_source(F.col("path")).isNotNull()).withColumn(
        "content", md.body_after_frontmatter(F.col("content"))
    )
    found = sections(kept).filter("section_type = 'unknown' AND body <> ''").drop("content")
    items = F.regexp_extract_all(F.col("body"), F.lit(_ITEM), F.lit(0))
    useful = F.exists(
        F.transform(items, lambda x: F.regexp_replace(x, r"^\s*(?:[-*+]|\d+[.)])\s+", "")),
        lambda x: ~md.is_generic_prose(x) & (md.is_directive(x) | md.is_command_like(x)),
    )
    return found.filter(~useful & ~md.is_generic_prose(F.col("body"))).select(
        *FILE_KEY, "heading", F.substring("body", 1, 500).alias("shown")
    )
