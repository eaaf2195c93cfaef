"""Pattern hits with positions, entropy, redaction: all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def exploded(df: DataFrame, values: Column, out: str) -> DataFrame:
    """One row per element. A plain ``explode`` makes the planner test the size of the list
    first, which computes a costly list twice; the outer form with a null test does not.
    """
    return df.withColumn(out, F.explode_outer(values)).filter(F.col(out).isNotNull())


def explode_hits(df: DataFrame, text: Column, pattern: Column, group: Column, out: str = "_h", leave: tuple[str, ...] = ()) -> DataFrame:
    """One row per match, as a struct ``start, stop, line, match, value`` in ``out``; columns in ``leave`` stay behind.

    Positions come from the pieces between the matches, so the whole text is used and
    nothing but built-in functions runs. The arrays are columns of their own first:
    an array used inside a lambda would be computed again for every element.
    """
    cut = df.select(
        "*",
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("_found"),
        F.regexp_extract_all(text, pattern, group).alias("_values"),
        F.split(text, pattern, -1).alias("_pieces"),
    ).filter(F.size("_found") > 0)
    sized = cut.select(
        *[c for c in cut.columns if c != "_pieces" and c not in leave],
        F.transform("_pieces", lambda p: F.length(p)).alias("_gap_size"),
        F.transform("_pieces", newline_count).alias("_gap_lines"),
        F.transform("_found", lambda m: F.length(m)).alias("_hit_size"),
        F.transform("_found", newline_count).alias("_hit_lines"),
    )

    def total(values: str, count: Column) -> Column:
        return F.aggregate(F.slice(values, F.lit(1), count), F.lit(0), lambda a, v: a + v)

    def locate(match: Column, i: Column) -> Column:
        start = total("_gap_size", i + 1) + total("_hit_size", i)
        return F.struct(
            start.alias("start"),
            (start + F.length(match)).alias("stop"),
            (total("_gap_lines", i + 1) + total("_hit_lines", i) + 1).alias("line"),
            match.alias("match"),
            F.get("_values", i).alias("value"),
        )

    return exploded(sized, F.transform("_found", locate), out).drop(
        "_found", "_values", "_gap_size", "_gap_lines", "_hit_size", "_hit_lines"
    )


def downgraded(severity: Column) -> Column:
    return F.when(severity == "high", "medium").otherwise("low")


def shannon_entropy(text: Column) -> Column:
    chars = F.split(text, "")
    total = F.length(text).cast("double")

    def add(acc: Column, ch: Column) -> Column:
        share = F.size(F.filter(chars, lambda x: x == ch)) / total
        return acc - share * F.log2(share)

    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), add)
    return F.when(F.length(text) > 0, bits).otherwise(F.lit(0.0))


def redact(text: Column, secrets: Column) -> Column:
    """Replace every secret, longest first, keeping four characters of long ones."""
    ordered = F.array_sort(F.transform(secrets, lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s"))))

    def mask(acc: Column, item: Column) -> Column:
        head = F.when(F.length(item.s) > 8, F.substring(item.s, 1, 4)).otherwise("")
        return F.replace(acc, item.s, F.concat(head, F.lit("...REDACTED")))

    return F.aggregate(ordered, text, mask)


def sanitize_argument(value: Column, secrets: Column) -> Column:
    """Redacted value; long values become their shape."""
    clean = redact(value, secrets)
    size = F.length(clean)
    shape = F.concat(F.substring(clean, 1, 100), F.lit("... ("), size.cast("string"), F.lit(" chars)"))
    return F.when(size > 200, shape).otherwise(clean)
