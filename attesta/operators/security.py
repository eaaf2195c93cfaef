"""Injection and secret scans over any text column.

Patterns are data: a table of regexes with the literals their matches must hold. A text is searched for all literals, and
a pattern is tried only where its own stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attesta import dims
from attesta.functions import codecs, textscan
from attesta.functions.base import lookup
from attesta.operators.maintenance import first_by

#: (regex, label, group of the value, literals); see ``pattern_table``.
Pattern = tuple[str, str, int, str | None]
PATTERNS = "no int, pattern string, label string, group int, literals string"
MOST_PATTERNS = 10_000

INJECTION = tuple((p, severity, 0, given) for (p, severity), given in zip(dims.INJECTION_MARKERS, dims.INJECTION_LITERALS, strict=True))
SECRETS = tuple((*row, given) for row, given in zip(dims.SECRET_PATTERNS, dims.SECRET_LITERALS, strict=True))
ASSIGNED = (dims.ASSIGNED_VALUE, dims.ENTROPY_LABEL, 1, dims.ASSIGNED_LITERALS)


def pattern_table(spark: SparkSession, patterns: tuple[Pattern, ...]) -> DataFrame:
    """The patterns as rows of a table, to be kept, edited and extended (``unionByName``) like any other.

    ``literals`` are lower-case texts parted by blanks, one of which every match holds (with ``^``: starts with); null where none is
    known, and the pattern is tried on every text then. Patterns are scanned in the order of ``no``.
    """
    return spark.createDataFrame([(no, *row) for no, row in enumerate(patterns)], PATTERNS)


def patterns_of(given: DataFrame | tuple[Pattern, ...]) -> tuple[Pattern, ...]:
    """The rows of such a table; it holds ``MOST_PATTERNS`` at most."""
    if not isinstance(given, DataFrame):
        return tuple(given)
    rows = given.orderBy("no").limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"a pattern table has at most {MOST_PATTERNS} rows")
    return tuple((r["pattern"], r["label"], r["group"], r["literals"]) for r in rows)


def _any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _hits(df: DataFrame, text: str, patterns: tuple[Pattern, ...]) -> DataFrame:
    """One row per pattern match: no, label, start, stop, line, match, value, context, fenced. The text stays behind."""
    labels = F.array(*[F.lit(label) for _, label, _, _ in patterns])
    schema = StructType([f for f in df.schema.fields if f.name != text] + StructType.fromDDL(codecs.HIT).fields)
    run = codecs.pattern_hits(tuple((p, group, given) for p, _, group, given in patterns), df.columns.index(text))
    return df.mapInArrow(run, schema).withColumn("label", F.get(labels, F.col("no")))


def scan_injection(
    df: DataFrame, text: str = "text", markers: DataFrame | tuple[Pattern, ...] = INJECTION, most_context: int | None = 120
) -> DataFrame:
    """Injection findings; a finding inside a fenced block counts one level lower. ``label`` of a marker is its severity."""
    hits = _hits(df, text, patterns_of(markers))
    context = shown = F.col("context")
    if most_context is not None:
        shown = F.when(F.length(context) > most_context, F.concat(F.substring(context, 1, most_context), F.lit("..."))).otherwise(context)
    return (
        hits.withColumnRenamed("fenced", "in_code_block")
        .withColumn("severity", F.when(F.col("in_code_block"), textscan.downgraded(F.col("label"))).otherwise(F.col("label")))
        .withColumn("context", shown)
        .withColumnRenamed("match", "marker")
        .drop("label", "start", "stop", "value")
    )


def max_injection_severity(findings: DataFrame, keys: list[str]) -> DataFrame:
    rank = lookup(F.col("severity"), dims.SEVERITY_RANK, 9)
    return findings.groupBy(*keys).agg(F.min_by("severity", rank).alias("worst"), F.count(F.lit(1)).alias("findings"))


def _secret_like(value: Column) -> Column:
    """Whether an assigned value is random enough, and neither a UUID nor the name of a commit."""
    return ~value.rlike(dims.UUID_SHAPE) & ~value.rlike(dims.COMMIT_SHAPE) & (textscan.shannon_entropy(value) > dims.ENTROPY_LIMIT)


def secret_hits(
    df: DataFrame,
    keys: list[str],
    text: str = "text",
    patterns: DataFrame | tuple[Pattern, ...] = SECRETS,
) -> DataFrame:
    """Known shapes and quoted high-entropy assignments, a span possibly under several labels."""
    hits = _hits(df, text, (*patterns_of(patterns), ASSIGNED))
    generic = F.col("label") == dims.ENTROPY_LABEL
    kept = hits.filter(~generic | _secret_like(F.col("value")))
    redacted = textscan.redact(F.col("context"), F.array("value"))
    return kept.select(
        *keys, "no", F.col("label").alias("pattern_type"), "start", "stop", "line", "value", redacted.alias("redacted_context")
    )


def scan_secrets(
    df: DataFrame,
    keys: list[str],
    text: str = "text",
    patterns: DataFrame | tuple[Pattern, ...] = SECRETS,
) -> DataFrame:
    """Secret findings, one per span: the first pattern in scan order names it."""
    return first_by(secret_hits(df, keys, text, patterns), [*keys, "start", "stop"], [F.col("no").asc()])


def sanitize_arguments(calls: DataFrame, keys: list[str], arguments: str = "arguments") -> DataFrame:
    """``arguments`` (name to text or JSON) fit for a log: secrets found by the scan cut, long texts and containers as shapes."""
    named = calls.select(*keys, F.explode_outer(arguments).alias("_name", "_value"))
    leaked = (
        scan_secrets(named.select(*keys, "_name", F.col("_value").alias("text")), [*keys, "_name"])
        .groupBy(*keys, "_name").agg(F.collect_set("value").alias("_leaked"))
    )
    value = F.col("_value")
    parsed = F.when(value.startswith("[") | value.startswith("{"), F.try_parse_json(value))
    items = F.size(F.try_variant_get(parsed, "$", "array<variant>"))
    members = F.size(F.map_keys(F.try_variant_get(parsed, "$", "map<string,variant>")))
    shown = (
        F.when(value.startswith("[") & parsed.isNotNull(), F.concat(F.lit("[list of "), items, F.lit(" items]")))
        .when(value.startswith("{") & parsed.isNotNull(), F.concat(F.lit("{dict with "), members, F.lit(" keys}")))
        .otherwise(textscan.sanitize_argument(value, F.coalesce("_leaked", F.array().cast("array<string>"))))
    )
    rows = named.join(leaked, [*keys, "_name"], "left").withColumn("_shown", shown)
    entries = F.array_sort(F.collect_list(F.when(F.col("_name").isNotNull(), F.struct("_name", "_shown"))))
    return rows.groupBy(*keys).agg(F.map_from_entries(entries).alias(arguments))


def security_warnings(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Finding counts of every text; a text without findings has zeros."""
    injections = scan_injection(df, text).select(*keys, F.lit("injection").alias("kind"))
    secrets = scan_secrets(df, keys, text).select(*keys, F.lit("secret").alias("kind"))
    scanned = df.select(*keys, F.lit("").alias("kind"))
    return scanned.unionByName(injections).unionByName(secrets).groupBy(*keys).agg(
        F.count_if(F.col("kind") == "injection").alias("injections"),
        F.count_if(F.col("kind") == "secret").alias("secrets"),
    )


def security_found(claims: DataFrame) -> DataFrame:
    """Claims with ``severe``, whether their text has a finding of high severity, and ``leaked``, the secrets in it.

    Both are found row by row: no claim is moved for it, as findings joined back to their claims would.
    """
    high = tuple((p, group, given) for p, severity, group, given in INJECTION if severity == "high")
    secrets = tuple((p, group, given) for p, _, group, given in SECRETS)
    # copied out of the text and tested in Spark, as `secret_hits` does
    found = codecs.hit_values(high, secrets, ((ASSIGNED[0], *ASSIGNED[2:]),))("content")
    leaked = F.array_union("_hit.known", F.filter("_hit.loose", _secret_like))
    return claims.withColumn("_hit", found).select(*claims.columns, F.coalesce("_hit.severe", F.lit(False)).alias("severe"), leaked.alias("leaked"))


def security_applied(found: DataFrame) -> DataFrame:
    """High-severity text needs a declaration; secrets are cut out and the claim stays local. The id is not recomputed."""
    leaks = F.size("leaked") > 0
    return (
        found.withColumn("review_state", F.when(F.col("severe"), "needs-declaration").otherwise(F.col("review_state")))
        .withColumn("sensitivity", F.when(leaks, "local-only").otherwise(F.col("sensitivity")))
        .withColumn("content", F.when(leaks, textscan.redact(F.col("content"), F.col("leaked"))).otherwise(F.col("content")))
        .drop("severe", "leaked")
    )


def security_scan_claims(claims: DataFrame) -> DataFrame:
    """Claims as the security scan leaves them."""
    return security_applied(security_found(claims))


def scan_output(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Warnings for high and medium findings in any string column of an output table."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("cell")) for c in columns]))
    tall = df.select(*keys, cells.alias("c")).select(*keys, "c.field", "c.cell").filter("cell IS NOT NULL")
    found = scan_injection(tall, "cell").filter(F.col("severity").isin("high", "medium"))
    text = F.concat(F.lit("potential injection marker ("), F.col("marker"), F.lit(") at "), F.col("field"))
    return found.select(*keys, "field", "line", text.alias("warning"))


def legacy_markers(df: DataFrame, text: str = "text", patterns: tuple[str, ...] = dims.LEGACY_MARKERS) -> DataFrame:
    """First match of each of the older patterns."""
    value = F.col(text)
    first = [F.struct(F.lit(i).alias("no"), F.regexp_extract(value, f"({p})", 1).alias("marker")) for i, p in enumerate(patterns)]
    rest = [c for c in df.columns if c != text]
    found = df.filter(value.rlike(_any_of(list(patterns)))).withColumn("_m", F.filter(F.array(*first), lambda m: m.marker != ""))
    return found.select(*rest, F.inline("_m"))
