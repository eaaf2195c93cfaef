"""Coding conventions counted over symbols and imports.

Every measure is a sum of partial counts, so hot repositories are combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import dims
from attesta.functions.base import percent_text
from attesta.functions.naming import bucket_authority, bucket_review, bucket_type, classify_name


def naming_stats(names: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Counts per style, dominant style (first seen wins a tie) and its share."""
    styled = names.withColumn("style", classify_name(F.col("name")))
    # by all but the last of the order first: numbers are kept by hashing, while a smallest struct has every name sorted
    *before, last = order
    per_part = styled.groupBy(*keys, "style", *before).agg(F.count(F.lit(1)).alias("n"), F.min(last).alias(last))
    per_style = per_part.groupBy(*keys, "style").agg(F.sum("n").alias("n"), F.min(F.struct(*order)).alias("first_seen"))
    # a plain test of the style would be moved in front of the counts, where every name is classified once more for it
    per_style = per_style.filter(F.when(F.col("style").isNotNull(), F.col("n")) > 0)
    # at most four styles per group from here on
    ranked = per_style.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("styles"),
        F.min(F.struct((-F.col("n")).alias("n"), "first_seen", "style")).alias("top"),
    )
    return ranked.select(
        *keys, "total", "styles", F.col("top.style").alias("dominant"),
        (-F.col("top.n") / F.col("total")).alias("consistency"),
    )


def _as_claims(rows: DataFrame, keys: list[str], content: Column, share: str, tag: str) -> DataFrame:
    value = F.col(share)
    return rows.select(
        *keys, content.alias("content"), bucket_type(value).alias("claim_type"),
        bucket_authority(value).alias("source_authority"), bucket_review(value).alias("review_state"),
        F.round(share, 4).alias("confidence"), F.lit(tag).alias("tag"),
    )


def _style_text(label: Column) -> Column:
    return F.concat(
        F.lit("Use "), "dominant", F.lit(" for "), label, F.lit(" ("), percent_text(F.col("consistency")),
        F.lit(" consistency across "), F.col("total").cast("string"), F.lit(" identifiers)"),
    )


def naming_conventions(stats: DataFrame, formatted: DataFrame | None = None, owned_style: str | None = "snake_case") -> DataFrame:
    """Naming claims of (repo_id, kind) statistics.

    In repositories with a formatter function names of its style are no claim; without a style (JavaScript) none are.
    """
    kept = stats.filter((F.col("total") >= dims.MIN_SAMPLE) & (F.col("consistency") >= dims.WEAK))
    if formatted is not None:
        owned = formatted.select("repo_id").distinct().withColumn("_owned", F.lit(True))
        kept = kept.join(owned, "repo_id", "left").filter(
            F.col("_owned").isNull() | (F.col("kind") != "function") | (F.lit(False) if owned_style is None else F.col("dominant") != owned_style)
        )
    label = F.concat(F.col("kind"), F.lit(" names"))
    return _as_claims(kept, ["repo_id", "kind"], _style_text(label), "consistency", "all")


def scoped_conventions(by_module: DataFrame, by_repo: DataFrame) -> DataFrame:
    """Module statistics that differ from the repository's dominant style."""
    whole = by_repo.select("repo_id", "kind", F.col("dominant").alias("repo_style"))
    kept = by_module.filter((F.col("total") >= dims.MIN_SAMPLE) & (F.col("consistency") >= dims.WEAK))
    odd = kept.join(whole, ["repo_id", "kind"], "left").filter(~F.col("dominant").eqNullSafe(F.col("repo_style")))
    label = F.concat(F.col("kind"), F.lit(" names"))
    rows = _as_claims(odd, ["repo_id", "module", "kind"], _style_text(label), "consistency", "all")
    return rows.withColumn("claim_type", F.lit("scoped-rule"))


def _dominant_share(rows: DataFrame, keys: list[str], options: list[tuple[str, Column]]) -> DataFrame:
    """Largest of a few counted options per group, the first listed winning a tie."""
    counts = rows.groupBy(*keys).agg(*[F.count_if(cond).alias(f"_c{i}") for i, (_, cond) in enumerate(options)])
    total = sum((F.col(f"_c{i}") for i in range(1, len(options))), F.col("_c0"))
    ranked = F.array(*[
        F.struct(F.col(f"_c{i}").alias("n"), F.lit(-i).alias("i"), F.lit(label).alias("label"))
        for i, (label, _) in enumerate(options)
    ])
    top = F.array_max(ranked)
    return counts.select(
        *keys, total.alias("total"), top["label"].alias("dominant"), (top["n"] / total).alias("share")
    ).filter("total > 0")


def test_placement(test_files: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    tests, test = F.array_contains(parts, "tests"), F.array_contains(parts, "test")
    return _dominant_share(test_files, ["repo_id"], [
        ("tests/ directory", tests), ("test/ directory", ~tests & test), ("co-located test files", ~tests & ~test)])


def js_test_placement(test_files: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    dunder = F.array_contains(parts, "__tests__")
    folder = ~dunder & (F.array_contains(parts, "tests") | F.array_contains(parts, "test"))
    return _dominant_share(test_files, ["repo_id"], [
        ("__tests__/ directory", dunder), ("tests/ or test/ directory", folder), ("co-located (*.test.* / *.spec.*)", ~dunder & ~folder)])


def placement_claims(placement: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Tests are placed in "), "dominant", F.lit(" ("), percent_text(F.col("share")), F.lit(" of test files)"))
    return _as_claims(placement.filter(F.col("share") >= dims.WEAK), ["repo_id"], text, "share", "testing")


def import_style(imports: DataFrame) -> DataFrame:
    relative = F.coalesce(F.col("level") > 0, F.lit(False))
    return _dominant_share(imports, ["repo_id"], [("absolute imports", ~relative), ("relative imports", relative)]).filter(
        F.col("total") >= dims.MIN_SAMPLE
    )


def import_style_claims(style: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Prefer "), "dominant", F.lit(" ("), percent_text(F.col("share")), F.lit(" consistency)"))
    return _as_claims(style.filter(F.col("share") >= dims.WEAK), ["repo_id"], text, "share", "all")


def annotation_ratios(functions: DataFrame) -> DataFrame:
    return functions.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("functions"), F.count_if("returns").alias("with_return"),
        F.sum(F.coalesce("params", F.lit(0))).alias("params"), F.sum(F.coalesce("annotated", F.lit(0))).alias("annotated"),
    ).select(
        "*", F.coalesce(F.try_divide("with_return", "functions"), F.lit(0.0)).alias("return_ratio"),
        F.coalesce(F.try_divide("annotated", "params"), F.lit(0.0)).alias("param_ratio"),
    )


def annotation_claims(ratios: DataFrame) -> DataFrame:
    returns = ratios.filter((F.col("functions") >= dims.MIN_SAMPLE) & (F.col("return_ratio") >= dims.WEAK))
    params = ratios.filter((F.col("params") >= dims.MIN_SAMPLE) & (F.col("param_ratio") >= dims.WEAK))
    a = F.concat(F.lit("Use return type annotations on functions ("), percent_text(F.col("return_ratio")), F.lit(" of "), F.col("functions").cast("string"), F.lit(" functions annotated)"))
    b = F.concat(F.lit("Use parameter type annotations ("), percent_text(F.col("param_ratio")), F.lit(" of "), F.col("params").cast("string"), F.lit(" parameters annotated)"))
    return _as_claims(returns, ["repo_id"], a, "return_ratio", "all").unionByName(_as_claims(params, ["repo_id"], b, "param_ratio", "all"))


def docstring_ratios(symbols: DataFrame) -> DataFrame:
    function, cls = F.col("kind") == "function", F.col("kind") == "class"
    doc = F.coalesce("doc", F.lit(False))
    return symbols.groupBy("repo_id").agg(
        F.count_if(function).alias("functions"), F.count_if(function & doc).alias("functions_with"),
        F.count_if(cls).alias("classes"), F.count_if(cls & doc).alias("classes_with"),
    ).select(
        "*", F.coalesce(F.try_divide("functions_with", "functions"), F.lit(0.0)).alias("function_ratio"),
        F.coalesce(F.try_divide("classes_with", "classes"), F.lit(0.0)).alias("class_ratio"),
    )


def docstring_claims(ratios: DataFrame) -> DataFrame:
    kept = ratios.filter((F.col("functions") >= dims.MIN_SAMPLE) & (F.col("function_ratio") >= dims.WEAK))
    text = F.concat(F.lit("Include docstrings on functions ("), percent_text(F.col("function_ratio")), F.lit(" of functions have docstrings)"))
    return _as_claims(kept, ["repo_id"], text, "function_ratio", "all")


def js_test_framework(test_imports: DataFrame, test_files: DataFrame) -> DataFrame:
    """Dominant framework among the imports of test files; tests without one count as the default."""
    names = F.filter(
        F.array(*[F.when(F.col("name").contains(p), F.struct(F.lit(i).alias("i"), F.lit(n).alias("n"))) for i, (p, n) in enumerate(dims.JS_TEST_FRAMEWORKS)]),
        lambda x: x.isNotNull(),
    )
    hits = test_imports.select("repo_id", "path", F.explode(names).alias("f"))
    per = hits.groupBy("repo_id", F.col("f.n").alias("framework")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "f.i")).alias("seen"))
    top = per.groupBy("repo_id").agg(
        F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("n"), "seen", "framework")).alias("top")
    )
    repos = test_files.select("repo_id").distinct()
    share = F.coalesce(-F.col("top.n") / F.col("total"), F.lit(0.8))
    return repos.join(top, "repo_id", "left").select(
        "repo_id", F.coalesce("top.framework", F.lit("Jest (inferred from test patterns)")).alias("framework"), share.alias("share")
    )


def js_framework_claims(frameworks: DataFrame) -> DataFrame:
    kept = frameworks.filter(F.col("share") >= dims.WEAK)
    return _as_claims(kept, ["repo_id"], F.concat(F.lit("Test framework: "), "framework"), "share", "testing")


def typescript_share(files: DataFrame) -> DataFrame:
    ts = F.col("path").rlike(r"\.tsx?$")
    rows = files.filter(F.col("path").rlike(r"\.(?:tsx?|jsx?)$"))
    return rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(ts).alias("typescript")).withColumn(
        "share", F.col("typescript") / F.col("total")
    )


def typescript_claims(shares: DataFrame) -> DataFrame:
    kept = shares.filter((F.col("total") >= dims.MIN_SAMPLE) & (F.col("share") >= dims.WEAK))
    text = F.concat(F.lit("TypeScript is the primary language ("), percent_text(F.col("share")), F.lit(" of "), F.col("total").cast("string"), F.lit(" JS/TS files)"))
    return _as_claims(kept, ["repo_id"], text, "share", "all")


