"""Disagreements between claims.

Groups are summarised first and joined back, so each claim meets a few summary
rows of its group and never every other claim: the work and the output grow with
the claims. A row names how many partners a claim disagrees with and one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta import dims
from attesta.functions.base import contains_any, first_match, lookup
from attesta.functions.commands import command_key
from attesta.functions.versions import is_minimum, is_range, runtime_name, version_tuple

CONFIG_SOURCES = ("executable-config", "ci-observed")


def same_key_conflicts(claims: DataFrame) -> DataFrame:
    """Claims whose (repo, type, scope) holds another content.

    ``partners`` counts the claims of different content; ``rival`` is the smallest
    content that differs.
    """
    key = ["repo_id", "claim_type", "scope"]
    per_content = claims.groupBy(*key, "content").agg(F.count(F.lit(1)).alias("same"))
    groups = per_content.groupBy(*key).agg(
        F.sum("same").alias("group_size"),
        F.count(F.lit(1)).alias("contents"),
        F.min("content").alias("low"),
        F.max("content").alias("high"),
    ).filter("contents > 1")
    rival = F.when(F.col("content") == F.col("low"), F.expr("second")).otherwise(F.col("low"))
    second = (
        per_content.join(groups.select(*key, "low"), key)
        .filter("content > low").groupBy(*key).agg(F.min("content").alias("second"))
    )
    report = (
        per_content.join(groups, key)
        .join(second, key)
        .select(*key, "content", (F.col("group_size") - F.col("same")).alias("partners"), rival.alias("rival"))
    )
    return claims.join(report, [*key, "content"])


def _versioned(claims: DataFrame) -> DataFrame:
    text = F.col("content")
    return (
        claims.filter("claim_type = 'environment-prerequisite'")
        .withColumn("runtime", runtime_name(text))
        .withColumn("version", version_tuple(text))
        .withColumn("kind", F.when(is_minimum(text), "minimum").when(is_range(text), "range").otherwise("exact"))
        .filter("runtime IS NOT NULL AND version IS NOT NULL AND kind <> 'range'")
    )


def _against(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Per specification of ``mine``: how many of ``theirs`` it contradicts, and the sharpest one.

    Two exact versions contradict when they differ; an exact version contradicts a
    higher minimum; two minimums never do. Only distinct specifications meet.
    """
    key = ["repo_id", "runtime"]
    spec = [*key, "kind", "version"]
    counts = theirs.groupBy(*spec).agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("sample"))
    # running totals over the distinct versions of one runtime in one repository
    asked = mine.select(*spec).distinct().withColumn("asked", F.lit(True))
    ladder = asked.join(counts, spec, "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    exact, minimum = F.col("kind") == "exact", F.col("kind") == "minimum"
    whole = Window.partitionBy(*key)
    below = Window.partitionBy(*key).orderBy("version").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    filled = (
        ladder.withColumn("exact_all", F.sum(F.when(exact, F.col("n")).otherwise(0)).over(whole))
        .withColumn("min_all", F.sum(F.when(minimum, F.col("n")).otherwise(0)).over(whole))
        .withColumn("exact_to", F.sum(F.when(exact, F.col("n")).otherwise(0)).over(below))
        .withColumn("min_to", F.sum(F.when(minimum, F.col("n")).otherwise(0)).over(below))
        .withColumn("exact_here", F.sum(F.when(exact, F.col("n")).otherwise(0)).over(Window.partitionBy(*key, "version")))
        .withColumn("top_min", F.max(F.when(minimum & (F.col("n") > 0), F.struct("version", "sample"))).over(whole))
        .withColumn("low_exact", F.min(F.when(exact & (F.col("n") > 0), F.struct("version", "sample"))).over(whole))
        .withColumn("top_exact", F.max(F.when(exact & (F.col("n") > 0), F.struct("version", "sample"))).over(whole))
    )
    partners = F.when(
        exact, (F.col("exact_all") - F.col("exact_here")) + (F.col("min_all") - F.col("min_to"))
    ).otherwise(F.col("exact_to") - F.col("exact_here"))
    other_exact = F.when(F.col("low_exact.version") != F.col("version"), F.col("low_exact.sample")).otherwise(F.col("top_exact.sample"))
    rival = F.when(
        exact, F.when(F.col("top_min.version") > F.col("version"), F.col("top_min.sample")).otherwise(other_exact)
    ).otherwise(F.col("low_exact.sample"))
    return filled.filter("asked").select(*spec, partners.alias("partners"), rival.alias("rival")).filter("partners > 0")


def version_conflicts(claims: DataFrame) -> DataFrame:
    """Prerequisites of one runtime that cannot all hold."""
    specs = _versioned(claims)
    return specs.join(_against(specs, specs), ["repo_id", "runtime", "kind", "version"]).withColumn(
        "conflict_type", F.lit("version")
    )


def import_conflicts(claims: DataFrame) -> DataFrame:
    """Imported prerequisites that the extracted ones contradict."""
    specs = _versioned(claims)
    imported = F.col("source_authority") == "declared-imported-unreviewed"
    mine, theirs = specs.filter(imported), specs.filter(~imported)
    return mine.join(_against(mine, theirs), ["repo_id", "runtime", "kind", "version"]).withColumn(
        "conflict_type", F.lit("import-vs-extraction")
    )


def _config_commands(claims: DataFrame) -> DataFrame:
    return claims.filter(
        (F.col("claim_type") == "validated-command") & F.col("source_authority").isin(*CONFIG_SOURCES)
    )


def docs_command_conflicts(claims: DataFrame) -> DataFrame:
    """Documented test commands in repositories whose configuration has no test command."""
    config = _config_commands(claims).groupBy("repo_id").agg(
        F.bool_or(F.lower("content").contains("test")).alias("has_test")
    )
    docs = claims.filter(
        (F.col("claim_type") == "validated-command") & (F.col("source_authority") == "checked-in-docs")
    ).filter(command_key(F.col("content")).isin("npm test", "npm run", "yarn test", "pnpm test"))
    return docs.join(config.filter(~F.col("has_test")), "repo_id").withColumn("conflict_type", F.lit("command"))


def stale_import_conflicts(claims: DataFrame) -> DataFrame:
    """Imported commands that no configured command backs, where configuration exists."""
    config = _config_commands(claims)
    keys = config.select("repo_id", command_key(F.col("content")).alias("ckey")).distinct()
    texts = config.select("repo_id", F.lower(F.trim("content")).alias("ctext")).distinct()
    imported = (
        claims.filter(
            (F.col("claim_type") == "validated-command")
            & (F.col("source_authority") == "declared-imported-unreviewed")
        )
        .withColumn("ckey", command_key(F.col("content")))
        .withColumn("ctext", F.lower(F.trim("content")))
        .filter("ckey IS NOT NULL")
    )
    return (
        imported.join(config.select("repo_id").distinct(), "repo_id", "left_semi")
        .join(keys, ["repo_id", "ckey"], "left_anti")
        .join(texts, ["repo_id", "ctext"], "left_anti")
        .withColumn("conflict_type", F.lit("stale-import"))
    )


def topic(content):
    low = F.lower(content)
    early = [(contains_any(low, words), F.lit(t)) for words, t in dims.TOPIC_KEYWORDS]
    placement = [(low.contains("test") & low.contains("place"), F.lit("test placement"))]
    late = [(contains_any(low, words), F.lit(t)) for words, t in dims.TOPIC_KEYWORDS_LATE]
    return first_match([*early, *placement, *late])


def styles(content):
    low = F.lower(content)
    found = [F.when(content.contains(s), F.lit(s)) for s in dims.STYLES]
    found += [F.when(low.contains(f"prefer {w}"), F.lit(f"{w}_imports")) for w in ("absolute", "relative")]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def topic_conflicts(claims: DataFrame) -> DataFrame:
    """Topics of a repository with more than one text and more than one style asserted."""
    rules = claims.filter(F.col("claim_type").isin("always-on-rule", "scoped-rule"))
    tagged = rules.withColumn("topic", topic(F.col("content"))).filter("topic IS NOT NULL")
    key = ["repo_id", "topic"]
    # at most six styles exist, so the per-style flags replace a collected set
    names = [*dims.STYLES, "absolute_imports", "relative_imports"]
    flags = [F.bool_or(F.array_contains(styles(F.col("content")), s)).cast("int").alias(s) for s in names]
    groups = tagged.groupBy(*key).agg(
        F.min("content").alias("low"), F.max("content").alias("high"),
        F.min(lookup(F.col("source_authority"), dims.AUTHORITY_LEVEL)).alias("authority_level"), *flags,
    )
    total = sum((F.col(s) for s in names[1:]), F.col(names[0]))
    hit = groups.withColumn("styles", total).filter((F.col("low") != F.col("high")) & (F.col("styles") > 1))
    first = Window.partitionBy(*key).orderBy("ordinal")
    three = tagged.withColumn("place", F.row_number().over(first)).filter("place <= 3")
    said = three.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "content"))).alias("said"))
    text = F.array_join(F.transform("said", lambda s: F.concat(F.lit("'"), s.content, F.lit("'"))), " vs ")
    return hit.join(said, key).select(
        *key, "styles", "authority_level",
        F.concat(F.lit("Convention conflict on '"), F.col("topic"), F.lit("': "), text).alias("content"),
    )


def highest_authority(claims: DataFrame, keys: list[str]) -> DataFrame:
    return claims.groupBy(*keys).agg(
        F.min(F.struct("authority_level", "source_authority")).alias("best")
    ).select(*keys, F.col("best.source_authority").alias("authority"))
