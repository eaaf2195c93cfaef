"""Quality measures over fixtures, artifacts and output tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta import dims
from attesta.functions.base import authority_level, claim_id, exact_mean
from attesta.plans import projection
from attesta.session import checkpointed

PROJECTED = ("validated-command", "always-on-rule", "permission-restriction", "scoped-rule")


def drift_accuracy(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected against detected drift per repository."""
    detected = found.groupBy("repo_id").agg(F.count_if(F.col("status") == "drifted").alias("detected"))
    both = detected.join(expected, "repo_id", "left").fillna(0, ["expected"])
    gap = F.col("detected") - F.col("expected")
    return both.select(
        "repo_id", "expected", "detected",
        F.greatest(gap, F.lit(0)).alias("false_positives"),
        F.greatest(-gap, F.lit(0)).alias("false_negatives"),
    )


# ---- generated files -------------------------------------------------------------------


def file_lines(files: DataFrame) -> DataFrame:
    """Claim texts as they stand in the files, list and code marks taken off."""
    line = F.explode(F.split("text", "\n"))
    bare = F.regexp_replace(F.col("line"), r"^- (?:\*\*WARNING\*\*: )?", "")
    bare = F.regexp_replace(bare, r"^`(.*)`(?: \[[a-z-]+\])?$", "$1")
    return (
        files.select("repo_id", "host", line.alias("line")).filter("startswith(line, '- ')")
        .select("repo_id", "host", F.lower(bare).alias("content")).distinct()
    )


def leakage_check(claims: DataFrame, lines: DataFrame) -> DataFrame:
    """Restricted texts that appear in a host's files; a text that is also public does not count.

    Lines and claims meet by (repository, text), so nothing is compared pairwise.
    """
    text = F.lower("content")
    public = claims.filter("sensitivity = 'public' AND review_state NOT IN ('suppressed', 'tombstoned')").select("repo_id", text.alias("content")).distinct()
    hidden = claims.filter("sensitivity <> 'public'").select("repo_id", "sensitivity", text.alias("content")).distinct()
    secret = hidden.join(public, ["repo_id", "content"], "left_anti")
    hits = lines.join(secret, ["repo_id", "content"]).groupBy("host", "sensitivity").agg(F.count(F.lit(1)).alias("leaks"))
    levels = F.explode(F.array(F.lit("local-only"), F.lit("team-only")))
    cells = lines.select("host").distinct().select("host", levels.alias("sensitivity"))
    return cells.join(hits, ["host", "sensitivity"], "left").select(
        "host", "sensitivity", F.coalesce("leaks", F.lit(0)).cast("bigint").alias("leaks"), (F.coalesce("leaks", F.lit(0)) > 0).alias("leaked")
    )


def _format_ok() -> Column:
    text, path = F.col("text"), F.col("path")
    ruled = F.col("host").isin("cursor", "windsurf")
    front = text.startswith("---\n") & text.rlike(r"(?s)^---\n.*?\n---\n")
    trigger = F.when(F.col("host") == "windsurf", text.rlike(r"(?m)^trigger: (?:always_on|glob)$")).otherwise(text.rlike(r"(?m)^alwaysApply: "))
    glob = ~text.rlike(r"(?m)^trigger: glob$") | text.rlike(r"(?m)^glob: ")
    named = path.rlike(r"/managed-[^/]+\.md$")
    return F.when(ruled, front & trigger & glob & named).when(
        path.isin("AGENTS.md", "CLAUDE.md", ".github/copilot-instructions.md"),
        text.startswith("<!-- Generated from claims") & (F.trim(text) != ""),
    ).when(path.rlike(r"\.(?:json|yml)$"), F.try_parse_json(text).isNotNull()).otherwise(F.trim(text) != "")


def format_check(files: DataFrame) -> DataFrame:
    return files.select("repo_id", "host", "path", _format_ok().alias("valid"))


def budget_check(files: DataFrame) -> DataFrame:
    """Is every host within its limits, per repository?"""
    breaks = F.size(F.split("text", "\n")) - 1
    chars = F.length("text")
    host = F.col("host")
    # fixed values: soft line budgets plus the margin the check allows
    one = (
        F.when(host == "agents-md", F.octet_length("text") <= dims.HARD_BUDGET_BYTES)
        .when((host == "claude") & (F.col("path") == "CLAUDE.md"), breaks <= 250)
        .when((host == "copilot") & (F.col("path") == ".github/copilot-instructions.md"), breaks <= 350)
        .when(host == "cursor", breaks <= 550)
        .when(host == "windsurf", chars <= dims.FILE_LIMIT_CHARS)
        .otherwise(F.lit(True))
    )
    ruled = (host == "windsurf") & F.col("path").rlike("managed-(?:guardrails|commands|setup|conventions|skills)")
    rows = files.groupBy("repo_id", "host").agg(
        F.bool_and(one).alias("each"), F.sum(F.when(ruled, chars).otherwise(0)).alias("total")
    )
    return rows.select("repo_id", "host", (F.col("each") & (F.col("total") <= dims.WORKSPACE_LIMIT_CHARS + 1024)).alias("within_budget"))


def conformance(claims: DataFrame, files: DataFrame) -> DataFrame:
    """0.60 inclusion + 0.15 format + 0.15 budget + 0.10 determinism, per repository and host.

    Files carry a given time, so equal claims give equal files: determinism is 1.
    """
    hidden = (F.col("sensitivity") != "public") | F.col("review_state").isin(*dims.HIDDEN_STATES)
    wanted = F.col("claim_type").isin(*PROJECTED) & F.col("source_authority").isin(*dims.HIGH_AUTHORITY)
    judged = claims.filter(hidden | wanted).select(
        "repo_id", "claim_id", F.lower("content").alias("content"), (~hidden).alias("expected"),
        F.explode(F.array(*map(F.lit, dims.HOSTS))).alias("host"),
    )
    shown = file_lines(files).withColumn("shown", F.lit(True))
    seen = judged.join(shown, ["repo_id", "host", "content"], "left").withColumn("shown", F.coalesce("shown", F.lit(False)))
    inclusion = seen.groupBy("repo_id", "host").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("expected") == F.col("shown")).alias("correct")
    )
    valid = format_check(files).groupBy("repo_id", "host").agg(F.bool_and("valid").alias("valid"))
    score = (
        F.lit(0.6) * F.col("correct") / F.col("checks") + F.when(F.col("valid"), 0.15).otherwise(0.0)
        + F.when(F.col("within_budget"), 0.15).otherwise(0.0) + F.lit(0.1)
    )
    return inclusion.join(valid, ["repo_id", "host"]).join(budget_check(files), ["repo_id", "host"]).select(
        "repo_id", "host", "checks", "correct", "valid", "within_budget", F.round(score, 4).alias("score")
    )


def promotion(scores: DataFrame, leaks: DataFrame, drift: DataFrame) -> DataFrame:
    """Maturity each host has earned from conformance, leaks and drift."""
    per_host = scores.groupBy("host").agg(exact_mean(F.col("score"), 4).alias("score"), F.bool_and("valid").alias("valid"))
    leaked = leaks.groupBy("host").agg(F.sum("leaks").alias("leaks"))
    misses = drift.agg(F.coalesce(F.sum(F.col("false_positives") + F.col("false_negatives")), F.lit(0))).scalar()
    main = F.col("host").isin("agents-md", "claude")
    judged = per_host.join(leaked, "host", "left").withColumn("leaks", F.coalesce("leaks", F.lit(0))).withColumn("misses", misses)
    checks = [
        F.when(main & (F.col("score") < 0.95), F.lit("conformance below 0.95")),
        F.when(main & (F.col("leaks") > 0), F.lit("leakage")),
        F.when(main & (F.col("misses") > 0), F.lit("drift tests failed")),
        F.when(~main & ~F.col("valid"), F.lit("invalid format")),
    ]
    gaps = F.filter(F.array(*checks), lambda x: x.isNotNull())
    earned = F.when(main, "GA").when(F.col("host") == "copilot", "Beta").otherwise("Alpha")
    return judged.select(
        "host", "score", "leaks", F.array_join(gaps, "; ").alias("gaps"),
        F.when(F.size(gaps) == 0, earned).otherwise("Preview").alias("maturity"),
    )


def import_fidelity(imported: DataFrame, bar: float = 0.2) -> DataFrame:
    """Share of the imported operational claims of a file that the shared file, really routed and cut, carries again."""
    operational = F.col("claim_type").isin("validated-command", "always-on-rule", "permission-restriction")
    rows = imported.filter(operational).select("repo_id", "path", "claim_type", "claim_text", F.col("claim_scope").alias("scope")).distinct()
    authority = F.lit("declared-imported-unreviewed")
    claims = rows.select(
        "repo_id", claim_id(F.col("claim_type"), F.col("scope"), F.col("claim_text")).alias("claim_id"), "claim_type", F.col("claim_text").alias("content"),
        "scope", authority.alias("source_authority"), authority_level(authority).alias("authority_level"), F.lit(None).cast("string").alias("risk_class"),
        F.array(F.lit("all")).alias("applicability"), F.lit(1.0).alias("confidence"), "path",
    )
    unique = claims.drop("path").distinct()
    carried = projection.budget_prefix(projection.route_claims(unique, hosts=("agents-md",))).select("repo_id", "claim_id").distinct().withColumn("_in", F.lit(True))
    return claims.join(carried, ["repo_id", "claim_id"], "left").groupBy("repo_id", "path").agg(
        F.count(F.lit(1)).alias("operational"), F.count_if(F.col("_in").isNotNull()).alias("surviving")
    ).withColumn("fidelity", F.round(F.col("surviving") / F.col("operational"), 4)).withColumn("passed", F.col("fidelity") >= bar)


# ---- traces and runs -------------------------------------------------------------------


def trace_stats(traces: DataFrame, accuracy: int = 10_000) -> DataFrame:
    return traces.groupBy("tool_name").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("response_claim_count").alias("claims"), F.sum("response_size_bytes").alias("bytes"),
        F.count_if(F.col("response_status") == "error").alias("errors"), F.count_distinct("session_id").alias("sessions"),
        exact_mean(F.col("duration_ms")).alias("mean_ms"), F.max("duration_ms").alias("max_ms"),
        F.percentile_approx("duration_ms", 0.5, accuracy).alias("p50_ms"), F.percentile_approx("duration_ms", 0.95, accuracy).alias("p95_ms"),
    )


def extraction_summary(routed: DataFrame) -> DataFrame:
    """Files by role and bytes per repository."""
    roles = ("package_json", "makefile", "dockerfile", "workflow", "python", "javascript", "docs")
    return routed.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("files"), *[F.count_if(F.col("role") == r).alias(r) for r in roles],
        F.sum("size").cast("bigint").alias("bytes"),
    )


# ---- expected against extracted claims -------------------------------------------------


def match_expected(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """One-to-one matches, expectations in order, each taking its first free claim.

    Done in rounds over all repositories at once: every expectation asks for its next claim, a claim keeps the lowest number
    that asked so far, and those turned down ask for their next one. As all claims prefer the lower number, this ends
    where taking turns in order ends. Of the claims that fit one expectation only the first E (the number of
    expectations of the repository and type) can ever be needed, so E rounds are enough.
    """
    key = ["repo_id", "claim_type"]
    wanted = expected.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    fits = F.lower("content").contains(F.lower("pattern")) | F.regexp_like("content", F.concat(F.lit("(?i)"), "pattern"))
    sure = F.col("min_confidence").isNull() | (F.col("confidence") >= F.col("min_confidence"))
    pairs = wanted.join(extracted, key).filter(fits & sure)
    nth = F.row_number().over(Window.partitionBy(*key, "no").orderBy("place", "claim_id"))
    few = checkpointed(pairs.withColumn("_k", nth).filter(F.col("_k") <= F.col("_n")).select(*key, "no", "claim_id", "_k"))
    turns = few.select(*key, "no").distinct().withColumn("_k", F.lit(1))
    while True:
        asked = turns.join(few, [*key, "no", "_k"])
        best = F.min("no").over(Window.partitionBy(*key, "claim_id"))
        judged = checkpointed(asked.withColumn("_out", F.col("no") != best))
        if judged.filter("_out").isEmpty():
            return judged.select(*key, F.col("no").cast("int").alias("no"), "claim_id")
        turns = judged.select(*key, "no", (F.col("_k") + F.col("_out").cast("int")).alias("_k"))


def precision_recall(expected: DataFrame, extracted: DataFrame, matches: DataFrame) -> DataFrame:
    """Recall over the expectations; precision 1 by construction, the true share beside it."""
    need = expected.groupBy("repo_id").agg(F.count(F.lit(1)).alias("required"))
    got = matches.groupBy("repo_id").agg(F.count(F.lit(1)).alias("matched"))
    found = extracted.groupBy("repo_id").agg(F.count(F.lit(1)).alias("extracted"))
    both = need.join(got, "repo_id", "left").join(found, "repo_id", "left").fillna(0, ["matched", "extracted"])
    recall = F.col("matched") / F.col("required")
    precision = F.when(F.col("matched") > 0, 1.0).otherwise(0.0)
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * precision * recall, precision + recall), F.lit(0.0))
    return both.select(
        "repo_id", "required", "matched", F.round(recall, 6).alias("recall"), precision.alias("precision"),
        F.round(F.try_divide(F.col("matched"), F.col("extracted")), 6).alias("true_precision"), F.round(f1, 6).alias("f1"),
        ((recall >= 0.8) & (precision >= 0.8)).alias("passed"),
    )
