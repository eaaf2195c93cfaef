"""From governed claims to per-host instruction files.

A file is first a relation of lines ``(repo_id, host, path, section, rank, text)``.
Budgets are decided on the lines before anything is gathered; what is left of a file
is one text, whole whatever its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta import dims
from attesta.functions import codecs
from attesta.functions.base import lookup
from attesta.functions.scopes import (
    deny_pattern,
    enforceable,
    primary_tag,
    high_value,
    scope_glob,
    scope_key,
    skill_name,
)
from attesta.operators.ordering import STABLE, top_k
from attesta.session import checkpointed

CLAIM_KEY = ["repo_id", "claim_id"]
RULES = ("always-on-rule", "scoped-rule")
PREFIX = "managed"
SECTION_ORDER = {"commands": 0, "conventions": 1, "guardrails": 2, "setup": 3, "skills": 4}


# ---- routing ---------------------------------------------------------------------------


def with_hosts(claims: DataFrame, hosts: tuple[str, ...] = tuple(dims.HOSTS)) -> DataFrame:
    """Every claim once per host (a fixed, small number)."""
    return claims.withColumn("host", F.explode(F.array(*map(F.lit, hosts))))


def route_claims(claims: DataFrame, hosts: tuple[str, ...] = tuple(dims.HOSTS)) -> DataFrame:
    """(section, destination, reason) of every claim per host: one decision table.

    Claims a host does not project have no row.
    """
    rows = with_hosts(claims, hosts)
    host, kind = F.col("host"), F.col("claim_type")
    rule, scoped = kind.isin(*RULES), F.col("scope") != "**"
    high = F.col("source_authority").isin(*dims.HIGH_AUTHORITY)
    broad = (F.size("applicability") == 0) | F.array_contains("applicability", "all")
    claude, rule_files = host == "claude", host.isin("cursor", "windsurf")
    key = scope_key(F.col("scope"))

    def verdict(section: str, destination: Column | str, reason: str) -> Column:
        to = destination if isinstance(destination, Column) else F.lit(destination)
        return F.struct(F.lit(section).alias("section"), to.alias("destination"), F.lit(reason).alias("reason"))

    main = lookup(host, {"agents-md": "AGENTS.md", "claude": "claude.md", "copilot": "copilot-instructions.md"})
    main = F.coalesce(main, F.lit("rules"))
    decision = (
        # shared file: commands and trusted rules only
        F.when((host == "agents-md") & (kind == "validated-command"), verdict("commands", main, "shared file lists commands"))
        .when((host == "agents-md") & rule & high, verdict("conventions", main, "shared file lists trusted rules"))
        .when(host == "agents-md", None)
        # scoped claims
        .when(claude & scoped & (rule | (kind == "permission-restriction")), verdict("scoped", F.concat(F.lit("rules/"), "scope"), "rule file of its scope"))
        .when((host == "copilot") & scoped & rule, verdict("scoped", F.concat(F.lit("instructions/"), "scope"), "instruction file of its scope"))
        .when(rule_files & scoped & rule, verdict("scoped", F.concat(F.lit(f"rules/{PREFIX}-"), key), "rule file of its scope"))
        # skills
        .when(claude & kind.isin("skill-playbook", "scoped-rule") & ~broad, verdict("skills", "skills", "tags name a task, so a skill"))
        .when(claude & (kind == "skill-playbook"), verdict("skills", "skills", "playbooks are skills"))
        .when(claude & rule & ~high, verdict("skills", "skills", "rule without authority, so a skill"))
        .when((host == "windsurf") & (kind == "skill-playbook"), verdict("excluded", "excluded", "host has no place for playbooks"))
        .when((host == "cursor") & (kind == "skill-playbook"), verdict("skills", main, "host keeps playbooks as rules"))
        # environment
        .when((host == "copilot") & (kind == "environment-prerequisite"), verdict("setup", "setup-steps", "set-up steps install it"))
        .when(rule_files & (kind == "environment-prerequisite"), verdict("setup", main, "host keeps prerequisites as rules"))
        # always-on content
        .when(kind == "validated-command", verdict("commands", main, "always-on commands"))
        .when(rule & high, verdict("conventions", main, "always-on rules"))
        .when(rule, verdict("excluded", "excluded", "rule without authority"))
        .when(kind == "permission-restriction", verdict("guardrails", main, "always-on guardrails"))
    )
    return rows.withColumn("d", decision).filter("d IS NOT NULL").select("*", "d.section", "d.destination", "d.reason").drop("d")


# ---- budgets ---------------------------------------------------------------------------


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text)


def command_line(content: Column) -> Column:
    return F.concat(F.lit("- `"), content, F.lit("`"))


def plain_line(content: Column) -> Column:
    return F.concat(F.lit("- "), content)


def budget_prefix(routed: DataFrame, header_bytes: int = 0, budget: int = dims.HARD_BUDGET_BYTES) -> DataFrame:
    """Longest prefix (commands, then rules, each in stable order) whose rendered bytes fit.

    A section or risk heading is paid by its first line. Every line costs at least four
    bytes, so rows beyond ``budget / 4`` cannot fit and are cut before the shuffle.
    """
    most = budget // 4
    section = F.when(F.col("section") == "commands", 0).otherwise(1)
    risk = F.coalesce("risk_class", F.lit("build"))
    rows = routed.filter("host = 'agents-md'").withColumn("_sec", section).withColumn("_risk", F.when(section == 0, risk))
    order = ["_sec", *STABLE]
    ahead = rows.withColumn("_n", F.row_number().over(Window.partitionBy("repo_id").orderBy(*order)))
    head = ahead.filter(F.col("_n") <= most)
    first_of = F.row_number().over(Window.partitionBy("repo_id", "_sec", "_risk").orderBy("_n")) == 1
    first_sec = F.row_number().over(Window.partitionBy("repo_id", "_sec").orderBy("_n")) == 1
    label = F.length(lookup(F.col("_risk"), dims.RISK_LABEL))
    line = utf8_bytes(F.col("content")) + F.when(F.col("_sec") == 0, 5).otherwise(3)
    heading = F.when(F.col("_sec") == 0, F.when(first_of, label + 7).otherwise(0) + F.when(first_sec, 12).otherwise(0)).otherwise(
        F.when(first_sec, 16).otherwise(0)
    )
    running = Window.partitionBy("repo_id").orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fit = head.withColumn("cost", line + heading).withColumn("used", F.sum("cost").over(running) + header_bytes)
    return fit.filter(F.col("used") <= budget).drop("_sec", "_risk", "_n", "cost", "used")


def with_verdict(rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """All rows with ``included``, for reports on what a budget left out."""
    flags = kept.select(*keys).withColumn("_in", F.lit(True))
    return rows.join(flags, keys, "left").withColumn("included", F.coalesce("_in", F.lit(False))).drop("_in")


def greedy_fill(
    items: DataFrame,
    keys: list[str],
    size: str,
    order: list[str],
    budget: int,
    start: int = 0,
    section: str | None = None,
    section_cost: int = 0,
) -> DataFrame:
    """Rows that fit when items are tried in order and misfits are skipped.

    Of equal-sized items (in one section) only the first ``budget / size`` can ever fit:
    room never grows, so once one of them is refused the later ones are too. That bound
    holds the array each group is folded over, whatever the size of the group. The fold
    is one pass over sizes and sections (an Arrow helper); items of size 0 always fit.
    """
    room = budget - start
    if section is None and room >= 0:
        free = items.filter(F.col(size) == 0)
    else:
        free = items.filter(F.lit(False))
    items = items.filter(F.col(size) > 0) if section is None else items
    same = [*keys, size, *([section] if section else [])]
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(*order))
    able = items.filter((F.col(size) >= 0) & (F.col(size) <= room)).withColumn("_n", nth)
    # the literal bound is cut before the shuffle, the exact one after it
    able = able.filter(F.col("_n") <= room).filter(F.col("_n") * F.col(size) <= room).drop("_n")
    rest = [c for c in items.columns if c not in keys and c not in order]
    part = F.col(section) if section else F.lit("")
    item = F.struct(*order, part.alias("_section"), F.struct(*order, *rest).alias("_row"))
    packed = able.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    sizes, sections = F.transform("_items", lambda i: i._row[size].cast("bigint")), F.transform("_items", lambda i: i._section)
    fits = codecs.first_fit(sizes, sections, F.lit(budget).cast("bigint"), F.lit(start).cast("bigint"), F.lit(section_cost).cast("bigint"))
    folded = packed.select(*keys, "_items", fits.alias("_flags"))
    taken = F.filter(F.arrays_zip("_items", "_flags"), lambda z: z["_flags"])
    fitted = folded.select(*keys, F.explode(taken).alias("_z")).select(*keys, "_z._items._row.*")
    return fitted.unionByName(free.select(*fitted.columns))


def _sized(routed: DataFrame, hosts: tuple[str, ...]) -> DataFrame:
    rows = routed.filter(F.col("host").isin(*hosts) & (F.col("section") != "excluded"))
    return rows.withColumn("bytes", utf8_bytes(F.col("content"))).withColumn("worth", -F.col("confidence"))


def budget_greedy(routed: DataFrame, budget: int, hosts: tuple[str, ...] = ("windsurf",)) -> DataFrame:
    """Claims in (authority, confidence) order against a byte budget; misfits are skipped."""
    items = _sized(routed, hosts)
    kept = greedy_fill(items, ["repo_id", "host"], "bytes", ["authority_level", "worth", "claim_id"], budget)
    return with_verdict(items, kept, ["repo_id", "host", "claim_id"]).withColumn(
        "budget_reason", F.when(F.col("included"), "within budget").otherwise("exceeded hard budget")
    )


def _always_on(routed: DataFrame) -> DataFrame:
    rows = routed.filter("host = 'claude' AND section IN ('commands', 'conventions', 'guardrails')")
    return rows.withColumn("section_rank", lookup(F.col("section"), SECTION_ORDER)).withColumn(
        "lines", F.size(F.split("content", "\n")) + 1
    )


def line_budget(routed: DataFrame, soft_lines: int = 200, reserve: int = 15, first_lines: int = 3) -> DataFrame:
    """Always-on rows within the soft line budget; a section costs three more lines at first."""
    return greedy_fill(
        _always_on(routed), ["repo_id"], "lines", ["section_rank", *STABLE], soft_lines - reserve, first_lines, "section", 3
    ).drop("section_rank", "lines")


def line_budget_overflow(routed: DataFrame, soft_lines: int = 200) -> DataFrame:
    """Every always-on row with its final destination: rows past the budget go to skills."""
    out = with_verdict(_always_on(routed), line_budget(routed, soft_lines), CLAIM_KEY)
    return out.withColumn("destination", F.when(F.col("included"), F.col("destination")).otherwise("skills")).withColumn(
        "reason", F.when(F.col("included"), F.col("reason")).otherwise("budget overflow from always-on file")
    )


def workspace_fit(files: DataFrame, per_file: int = dims.FILE_LIMIT_CHARS, total: int = dims.WORKSPACE_LIMIT_CHARS) -> DataFrame:
    """Whole files in priority order, each and together within their limits; misfits are skipped.

    ``files`` has (repo_id, path, priority, chars): sizes, not texts.
    """
    return greedy_fill(files.filter(F.col("chars") <= per_file), ["repo_id"], "chars", ["priority", "path"], total)


def workspace_budget(files: DataFrame, per_file: int = dims.FILE_LIMIT_CHARS, total: int = dims.WORKSPACE_LIMIT_CHARS) -> DataFrame:
    out = with_verdict(files, workspace_fit(files, per_file, total), ["repo_id", "path"])
    reason = (
        F.when(F.col("included"), "included").when(F.col("chars") > per_file, "file exceeds per-file limit").otherwise("workspace budget exceeded")
    )
    return out.withColumn("reason", reason)


def overflow_report(decided: DataFrame) -> DataFrame:
    """Used bytes and lines, included and omitted counts per repository and host."""
    size = utf8_bytes(F.col("content"))
    return decided.groupBy("repo_id", "host").agg(
        F.count_if("included").alias("included"), F.count_if(~F.col("included")).alias("omitted"),
        F.sum(F.when(F.col("included"), size).otherwise(0)).alias("used_bytes"),
        F.sum(F.when(F.col("included"), F.size(F.split("content", "\n"))).otherwise(0)).alias("used_lines"),
    )


def without_shared(routed: DataFrame, shared: DataFrame) -> DataFrame:
    """Drop claims the shared file already carries."""
    return routed.join(shared.select(*CLAIM_KEY).distinct(), CLAIM_KEY, "left_anti")


# ---- lines -----------------------------------------------------------------------------


def _head(section: int | Column, group: int | Column, kind: int, text: str | Column) -> Column:
    """A line that belongs to a file, section or group rather than to one claim."""
    def column(value: object) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    return F.struct(
        column(section).cast("int").alias("section_no"), column(group).cast("int").alias("group_no"), F.lit(kind).alias("kind_no"),
        F.lit(0).alias("authority_level"), F.lit("").alias("scope"), F.lit("").alias("claim_type"), F.lit("").alias("claim_id"),
        column(text).alias("text"),
    )


def _lines(rows: DataFrame, path: Column, section: int, group: Column, text: Column, heads: list[Column]) -> DataFrame:
    """Claim lines and the heading lines they need, in one pass.

    The sort key is (section, group, kind, level, scope, type, id). Headings repeat per
    claim here and are folded by :func:`_folded` before anything is moved.
    """
    own = F.struct(
        F.lit(section).alias("section_no"), group.cast("int").alias("group_no"), F.lit(1).alias("kind_no"),
        "authority_level", "scope", "claim_type", "claim_id", text.alias("text"),
    )
    line = F.explode(F.array(own, *heads)).alias("l")
    return rows.select("repo_id", "host", path.alias("path"), line).select("repo_id", "host", "path", "l.*").filter("text IS NOT NULL")


def _folded(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def always_on_lines(decided: DataFrame) -> DataFrame:
    """Lines of the shared file and of the first host, from rows already within budget.

    Commands stand under one heading per risk.
    """
    path = lookup(F.col("host"), {"agents-md": "AGENTS.md", "claude": "CLAUDE.md"})
    order = lookup(F.coalesce("risk_class", F.lit("build")), dims.RISK_ORDER, 99)
    label = F.concat(F.lit("### "), lookup(F.coalesce("risk_class", F.lit("build")), dims.RISK_LABEL, "Other"))
    command = _lines(
        decided.filter("section = 'commands'"), path, 0, order, command_line(F.col("content")),
        [_head(0, -1, 0, "## Commands"), _head(0, order, 0, label)],
    )
    plain = [
        _lines(decided.filter(F.col("section") == name), path, no, F.lit(0), plain_line(F.col("content")), [_head(no, -1, 0, f"## {title}")])
        for no, name, title in ((1, "conventions", "Conventions"), (2, "guardrails", "Guardrails"))
    ]
    return _folded([command, *plain])


def thin_lines(routed: DataFrame) -> DataFrame:
    """Thin always-on file: restrictions (destructive first), key commands, ten rules, five notes."""
    rows = routed.filter("host = 'copilot'")
    path, none = F.lit(".github/copilot-instructions.md"), F.lit(0)
    destructive = F.lower("content").contains("destructive")
    warn = F.when(destructive, F.concat(F.lit("- **WARNING**: "), "content")).otherwise(plain_line(F.col("content")))
    key = F.col("risk_class").isin("test-execution", "safe-readonly") | F.arrays_overlap("applicability", F.array(*map(F.lit, ("test", "lint", "build"))))
    stable = [F.col(c) for c in STABLE]
    rules = top_k(rows.filter("section = 'conventions'"), ["repo_id"], stable, 10)
    notes = top_k(rows.filter("section = 'setup'"), ["repo_id"], stable, 5)
    plain = plain_line(F.col("content"))
    return _folded([
        _lines(rows.filter("section = 'guardrails'"), path, 0, F.when(destructive, 0).otherwise(1), warn, [_head(0, -1, 0, "## Restrictions")]),
        _lines(rows.filter("section = 'commands'").filter(F.coalesce(key, F.lit(False))), path, 1, none, command_line(F.col("content")), [_head(1, -1, 0, "## Key Commands")]),
        _lines(rules, path, 2, none, plain, [_head(2, -1, 0, "## Critical Conventions")]),
        _lines(notes, path, 3, none, plain, [_head(3, -1, 0, "## Environment")]),
    ])


def _front(trigger: Column) -> list[Column]:
    return [_head(0, -2, 0, "---"), _head(0, -1, 0, trigger), _head(0, 9, 2, "---")]


def scoped_lines(routed: DataFrame) -> DataFrame:
    """One rule file per scope key, its paths or globs in the front block."""
    keyed = routed.filter("section = 'scoped'").withColumn("_slug", scope_key(F.col("scope")))
    # scopes that shorten to one name: the first keeps it, the others carry a part of their hash
    firsts = keyed.groupBy("repo_id", "host", "_slug").agg(F.min("scope").alias("_first"))
    own = F.concat("_slug", F.lit("-"), F.substring(F.sha2("scope", 256), 1, 8))
    rows = keyed.join(firsts, ["repo_id", "host", "_slug"]).withColumn("_key", F.when(F.col("scope") == F.col("_first"), F.col("_slug")).otherwise(own))
    host = F.col("host")
    path = (
        F.when(host == "claude", F.concat(F.lit(".claude/rules/"), "_key", F.lit(".md")))
        .when(host == "copilot", F.concat(F.lit(".github/instructions/"), "_key", F.lit(".instructions.md")))
        .when(host == "cursor", F.concat(F.lit(f".cursor/rules/{PREFIX}-"), "_key", F.lit(".md")))
        .otherwise(F.concat(F.lit(f".windsurf/rules/{PREFIX}-"), "_key", F.lit(".md")))
    )
    field = (
        F.when(host == "claude", F.concat(F.lit("  - "), "scope"))
        .when(host == "copilot", F.concat(F.lit("applyTo: "), "scope"))
        .when(host == "cursor", F.concat(F.lit("globs: "), scope_glob(F.col("scope"))))
        .otherwise(F.concat(F.lit("glob: "), scope_glob(F.col("scope"))))
    )
    trigger = F.when(host == "windsurf", "trigger: glob").when(host == "cursor", "alwaysApply: false").when(host == "claude", "paths:")
    heads = [*_front(trigger), _head(0, 0, 1, field)]
    return _folded([_lines(rows, path, 1, F.lit(0), plain_line(F.col("content")), heads)])


# ---- skills ----------------------------------------------------------------------------


def skill_groups(candidates: DataFrame) -> DataFrame:
    """Final skill of every candidate: small groups drop out, beyond ten the rest merge."""
    named = candidates.withColumn("skill", skill_name(primary_tag(F.col("applicability"))))
    sizes = named.groupBy("repo_id", "skill").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(high_value(F.col("confidence"), F.col("source_authority"))).alias("valued")
    ).filter("n >= 2 OR valued > 0")
    return named.join(skill_consolidation(sizes), ["repo_id", "skill"])


def skill_consolidation(sizes: DataFrame) -> DataFrame:
    """Beyond ten groups of a repository the nine largest stay and the others become one."""
    by_size = Window.partitionBy("repo_id").orderBy(F.col("n").desc(), "skill")
    ranked = sizes.withColumn("_rank", F.row_number().over(by_size)).withColumn("_groups", F.count(F.lit(1)).over(Window.partitionBy("repo_id")))
    over = (F.col("_groups") > dims.MAX_SKILLS) & (F.col("_rank") >= dims.MAX_SKILLS)
    return ranked.select("repo_id", "skill", F.when(over, "general").otherwise(F.col("skill")).alias("final_skill"))


def skill_lines(grouped: DataFrame, limit: int | None = None) -> DataFrame:
    """Lines of the skill files with their place ``_n`` and the characters before them; only those a limit can reach."""
    order = {t: i for i, t in enumerate(("validated-command", "always-on-rule", "scoped-rule", "permission-restriction", "skill-playbook", "environment-prerequisite", "module-boundary", "conflict"))}
    risk = F.when(F.col("risk_class").isNotNull(), F.concat(F.lit(" ["), "risk_class", F.lit("]"))).otherwise("")
    text = F.when(F.col("claim_type") == "validated-command", F.concat(command_line(F.col("content")), risk)).otherwise(plain_line(F.col("content")))
    rows = grouped.withColumn("type_no", lookup(F.col("claim_type"), order, 99)).withColumn("text", text)
    if limit is None:
        return rows
    by = Window.partitionBy("repo_id", "final_skill").orderBy("type_no", "authority_level", "claim_id")
    # a line has at least two characters and a line end
    head = rows.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= (limit + 1) // 3 + 1)
    before = F.coalesce(F.sum(F.length("text") + 1).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return head.withColumn("_before", before).filter(F.col("_before") <= limit + 1)


def skill_shown(grouped: DataFrame, limit: int | None = None) -> DataFrame:
    """The candidates whose line is whole in a skill file: under a limit, those that end before its cut."""
    lines = skill_lines(grouped, limit)
    if limit is None:
        return lines
    end = F.col("_before") + F.length("text")
    size = F.max(end).over(Window.partitionBy("repo_id", "final_skill"))
    return lines.withColumn("_size", size).filter((F.col("_size") <= limit) | (end <= limit - 3))


def skill_bodies(grouped: DataFrame, limit: int | None = None) -> DataFrame:
    """Skill text per repository, whole; cut only where a caller gives a limit, and lines past it are not gathered."""
    key = ["repo_id", "final_skill"]
    order = ["_n"] if limit is not None else ["type_no", "authority_level", "claim_id"]
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda s: s.text), "\n")
    bodies = skill_lines(grouped, limit).groupBy(*key).agg(body.alias("body"))
    cut = F.col("body") if limit is None else F.when(F.length("body") > limit, F.concat(F.substring("body", 1, limit - 3), F.lit("..."))).otherwise(F.col("body"))
    title = F.initcap(F.replace("final_skill", F.lit("-"), F.lit(" ")))
    front = F.concat(F.lit("---\nname: "), "final_skill", F.lit("\ndescription: How to "), F.lower(title), F.lit(" in this repository.\n---\n\n# "), title, F.lit("\n\n"), cut, F.lit("\n"))
    return bodies.select("repo_id", F.lit("claude").alias("host"), F.concat(F.lit(".claude/skills/"), "final_skill", F.lit("/SKILL.md")).alias("path"), front.alias("text"))


# ---- settings, setup steps, texts ------------------------------------------------------


def deny_rows(routed: DataFrame) -> DataFrame:
    flag = enforceable(F.col("claim_type"), F.col("confidence"), F.col("content"))
    rows = routed.filter("host = 'claude' AND section IN ('guardrails', 'scoped')").filter(flag)
    return rows.select("repo_id", deny_pattern(F.col("content")).alias("pattern")).filter("pattern IS NOT NULL").distinct()


def ordered_lists(rows: DataFrame, keys: list[str], item: str, order: list[str]) -> DataFrame:
    """Ordered list of the items of each group: the content of one generated file, complete."""
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("_item")))).alias("_l"))
    return lists.select(*keys, F.size("_l").cast("long").alias("items"), F.transform("_l", lambda s: s._item).alias("list"))


def deny_settings(routed: DataFrame) -> DataFrame:
    """Settings document with the sorted deny patterns of each repository."""
    lists = ordered_lists(deny_rows(routed), ["repo_id"], "pattern", ["pattern"])
    doc = F.to_json(F.struct(F.struct(F.col("list").alias("deny")).alias("permissions")))
    return lists.select("repo_id", F.lit(".claude/settings-snippet.json").alias("path"), doc.alias("text"))


def setup_steps(claims: DataFrame) -> DataFrame:
    """Set-up workflow of each repository: runtimes, then install commands, as JSON (which is YAML)."""
    # fixed values: action, input and label per runtime, in output order
    actions = (
        ("actions/setup-go@v5", "go-version", "Go"), ("actions/setup-java@v4", "java-version", "Java"),
        ("actions/setup-node@v4", "node-version", "Node.js"), ("actions/setup-python@v5", "python-version", "Python"),
        ("actions/setup-ruby@v1", "ruby-version", "Ruby"),
    )
    text, stable = F.col("content"), F.struct(*STABLE)
    prereq = F.col("claim_type") == "environment-prerequisite"

    def version(label: str) -> Column:
        found = F.regexp_extract(text, rf"(?i){label.replace('.', '[.]')}\s+([0-9][0-9.]*)", 1)
        return F.when(prereq & (found != ""), found)

    runtimes = claims.groupBy("repo_id").agg(*[
        F.max_by(version(label), F.when(version(label).isNotNull(), stable)).alias(key.replace("-", "_")) for _, key, label in actions
    ])
    wanted = (F.col("claim_type") == "validated-command") & (F.array_contains("applicability", "setup") | F.lower(text).contains("install"))
    runs = ordered_lists(claims.filter(wanted).distinct(), ["repo_id"], "content", STABLE).select("repo_id", "list")
    uses = F.array(F.to_json(F.struct(F.lit("actions/checkout@v4").alias("uses"))))
    setup = F.filter(
        F.array(*[
            F.when(
                F.col(key.replace("-", "_")).isNotNull(),
                F.concat(F.lit('{"uses":"' + action + '","with":{"' + key + '":"'), F.col(key.replace("-", "_")), F.lit('"}}')),
            )
            for action, key, _ in actions
        ]),
        lambda x: x.isNotNull(),
    )
    install = F.transform(
        F.coalesce("list", F.array().cast("array<string>")),
        lambda c: F.to_json(F.struct(F.lit("Install dependencies").alias("name"), c.alias("run"))),
    )
    steps = F.array_join(F.concat(uses, setup, install), ",")
    doc = F.concat(
        F.lit('{"name":"Setup Steps","on":"workflow_dispatch","jobs":{"' + dims.SETUP_JOB + '":{"runs-on":"ubuntu-latest","timeout-minutes":30,"steps":['),
        steps, F.lit("]}}}"),
    )
    return runtimes.join(runs, "repo_id", "left").select("repo_id", F.lit(".github/workflows/copilot-setup-steps.yml").alias("path"), doc.alias("text"))


LINE_ORDER = ["section_no", "group_no", "kind_no", "authority_level", "scope", "claim_type", "claim_id"]


def assemble(lines: DataFrame, as_of: str) -> DataFrame:
    """Texts of the files, behind a header with a given time."""
    lists = ordered_lists(lines, ["repo_id", "host", "path"], "text", LINE_ORDER)
    header = F.concat(F.lit("<!-- Generated from claims | repo: "), "repo_id", F.lit(f" | timestamp: {as_of} | DO NOT EDIT -->"))
    front = F.get("list", 0) == "---"
    text = F.when(front, F.array_join("list", "\n")).otherwise(F.concat(header, F.lit("\n\n"), F.array_join("list", "\n")))
    return lists.select("repo_id", "host", "path", F.col("items").alias("lines"), F.concat(text, F.lit("\n")).alias("text"))


def skill_list_lines(grouped: DataFrame) -> DataFrame:
    """Section of the first host's always-on file that names its skills."""
    names = grouped.select("repo_id", F.lit("claude").alias("host"), F.lit("CLAUDE.md").alias("path"), F.col("final_skill").alias("scope")).distinct()
    line = F.struct(
        F.lit(4).alias("section_no"), F.lit(0).alias("group_no"), F.lit(1).alias("kind_no"), F.lit(0).alias("authority_level"), F.col("scope"),
        F.lit("").alias("claim_type"), F.lit("").alias("claim_id"), F.concat(F.lit("- "), "scope", F.lit(": .claude/skills/"), "scope", F.lit("/SKILL.md")).alias("text"),
    )
    rows = names.select("repo_id", "host", "path", F.explode(F.array(line, _head(4, -1, 0, "## Skills"))).alias("l"))
    return _folded([rows.select("repo_id", "host", "path", "l.*")])


def project(claims: DataFrame, as_of: str, min_confidence: float = 0.0) -> DataFrame:
    """All files of all hosts for claims that passed the output gate."""
    return project_with_decisions(claims, as_of, min_confidence)[0]


def project_with_decisions(claims: DataFrame, as_of: str, min_confidence: float = 0.0, skill_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Files of all hosts, and for every claim and host whether a file shows it or why none does.

    Rows past the line budget of the first host become skill candidates; the last host leaves out what the shared file
    carries. The routed claims feed all renderers and the lines are read twice, so both are written once.
    """
    able = claims.filter(F.col("confidence") >= min_confidence)
    routed = checkpointed(route_claims(able))
    shared, always = budget_prefix(routed), line_budget(routed)
    candidates = routed.filter("host = 'claude' AND section = 'skills'").unionByName(
        with_verdict(_always_on(routed), always, CLAIM_KEY).filter("NOT included").select(*routed.columns)
    )
    grouped = checkpointed(skill_groups(candidates))
    own = routed.filter("host <> 'windsurf'").unionByName(without_shared(routed.filter("host = 'windsurf'"), shared))
    parts = [always_on_lines(shared.unionByName(always)), skill_list_lines(grouped), thin_lines(own), scoped_lines(own), rule_file_lines(own)]
    lines = checkpointed(reduce(DataFrame.unionByName, parts))
    whole = [
        skill_bodies(grouped, skill_limit), deny_settings(routed).withColumn("host", F.lit("claude")),
        setup_steps(able).withColumn("host", F.lit("copilot")),
    ]
    texts = reduce(DataFrame.unionByName, [w.select("repo_id", "host", "path", "text") for w in whole])
    files = assemble(lines, as_of).unionByName(texts.withColumn("lines", F.size(F.split("text", "\n")).cast("long") - 1))
    return files, _decisions(claims, routed, shared, lines, grouped, min_confidence, skill_limit)


def _decisions(claims: DataFrame, routed: DataFrame, shared: DataFrame, lines: DataFrame, grouped: DataFrame, min_confidence: float, skill_limit: int | None = None) -> DataFrame:
    """(repo_id, claim_id, host, included, path, reason): one row per claim and host."""
    key = [*CLAIM_KEY, "host"]
    in_lines = lines.filter("claim_id <> ''").select(*key, "path")
    in_skills = skill_shown(grouped, skill_limit).select(*CLAIM_KEY, F.lit("claude").alias("host"), F.concat(F.lit(".claude/skills/"), "final_skill", F.lit("/SKILL.md")).alias("path"))
    shown = in_lines.unionByName(in_skills).groupBy(*key).agg(F.min("path").alias("path"))
    carried = shared.select(*CLAIM_KEY, F.lit("windsurf").alias("host")).distinct().withColumn("carried", F.lit(True))
    skilled = grouped.select(*CLAIM_KEY, F.lit("claude").alias("host")).distinct().withColumn("skilled", F.lit(True))
    rows = (
        with_hosts(claims.select(*CLAIM_KEY, "confidence")).join(routed.select(*key, "section", "reason"), key, "left")
        .join(shown, key, "left").join(carried, key, "left").join(skilled, key, "left")
    )
    host, section = F.col("host"), F.col("section")
    why = (
        F.when(F.col("path").isNotNull(), F.col("reason"))
        .when(F.col("confidence") < min_confidence, "confidence below the limit")
        .when(section.isNull(), "host does not show claims of this type")
        .when(section == "excluded", F.col("reason"))
        .when(F.col("carried"), "carried by the shared file")
        .when(host == "agents-md", "beyond the budget of the shared file")
        .when(F.col("skilled"), "beyond the limit of the skill file")
        .when((host == "claude") & (section != "scoped"), "skill group too small")
        .when(host == "copilot", "not among the entries of the thin file")
        .otherwise("beyond the budget of the workspace")
    )
    return rows.select(*CLAIM_KEY, "host", F.col("path").isNotNull().alias("included"), "path", why.alias("reason"))


def rule_files(routed: DataFrame) -> DataFrame:
    """Rows of the two hosts that keep one rule file per section, with path and priority."""
    # fixed values: priority of the sections
    priority = {"guardrails": 0, "commands": 1, "setup": 2, "conventions": 3, "skills": 4}
    rows = routed.filter(F.col("host").isin("cursor", "windsurf") & F.col("section").isin(*priority))
    path = F.concat(F.lit("."), "host", F.lit(f"/rules/{PREFIX}-"), "section", F.lit(".md"))
    line = F.when(F.col("section") == "commands", command_line(F.col("content"))).otherwise(plain_line(F.col("content")))
    return rows.withColumn("path", path).withColumn("priority", lookup(F.col("section"), priority)).withColumn("line", line)


def rule_file_sizes(rows: DataFrame) -> DataFrame:
    """Characters each rule file would have, without building it."""
    return rows.groupBy("repo_id", "host", "path", "priority").agg(F.sum(F.length("line") + 1).alias("chars"))


def rule_file_lines(routed: DataFrame) -> DataFrame:
    rows = rule_files(routed)
    sizes = rule_file_sizes(rows)
    fits = workspace_fit(sizes.filter("host = 'windsurf'")).select("repo_id", "path")
    kept = rows.filter("host = 'cursor'").unionByName(rows.filter("host = 'windsurf'").join(fits, ["repo_id", "path"], "left_semi"))
    trigger = F.when(F.col("host") == "windsurf", "trigger: always_on").otherwise("alwaysApply: true")
    return _folded([_lines(kept, F.col("path"), 1, F.lit(0), F.col("line"), _front(trigger))])


def plan_apply(files: DataFrame, disk: DataFrame, managed: DataFrame) -> DataFrame:
    """new / updated / unchanged per file, and whether a managed file was edited by hand."""
    hashes = managed.select("repo_id", "path", "expected_hash")
    action = (
        F.when(F.col("disk_hash").isNull(), "new").when(F.col("disk_hash") == F.col("new_hash"), "unchanged").otherwise("updated")
    )
    edited = F.coalesce(F.col("disk_hash") != F.col("expected_hash"), F.lit(False))
    return (
        files.join(disk, ["repo_id", "path"], "left")
        .join(hashes, ["repo_id", "path"], "left")
        .select("repo_id", "path", action.alias("action"), edited.alias("hand_edited"))
    )
