"""Scopes, hosts, skills and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta import dims
from attesta.functions.base import authority_level, first_match, lookup


def scope_from_path(path: Column) -> Column:
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(folder == "", "**").otherwise(F.concat(folder, F.lit("/**")))


def host_from_source(source: Column) -> Column:
    return (
        F.when(source == "agents-md", "codex")
        .when(source == "claude-md", "claude")
        .when(source.startswith("copilot-"), "copilot")
        .when(source == "cursor-rules", "cursor")
        .otherwise("unknown")
    )


def instruction_source(path: Column) -> Column:
    """Kind of hand-written instruction file, or null."""
    name = F.element_at(F.split(path, "/"), -1)
    return first_match(
        (
            (name == "AGENTS.md", F.lit("agents-md")),
            (name == "CLAUDE.md", F.lit("claude-md")),
            (path == ".github/copilot-instructions.md", F.lit("copilot-instructions")),
            (
                path.rlike(r"^\.github/instructions/.*\.instructions\.md$"),
                F.lit("copilot-scoped-instructions"),
            ),
            (
                path.isin(
                    ".github/workflows/copilot-setup-steps.yml", ".github/copilot-setup-steps.yml"
                ),
                F.lit("copilot-setup-steps"),
            ),
            (path.startswith(".cursor/rules/") | (path == ".cursorrules"), F.lit("cursor-rules")),
        )
    )


def artifact_type(path: Column) -> Column:
    return first_match(
        (
            (path.endswith(".json"), F.lit("settings-snippet")),
            (path.startswith(".claude/skills/"), F.lit("skill")),
            (path.startswith(".claude/rules/"), F.lit("scoped-rule")),
            (path.startswith(".github/instructions/"), F.lit("scoped-instruction")),
            (path.startswith(".cursor/rules/"), F.lit("cursor-rule")),
            (path.startswith(".windsurf/rules/"), F.lit("windsurf-rule")),
            (path.contains("copilot-setup-steps"), F.lit("setup-steps")),
            (
                path.isin("CLAUDE.md", "AGENTS.md", ".github/copilot-instructions.md"),
                F.lit("instruction-file"),
            ),
        ),
        "projected-file",
    )


def _slashless(scope: Column) -> Column:
    return F.regexp_replace(scope, "^/+|/+$", "")


def scope_key(scope: Column) -> Column:
    slug = F.regexp_replace(F.lower(_slashless(scope)), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.when(slug == "", "general").otherwise(slug)


def scope_glob(scope: Column) -> Column:
    bare = _slashless(scope)
    return F.when(bare.contains("*"), bare).otherwise(F.concat(bare, F.lit("/**")))


def deny_pattern(content: Column) -> Column:
    command = F.regexp_extract(content, "`([^`]+)`", 1)
    return F.when(command != "", F.concat(F.lit("Bash("), command, F.lit("*)")))


def primary_tag(tags: Column) -> Column:
    return F.coalesce(F.get(F.filter(tags, lambda t: t != "all"), 0), F.lit("general"))


def skill_name(tag: Column) -> Column:
    mapped = F.coalesce(lookup(tag, dims.SKILL_BY_TAG), tag)
    slug = F.regexp_replace(F.lower(mapped), "[^a-z0-9-]+", "-")
    slug = F.regexp_replace(F.regexp_replace(slug, "-+", "-"), "^-|-$", "")
    return F.when(slug.rlike("^[a-z][a-z0-9-]*$"), F.substring(slug, 1, 64)).otherwise("general")


def high_value(confidence: Column, authority: Column) -> Column:
    return (confidence >= 0.9) & (authority_level(authority) <= 30)


def dotted_module(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, "^src/", ""), F.lit("/"), F.lit("."))


def import_candidate(path: Column, module: Column, level: Column) -> Column:
    """Dotted name an import statement points at; ``level`` counts the leading dots."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    folders = F.when(
        F.get(folders, 0) == "src", F.slice(folders, F.lit(2), F.greatest(F.size(folders) - 1, F.lit(0)))
    ).otherwise(folders)
    keep = F.greatest(F.size(folders) - level + 1, F.lit(0))
    base = F.array_join(F.slice(folders, F.lit(1), keep), ".")
    relative = F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(module, F.lit("")))
    return F.when(level > 0, relative).otherwise(module)


def enforceable(claim_type: Column, confidence: Column, content: Column) -> Column:
    low = F.lower(content)
    return (
        (claim_type == "permission-restriction")
        & (confidence >= 0.95)
        & (low.contains("destructive") | low.contains("require explicit confirmation"))
    )


def safe_path(path: Column) -> Column:
    """False for a NUL byte or a path that climbs out of its root."""
    # -1000000 keeps a path that once left the root below zero for good
    depth = F.aggregate(
        F.split(F.regexp_replace(path, "^/.*$", "../.."), "/"),
        F.lit(0),
        lambda d, part: F.when(part == "..", F.when(d <= 0, -1_000_000).otherwise(d - 1))
        .when(part.isin("", "."), d)
        .otherwise(d + 1),
    )
    return ~path.contains("\x00") & (depth >= 0)


def glob_regex(glob: str) -> str:
    """fnmatch pattern as an anchored regex (a parameter, so built on the driver)."""
    out = ""
    for ch in glob:
        out += {"*": ".*", "?": "."}.get(ch) or ("\\" + ch if not ch.isalnum() and ch != "_" else ch)
    return f"(?s)^{out}$"
