"""Small Column helpers shared by the jobs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta import dims


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when any word occurs; one regex pass instead of one pass per word."""
    return text.rlike("|".join(re.escape(w) for w in words))


def first_match(pairs: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """Ordered rule table: value of the first condition that holds."""
    out = None
    for cond, value in pairs:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(F.lit(default) if not isinstance(default, Column) else default)


def lookup(col: Column, table: Mapping[str, object], default: object = None) -> Column:
    return first_match(((col == key, F.lit(value)) for key, value in table.items()), default)


def kept(values: Iterable[Column]) -> Column:
    """Array of the non-null values, in order."""
    return F.filter(F.array(*values), lambda x: x.isNotNull())


def claim_id(claim_type: Column, scope: Column, content: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", claim_type, scope, content), 256)
    return F.concat(F.lit("claim-"), F.substring(digest, 1, 16))


def authority_level(authority: Column) -> Column:
    return lookup(authority, dims.AUTHORITY_LEVEL)


def sensitivity_rank(sensitivity: Column) -> Column:
    return lookup(sensitivity, dims.SENSITIVITY_RANK, 2)


def content_hash(text: Column) -> Column:
    """Hash of the text with unified line ends and right-trimmed lines."""
    unified = F.regexp_replace(text, "\r\n?", "\n")
    trimmed = F.regexp_replace(unified, r"(?mU)[\s&&[^\n]]+$", "")
    return F.sha2(trimmed, 256)


def blob_id(text: Column) -> Column:
    """Git blob name of the content."""
    head = F.concat(F.lit("blob "), F.octet_length(text).cast("string"))
    return F.sha1(F.concat(head.cast("binary"), F.lit(b"\x00"), text.cast("binary")))


def percent_text(ratio: Column) -> Column:
    """Whole per cent, halves to even, as the claim texts print it."""
    return F.concat(F.bround(ratio * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def days_between(now: Column, since: Column) -> Column:
    """Whole 24-hour blocks between two timestamps."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(since)
    return F.floor(seconds / F.lit(86400)).cast("bigint")


def effective_confidence(
    confidence: Column, stale: Column, reduction: float = dims.STALE_REDUCTION
) -> Column:
    return F.when(stale, confidence * F.lit(1.0 - reduction)).otherwise(confidence)


def exact_mean(value: Column, places: int = 6) -> Column:
    """Mean over decimals: the same for every order in which rows are added up."""
    return F.round(F.sum(value.cast("decimal(18,6)")).cast("double") / F.count(value), places)


def preview(text: Column, width: int = 100) -> Column:
    return F.substring(text, 1, width)
