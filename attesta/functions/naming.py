"""Identifier styles and the consistency bucket they fall in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta import dims
from attesta.functions.base import first_match

# fixed values: style patterns, tried in this order
STYLE_PATTERNS = (
    ("snake_case", r"^[a-z][a-z0-9]*(_[a-z0-9]+)*$"),
    ("SCREAMING_SNAKE", r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$"),
    ("camelCase", r"^[a-z][a-zA-Z0-9]*$"),
    ("PascalCase", r"^[A-Z][a-zA-Z0-9]*$"),
)


def classify_name(name: Column) -> Column:
    bare = F.regexp_replace(name, "^_+", "")
    styled = first_match((bare.rlike(p), F.lit(style)) for style, p in STYLE_PATTERNS)
    return F.when(F.length(bare) >= 2, styled)


def bucket_authority(consistency: Column) -> Column:
    return F.when(consistency >= dims.STRONG, "inferred-high").otherwise("inferred-low")


def bucket_review(consistency: Column) -> Column:
    return F.when(consistency >= dims.STRONG, "unreviewed").otherwise("needs-declaration")


def bucket_type(consistency: Column) -> Column:
    return F.when(consistency >= dims.STRONG, "always-on-rule").otherwise("scoped-rule")
