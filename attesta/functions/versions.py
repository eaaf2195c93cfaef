"""Runtime names and version specifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta import dims
from attesta.functions.base import contains_any, first_match


def runtime_name(content: Column, strict: bool = False) -> Column:
    """Runtime a prerequisite speaks of; ``strict`` asks for whole words."""
    low = F.lower(content)
    if strict:
        return first_match(
            (low.rlike("\\b(?:" + "|".join(words) + ")\\b"), F.lit(name))
            for words, name in dims.RUNTIME_WORDS
        )
    return first_match(
        (contains_any(low, words), F.lit(name)) for words, name in dims.RUNTIME_WORDS
    )


def version_tuple(text: Column) -> Column:
    """First dotted number as an int array (arrays compare like tuples)."""
    found = F.regexp_extract(text, r"(\d+(?:\.\d+)*)", 1)
    return F.when(found != "", F.transform(F.split(found, r"\."), lambda p: p.cast("int")))


def major_minor(text: Column) -> Column:
    two = F.regexp_extract(text, r"(\d+\.\d+)", 1)
    one = F.regexp_extract(text, r"(\d+)", 1)
    return F.when(two != "", two).when(one != "", one)


def is_minimum(text: Column) -> Column:
    return text.contains(">")


def is_range(text: Column) -> Column:
    return text.rlike("[>+]")


def versions_conflict(a: Column, b: Column) -> Column:
    va, vb = version_tuple(a), version_tuple(b)
    exact = ~is_range(a) & ~is_range(b) & (va != vb)
    a_min = is_minimum(a) & ~is_range(b) & (vb < va)
    b_min = is_minimum(b) & ~is_range(a) & (va < vb)
    return F.coalesce(exact | a_min | b_min, F.lit(False))


def runtime_hint(image: Column) -> Column:
    """Runtime (and tag) a container base image stands for."""
    last = F.element_at(F.split(image, "/"), -1)
    name = F.lower(F.split_part(last, F.lit(":"), F.lit(1)))
    runtime = first_match((name.contains(k), F.lit(v)) for k, v in dims.IMAGE_RUNTIMES)
    tag = F.when(image.contains(":"), F.element_at(F.split(image, ":"), -1)).otherwise("latest")
    return F.when(tag == "latest", runtime).otherwise(F.concat(runtime, F.lit(":"), tag))


def resolve_matrix(value: Column, matrix: Column) -> Column:
    """Values of a matrix reference; any other expression is marked as unresolvable."""
    key = F.regexp_extract(F.trim(value), r"^\$\{\{\s*matrix\.([\w-]+)\s*\}\}$", 1)
    values = F.try_element_at(matrix, key)
    marked = F.array(F.concat(F.lit("<unresolvable:"), value, F.lit(">")))
    return (
        F.when((key != "") & values.isNotNull(), values)
        .when(value.rlike(r"\$\{\{.*?\}\}"), marked)
        .otherwise(F.array(value))
    )


def env_name(name: Column, value: Column) -> Column:
    """Variable name only; a note when the value comes from a secret."""
    secret = F.coalesce(value.contains("secrets."), F.lit(False))
    return F.when(secret, F.concat(name, F.lit(" (secret-ref)"))).otherwise(name)
