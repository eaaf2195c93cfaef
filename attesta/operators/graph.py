"""Module ownership, import edges and what follows from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.scopes import import_candidate
from attesta.functions.textscan import exploded
from attesta.session import checkpointed

FILE_KEY = ["repo_id", "path"]

# What is parsed out of the files is longer by far than the files' size on disk, from which the planner guesses; by that
# guess a side with every file is broadcast through the driver. The hints name the join, and none here broadcasts.
BY_HASH, BY_SORT = "shuffle_hash", "merge"
# Rows that are looked up by their distinct places and then joined with what was found are kept, so that no file is parsed twice.


def _folders(parts: Column) -> Column:
    """Every folder prefix of a path, the path itself included; ``parts`` is a column of its own, else each prefix cuts it again."""
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _by_folder(modules: DataFrame) -> DataFrame:
    """One module per folder: of several names the greatest."""
    return modules.groupBy("repo_id", "module_path").agg(F.max("module").alias("module"))


def _longest_folder(asked: DataFrame, place: str, modules: DataFrame) -> DataFrame:
    """``module`` of every distinct ``place``: the longest module folder in front of it.

    The prefixes of a place are few, so the prefix join becomes an equi-join.
    """
    places = asked.select("repo_id", place).distinct().withColumn("_parts", F.split(place, "/"))
    prefixes = exploded(places, _folders(F.col("_parts")), "module_path").drop("_parts")
    found = prefixes.join(_by_folder(modules).hint(BY_HASH), ["repo_id", "module_path"])
    return found.groupBy("repo_id", place).agg(F.max_by("module", F.length("module_path")).alias("module"))


def path_to_module(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """Owning module of every path: the longest module folder in front of it.

    Files of one folder share their owner, so prefixes are made and met once per folder.
    """
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^([\s\S]*)/", 1))
    asked = checkpointed(paths.select(*FILE_KEY).distinct().withColumn("_folder", folder))
    own = _by_folder(modules).select("repo_id", F.col("module_path").alias("path"), F.col("module").alias("_own"))
    met = asked.join(own.hint(BY_HASH), FILE_KEY, "left").join(_longest_folder(asked, "_folder", modules).hint(BY_SORT), ["repo_id", "_folder"], "left")
    return met.select(*FILE_KEY, F.coalesce("_own", "module").alias("module")).filter("module IS NOT NULL")


def _longest_dotted(asked: DataFrame, keys: list[str], modules: DataFrame) -> DataFrame:
    """``target`` of each candidate: its longest dotted prefix that is a module, looked up once per distinct candidate."""
    parts = F.col("_parts")
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    names = modules.select("repo_id", F.col("module").alias("prefix")).distinct()
    places = asked.select("repo_id", "candidate").distinct().withColumn("_parts", F.split("candidate", r"\."))
    hits = exploded(places, prefix, "prefix").join(names.hint(BY_HASH), ["repo_id", "prefix"])
    targets = hits.groupBy("repo_id", "candidate").agg(F.max_by("prefix", F.length("prefix")).alias("target"))
    return asked.join(targets.hint(BY_SORT), ["repo_id", "candidate"]).select(*keys, "target")


def resolve_py_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Target module of every distinct Python import (repo_id, path, name, level)."""
    keys = [*FILE_KEY, "name", "level"]
    asked = checkpointed(imports.select(*keys).distinct().withColumn(
        "candidate", import_candidate(F.col("path"), F.col("name"), F.col("level"))
    ))
    return _longest_dotted(asked, keys, modules)


def normal_path(path: Column) -> Column:
    """``a/b/../c`` as ``a/c``; null when it leaves the root."""
    folded = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part.isin("", "."), acc)
        .when((part == "..") & ((F.size(acc) == 0) | (F.get(acc, 0) == "..")), F.array(F.lit("..")))
        .when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(part))),
    )
    # inside a list of one, where the path is folded once for the test and the value
    return F.get(F.transform(F.array(F.array_join(folded, "/")), lambda p: F.when(~p.startswith(".."), p)), 0)


def resolve_js_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Target module of every relative JavaScript import; packages are skipped."""
    keys = [*FILE_KEY, "name"]
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    asked = checkpointed(imports.select(*keys).distinct().filter(F.col("name").startswith(".")).withColumn(
        "resolved", normal_path(F.concat_ws("/", folder, "name"))
    ))
    owners = _longest_folder(asked, "resolved", modules).withColumnRenamed("module", "target")
    return asked.join(owners.hint(BY_SORT), ["repo_id", "resolved"]).select(*keys, "target")


def import_edges(resolved: DataFrame, owners: DataFrame) -> DataFrame:
    """Distinct module-to-module imports, self-edges dropped."""
    return (
        resolved.join(owners.hint(BY_SORT), FILE_KEY)
        .filter(F.col("module") != F.col("target"))
        .select("repo_id", F.col("module").alias("source"), "target")
        .distinct()
        .withColumn("edge_type", F.lit("imports"))
    )


def contains_edges(modules: DataFrame) -> DataFrame:
    names = modules.select("repo_id", "module").distinct()
    parent = F.regexp_extract("module", r"^(.*)\.[^.]+$", 1)
    child = names.withColumn("source", parent).filter("source <> ''").withColumnRenamed("module", "target")
    known = names.withColumnRenamed("module", "source")
    return child.join(known, ["repo_id", "source"], "left_semi").select(
        "repo_id", "source", "target", F.lit("contains").alias("edge_type")
    )


def map_tests_to_modules(tests: DataFrame, modules: DataFrame) -> DataFrame:
    """Module each test file covers, by the name of the file.

    The first module in (language, path) order wins; a module owns few path parts, so the
    parts meet the target by equality and each part keeps its first owner.
    """
    name = F.element_at(F.split("path", "/"), -1)
    front = F.regexp_extract(name, r"^test_(.+)\.py$", 1)
    back = F.regexp_extract(name, r"^(.+)_test\.py$", 1)
    script = F.regexp_extract(name, r"^(.+)\.(?:test|spec)\.[jt]sx?$", 1)
    how = F.when(front != "", "front").when(back != "", "back").when(script != "", "script")
    target = F.when(front != "", front).when(back != "", back).otherwise(script)
    asked = tests.select(*FILE_KEY).distinct().withColumn("how", how).withColumn("part", target).filter("how IS NOT NULL")
    order = F.struct(F.col("language") != "python", "module_path", "module")

    def owners(parts: Column, kind: str) -> DataFrame:
        rows = modules.withColumn("part", F.explode(F.array_distinct(parts)))
        return rows.groupBy("repo_id", "part").agg(F.min_by("module", order).alias(kind))

    by_path = owners(F.split("module_path", "/"), "by_path")
    by_name = owners(F.split("module", r"\."), "by_name")
    module = F.when(F.col("how") == "front", F.coalesce("by_path", "by_name")).when(
        F.col("how") == "back", F.col("by_name")
    ).otherwise(F.coalesce("by_path", "by_name"))
    return (
        asked.join(by_path, ["repo_id", "part"], "left")
        .join(by_name, ["repo_id", "part"], "left")
        .select(*FILE_KEY, module.alias("module"))
        .filter("module IS NOT NULL")
    )


def test_edges(mapped: DataFrame) -> DataFrame:
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    return mapped.select(
        "repo_id", F.col("module").alias("source"), F.when(folder == "", ".").otherwise(folder).alias("target")
    ).distinct().withColumn("edge_type", F.lit("tests"))


def neighbours(edges: DataFrame, edge_type: str, reverse: bool = False) -> DataFrame:
    """One-hop neighbours as rows with their place in the sorted list, never as one array."""
    kept = edges.filter(F.col("edge_type") == edge_type)
    at, to = ("target", "source") if reverse else ("source", "target")
    return kept.select("repo_id", F.col(at).alias("module"), F.col(to).alias("neighbour")).distinct()


def module_info(
    modules: DataFrame, edges: DataFrame, boundaries: DataFrame, rules: DataFrame
) -> DataFrame:
    """Per module: its boundary text and the number of dependencies, dependents, tests and rules."""
    imports = edges.filter("edge_type = 'imports'")
    out_deg = imports.groupBy("repo_id", F.col("source").alias("module")).agg(F.count_distinct("target").alias("dependencies"))
    in_deg = imports.groupBy("repo_id", F.col("target").alias("module")).agg(F.count_distinct("source").alias("dependents"))
    tests = edges.filter("edge_type = 'tests'").groupBy("repo_id", F.col("source").alias("module")).agg(F.count_distinct("target").alias("test_locations"))
    scoped = rules.groupBy("repo_id", F.col("scope").alias("module_path")).agg(F.count(F.lit(1)).alias("rules"))
    text = boundaries.select("repo_id", F.col("scope").alias("module_path"), F.col("content").alias("boundary"))
    return (
        modules.select("repo_id", "module", "module_path")
        .join(text, ["repo_id", "module_path"], "left")
        .join(out_deg, ["repo_id", "module"], "left")
        .join(in_deg, ["repo_id", "module"], "left")
        .join(tests, ["repo_id", "module"], "left")
        .join(scoped, ["repo_id", "module_path"], "left")
        .fillna(0, ["dependencies", "dependents", "test_locations", "rules"])
    )


def dependency_closure(edges: DataFrame, depth: int = 3) -> DataFrame:
    """Modules reached within ``depth`` imports, with the smallest distance.

    Breadth first: each step joins only the rows found in the step before, and the
    lineage is cut with a reliable checkpoint.
    """
    hops = checkpointed(edges.filter("edge_type = 'imports'").select("repo_id", "source", "target").distinct())
    reached = hops.filter("source <> target").withColumn("distance", F.lit(1))
    frontier = reached
    for step in range(2, depth + 1):
        nxt = (
            frontier.select("repo_id", "source", F.col("target").alias("via"))
            .join(hops.select("repo_id", F.col("source").alias("via"), "target"), ["repo_id", "via"])
            .filter("source <> target").select("repo_id", "source", "target").distinct()
            .join(reached.select("repo_id", "source", "target"), ["repo_id", "source", "target"], "left_anti")
            .withColumn("distance", F.lit(step))
        )
        frontier = checkpointed(nxt)
        reached = reached.unionByName(frontier)
    return reached


def reachable(edges: DataFrame, starts: DataFrame, depth: int | None = None, reverse: bool = False, most_edges: int = 2_000_000) -> DataFrame:
    """``(repo_id, start, module, distance)``: what each start module (``repo_id, module``) reaches over imports, at its least distance.

    ``reverse`` follows dependents (what a change of the start touches). Nothing is put out for modules that are no start.
    A repository of up to ``most_edges`` distinct imports is searched breadth first by one task, so a cycle or chain of any
    length is one step; a larger one goes by rounds of joins, one per hop, over all its starts at once.
    """
    at, to = ("target", "source") if reverse else ("source", "target")
    wanted = starts.select("repo_id", "module").distinct()
    imports = edges.filter("edge_type = 'imports'").select("repo_id", F.col(at).alias("a"), F.col(to).alias("b")).distinct()
    hops = checkpointed(imports.join(wanted.select("repo_id").distinct(), "repo_id", "left_semi"))
    large = hops.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_edges).select("repo_id")
    small = hops.join(large, "repo_id", "left_anti")
    near = small.groupBy("repo_id").cogroup(wanted.join(large, "repo_id", "left_anti").groupBy("repo_id"))
    found = near.applyInArrow(_search(depth), "repo_id string, start string, module string, distance int")
    far = hops.join(large, "repo_id", "left_semi")
    return found if large.isEmpty() else found.unionByName(_by_rounds(far, wanted.join(large, "repo_id", "left_semi"), depth))


def _search(depth: int | None):
    """Breadth-first search of one repository, edges as sorted arrays."""

    def run(edges: pa.Table, starts: pa.Table) -> pa.Table:
        names = pa.concat_arrays([c.combine_chunks() for c in (edges.column("a"), edges.column("b"), starts.column("module"))])
        coded = names.dictionary_encode()
        codes, n = coded.indices.to_numpy(), len(coded.dictionary)
        a, b = codes[: edges.num_rows], codes[edges.num_rows : 2 * edges.num_rows]
        order = np.argsort(a, kind="stable")
        to = b[order]
        begin = np.searchsorted(a[order], np.arange(n + 1))
        repo = (starts if starts.num_rows else edges).column("repo_id")[0]
        out_start, out_module, out_distance = [], [], []
        for start in codes[2 * edges.num_rows :].tolist():
            distance = np.full(n, -1, dtype=np.int32)
            distance[start] = 0
            line, step = np.array([start]), 0
            while len(line) and (depth is None or step < depth):
                step += 1
                if len(line) == 1:  # along a chain, without building arrays
                    line = np.unique(to[begin[line[0]] : begin[line[0] + 1]])
                else:
                    line = np.unique(np.concatenate([to[begin[x] : begin[x + 1]] for x in line.tolist()]))
                line = line[distance[line] < 0]
                distance[line] = step
            met = np.flatnonzero(distance > 0)
            out_start.append(np.full(len(met), start))
            out_module.append(met)
            out_distance.append(distance[met])
        start, module, length = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (out_start, out_module, out_distance))
        columns = [pa.repeat(repo, len(start)), coded.dictionary.take(pa.array(start)), coded.dictionary.take(pa.array(module)), pa.array(length, pa.int32())]
        return pa.table(dict(zip(("repo_id", "start", "module", "distance"), columns, strict=True)))

    return run


def _by_rounds(hops: DataFrame, starts: DataFrame, depth: int | None) -> DataFrame:
    """The same by joins: each round goes on from the rows that the round before has found."""
    frontier = checkpointed(starts.select("repo_id", F.col("module").alias("start"), "module", F.lit(0).alias("distance")))
    reached, step = frontier, 0
    while (depth is None or step < depth) and not frontier.isEmpty():
        step += 1
        ahead = frontier.join(hops.withColumnRenamed("a", "module"), ["repo_id", "module"]).select("repo_id", "start", F.col("b").alias("module")).distinct()
        frontier = checkpointed(ahead.join(reached, ["repo_id", "start", "module"], "left_anti").withColumn("distance", F.lit(step)))
        reached = checkpointed(reached.unionByName(frontier))
    return reached.filter("distance > 0")
