"""Symbols, imports and modules from Python and JavaScript sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import dims
from attesta.functions import codecs
from attesta.functions.textscan import newline_count

FILE_KEY = ["repo_id", "path"]
SYMBOL = (
    "struct<errors:boolean,rows:array<struct<kind:string,name:string,line:int,last:int,returns:boolean,"
    "params:int,annotated:int,doc:boolean,decorators:string,level:int>>>"
)


def python_symbols(files: DataFrame) -> DataFrame:
    """Functions, classes, imports and constants of every file.

    A file the compiler rejects still gives what line patterns find in it.
    """
    parsed = files.select(*FILE_KEY, "content", F.from_json(codecs.python_to_json("content"), SYMBOL).alias("p"))
    text = F.col("content")

    def named(kind: str, pattern: str, level: int) -> Column:
        names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return F.transform(names, lambda n: F.struct(*[given(f, kind, n, level).alias(f) for f in fields]))

    fields = {"kind": "string", "name": "string", "line": "int", "last": "int", "returns": "boolean", "params": "int", "annotated": "int", "doc": "boolean", "decorators": "string", "level": "int"}

    def given(field: str, kind: str, name: Column, level: int) -> Column:
        known = {"kind": F.lit(kind), "name": name, "level": F.lit(level)}
        return known.get(field, F.lit(None)).cast(fields[field])

    found = F.concat(
        named("function", r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+([A-Za-z_]\w*)", 0),
        named("class", r"(?m)^[ \t]*class[ \t]+([A-Za-z_]\w*)", 0),
        named("import", r"(?m)^[ \t]*import[ \t]+([\w.]+)", 0),
        named("import", r"(?m)^[ \t]*from[ \t]+([A-Za-z_][\w.]*)[ \t]+import", 0),
        named("import", r"(?m)^[ \t]*from[ \t]+\.([\w]*)[ \t]+import", 1),
        named("import", r"(?m)^[ \t]*from[ \t]+\.\.([\w]*)[ \t]+import", 2),
    )
    # one parse and one list per file, whichever way its symbols were found
    rows = parsed.select(*FILE_KEY, F.col("p.errors").alias("has_errors"), F.when(F.col("p.errors"), found).otherwise(F.col("p.rows")).alias("_rows"))
    return rows.select(*FILE_KEY, F.inline_outer("_rows"), "has_errors").filter("kind IS NOT NULL").withColumn(
        "is_test", (F.col("kind") == "function") & F.col("name").startswith("test_")
    )


def js_language(path: Column) -> Column:
    return F.when(path.rlike(r"\.tsx?$"), "typescript").otherwise("javascript")


SCRIPT = "tests boolean, default boolean, rows array<struct<kind:string,name:string,form:string,exported:boolean,line:int,last:int,extends:string>>"


def js_symbols(files: DataFrame) -> DataFrame:
    """Functions, classes and imports of the code itself: nothing from comments, strings, templates or patterns.

    The first declaration form that names a function wins. ``line`` and ``last`` are its lines, ``extends`` is the base of a class.
    """
    parsed = files.select(*FILE_KEY, F.from_json(codecs.script_to_json(F.coalesce("content", F.lit(""))), SCRIPT).alias("p"))
    # a plain inline makes the planner test the list first, which reads the document again for each test
    return parsed.select(
        *FILE_KEY, js_language(F.col("path")).alias("language"), F.col("p.tests").alias("has_tests"), F.col("p.default").alias("default_export"), F.inline_outer("p.rows")
    ).filter("kind IS NOT NULL")


# ---- modules ---------------------------------------------------------------------------


def _kept_folder(folder: Column) -> Column:
    return ~F.arrays_overlap(F.split(folder, "/"), F.array(*map(F.lit, dims.NON_MODULE_DIRS)))


def py_modules(paths: DataFrame) -> DataFrame:
    """Packages: folders with an initialiser, ``src`` dropped from the dotted name."""
    folder = F.regexp_extract("path", r"^(.*)/__init__\.py$", 1)
    rows = paths.select("repo_id", folder.alias("module_path"), F.col("path").alias("evidence")).filter("module_path <> ''")
    bare = F.when(F.col("module_path") == "src", F.lit("src")).otherwise(F.regexp_replace("module_path", "^src/", ""))
    return rows.filter(_kept_folder(F.col("module_path"))).select(
        "repo_id", F.replace(bare, F.lit("/"), F.lit(".")).alias("module"), "module_path", "evidence",
        F.lit("python").alias("language"), F.lit(0).alias("place"),
    ).distinct()


def js_modules(paths: DataFrame) -> DataFrame:
    """Folders with an index file; the first index kind of a folder counts."""
    kinds = ("index.ts", "index.js", "index.tsx", "index.jsx")
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    rank = F.array_position(F.array(*map(F.lit, kinds)), name).cast("int")
    rows = paths.filter(name.isin(*kinds)).select("repo_id", folder.alias("module_path"), rank.alias("place"))
    first = rows.filter((F.col("module_path") != "") & _kept_folder(F.col("module_path"))).groupBy("repo_id", "module_path").agg(F.min("place").alias("place"))
    index = F.get(F.array(*map(F.lit, kinds)), F.col("place") - 1)
    return first.select(
        "repo_id", F.element_at(F.split("module_path", "/"), -1).alias("module"), "module_path",
        F.concat_ws("/", "module_path", index).alias("evidence"), F.lit("javascript").alias("language"), "place",
    )


def distinct_modules(python: DataFrame, javascript: DataFrame) -> DataFrame:
    """One row per module name; the later language, index kind and path win a clash."""
    from attesta.operators.maintenance import first_by

    both = python.unionByName(javascript)
    return first_by(both, ["repo_id", "module"], [F.col("place").desc(), F.col("module_path").desc()])


def boundary_claims(modules: DataFrame) -> DataFrame:
    python = F.col("language") == "python"
    kind = F.when(python, "Python package").otherwise("JS/TS module")
    text = F.concat(F.lit("Module '"), "module", F.lit("' — "), kind, F.lit(" at "), "module_path", F.lit("/"))
    return modules.select(
        "repo_id", F.lit("module-boundary").alias("claim_type"), text.alias("content"), F.col("module_path").alias("scope"),
        F.when(python, 0.95).otherwise(0.9).alias("confidence"), "evidence",
    )


def line_counts(files: DataFrame) -> DataFrame:
    return files.select(*FILE_KEY, (newline_count(F.col("content")) + 1).alias("lines"))
