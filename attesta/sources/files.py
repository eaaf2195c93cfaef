"""Files as rows: reading, pruning, routing, and a synthetic corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta import dims
from attesta.functions.base import blob_id, first_match, lookup
from attesta.functions.scopes import instruction_source


def scan_files(
    spark: SparkSession, root: str, glob: str = "*", limit_bytes: int | None = None
) -> DataFrame:
    """Files below ``root/<repo_id>/`` as rows. Only where a limit is given, larger files keep their row without content."""
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
    )
    tail = F.regexp_extract("path", "^.*?" + quoted(root.rstrip("/")) + "/(.*)$", 1)
    text = F.try_validate_utf8(F.col("content"))
    named = [
        F.when(tail.contains("/"), F.regexp_extract(tail, "^([^/]+)/", 1)).otherwise("").alias("repo_id"),
        F.regexp_extract(tail, "^(?:[^/]+/)?(.*)$", 1).alias("path"),
        F.col("length").alias("size"),
    ]
    whole = raw.select(*named, text.alias("content"), F.when(text.isNull(), "not text").alias("error"))
    if limit_bytes is None:
        return whole.withColumn("blob_hash", blob_id(F.col("content")))
    # the size test is a filter, so the bytes of a large file are never read
    small = raw.filter(F.col("length") <= limit_bytes).select(*named, text.alias("content"), F.when(text.isNull(), "not text").alias("error"))
    large = raw.filter(F.col("length") > limit_bytes).select(*named, F.lit(None).cast("string").alias("content"), F.lit("too large").alias("error"))
    return small.unionByName(large).withColumn("blob_hash", blob_id(F.col("content")))


def quoted(text: str) -> str:
    """Literal text inside a regex (a parameter, not data)."""
    return "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in text)


def prune_paths(
    files: DataFrame,
    excluded: tuple[str, ...] = dims.EXCLUDED_DIRS,
    max_bytes: int | None = None,
    suffixes: tuple[str, ...] | None = None,
) -> DataFrame:
    """Drop excluded folders (a bare name is any segment, a path is a prefix) and, where asked, big files and other suffixes."""
    clean = [p.strip().strip("/").replace("\\", "/") for p in excluded]
    names = [p for p in clean if p and "/" not in p]
    kept = files if max_bytes is None else files.filter(F.col("size") <= max_bytes)
    if names:
        kept = kept.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, names))))
    for prefix in (p for p in clean if "/" in p):
        kept = kept.filter(~((F.col("path") == prefix) | F.col("path").startswith(prefix + "/")))
    if suffixes:
        kept = kept.filter(F.element_at(F.split("path", r"\."), -1).isin(*suffixes))
    return kept


def role_of(path: Column) -> Column:
    """What a file is read for; configuration counts only at the root."""
    root_names = {"pyproject.toml": "pyproject", "package.json": "package_json", "Makefile": "makefile", "Dockerfile": "dockerfile"}
    rules = [(path == name, F.lit(role)) for name, role in root_names.items()]
    rules += [
        (path.isin(*dims.COMPOSE_NAMES), F.lit("compose")),
        (path.isin(".python-version", ".nvmrc", ".node-version", ".tool-versions"), F.lit("version_file")),
        (path.rlike(r"copilot-setup-steps\.yml$") & instruction_source(path).isNotNull(), F.lit("setup_steps")),
        (path.rlike(r"^\.github/workflows/[^/]+\.ya?ml$"), F.lit("workflow")),
        (path.isin(*dims.ROOT_DOCS) | path.rlike(r"^docs/[^/]+\.md$"), F.lit("docs")),
        (instruction_source(path).isNotNull(), F.lit("instruction")),
        (path.rlike(r"\.py$"), F.lit("python")),
        (path.rlike(r"\.(?:jsx?|tsx?)$"), F.lit("javascript")),
    ]
    return first_match(rules, "other")


def route_files(files: DataFrame) -> DataFrame:
    return files.withColumn("role", role_of(F.col("path")))


def discover_docs(files: DataFrame) -> DataFrame:
    """Documentation files; root files of one content (case-folding file systems) count once."""
    docs = files.filter(role_of(F.col("path")) == "docs")
    folded = F.when(F.col("path").contains("/"), F.col("path")).otherwise(F.lower("path"))
    return docs.withColumn("_same", folded).groupBy("repo_id", "_same", "content_hash").agg(F.min("path").alias("path")).select("repo_id", "path")


def discover_instruction_files(files: DataFrame) -> DataFrame:
    """Instruction files with their kind; only the preferred set-up step file of a repository."""
    from attesta.operators.maintenance import first_by

    found = files.withColumn("source_kind", instruction_source(F.col("path"))).filter("source_kind IS NOT NULL")
    single = F.when(F.col("source_kind") == "copilot-setup-steps", F.lit("copilot-setup-steps")).otherwise(F.col("path"))
    preferred = F.when(F.col("path").startswith(".github/workflows/"), 0).otherwise(1)
    return first_by(found.withColumn("_slot", single), ["repo_id", "_slot"], [preferred]).drop("_slot")


def detect_languages(files: DataFrame) -> DataFrame:
    """Languages per repository with file counts, and whether they are analysed."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = lookup(suffix, dims.LANGUAGE_BY_SUFFIX)
    other = lookup(suffix, dims.OTHER_LANGUAGE_BY_SUFFIX)
    rows = files.select("repo_id", F.coalesce(known, other).alias("language"), known.isNotNull().alias("supported"))
    return rows.filter("language IS NOT NULL").groupBy("repo_id", "language", "supported").agg(F.count(F.lit(1)).alias("files"))


MODULES = ("core", "models", "services", "utils", "handlers", "middleware", "config", "api", "db", "cache")


def synth_corpus(spark: SparkSession, repos: int, files_per_repo: int, seed: int = 42) -> DataFrame:
    """Deterministic Python repositories: modules, functions, classes, configuration and a workflow.

    Every value hangs on (row id, seed) through a hash, so the rows do not depend on
    partitioning.
    """
    rows = spark.range(repos * files_per_repo).select(
        F.concat(F.lit("synth-"), F.floor(F.col("id") / files_per_repo).cast("string")).alias("repo_id"),
        (F.col("id") % files_per_repo).alias("no"),
    )

    def roll(name: str, low: int, high: int) -> Column:
        return (F.pmod(F.xxhash64("repo_id", "no", F.lit(name), F.lit(seed)), F.lit(high - low + 1)) + low).cast("int")

    module = F.get(F.array(*map(F.lit, MODULES)), (F.col("no") % len(MODULES)).cast("int"))
    number = F.col("no").cast("string")

    def function(i: Column) -> Column:
        return F.concat(
            F.lit("\n\ndef process_"), module, F.lit("_"), number, F.lit("_"), i.cast("string"),
            F.lit('(value: int, scale: float = 1.0) -> float:\n    """Scale a value."""\n    total = value * scale\n    if total > 100:\n        total = 100.0\n    return total\n'),
        )

    def clazz(i: Column) -> Column:
        return F.concat(
            F.lit("\n\nclass "), F.initcap(module), F.lit("Handler"), number, F.lit("_"), i.cast("string"),
            F.lit(':\n    """Handle requests."""\n\n    def run(self, request: str) -> str:\n        return request.strip()\n'),
        )

    imports = F.concat(F.lit("from __future__ import annotations\n\nimport os\nfrom synth_app."), F.get(F.array(*map(F.lit, MODULES)), roll("import", 0, 9)), F.lit(" import mod\n"))
    body = F.concat(
        F.lit('"""Module."""\n\n'), imports,
        F.array_join(F.transform(F.sequence(F.lit(1), roll("functions", 3, 8)), function), ""),
        F.array_join(F.transform(F.sequence(F.lit(1), roll("classes", 1, 3)), clazz), ""),
    )
    source = rows.select("repo_id", F.concat(F.lit("src/synth_app/"), module, F.lit("/mod_"), F.lpad(number, 5, "0"), F.lit(".py")).alias("path"), body.alias("content"))
    fixed = [
        ("pyproject.toml", '[project]\nname = "synth-app"\nrequires-python = ">=3.12"\n\n[project.scripts]\nsynth = "synth_app.main:run"\n\n[tool.pytest.ini_options]\ntestpaths = ["tests"]\n'),
        ("README.md", "# Synth App\n\n## Commands\n\n```bash\npytest tests\nruff check src\n```\n"),
        (".github/workflows/ci.yml", "name: CI\non: [push]\njobs:\n  test:\n    runs-on: ubuntu-latest\n    steps:\n      - run: pytest\n      - run: ruff check src\n"),
        ("src/synth_app/__init__.py", ""),
        *[(f"src/synth_app/{m}/__init__.py", "") for m in MODULES],
    ]
    constant = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in fixed]))
    config = rows.filter("no = 0").select("repo_id", constant.alias("f")).select("repo_id", "f.path", "f.content")
    return source.unionByName(config).withColumn("size", F.length("content").cast("bigint"))
