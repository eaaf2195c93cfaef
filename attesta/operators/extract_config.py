"""Commands, runtimes, services and variables from configuration files.

Each job takes (repo_id, path, content) rows of its own file role; routing and size
limits come first (``sources.files``), so Python codecs only see those files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import dims
from attesta.functions import codecs, versions
from attesta.functions.base import first_match, kept
from attesta.functions.textscan import exploded
from attesta.functions.commands import (
    certainty_confidence,
    normalize_ci_command,
    risk_by_name,
    risk_of_make_target,
    step_certainty,
)

FILE_KEY = ["repo_id", "path"]
# Commands parsed out of files are longer by far than the planner's guess from the files' size on disk, by which they would go
# through the driver. Joins by hash build on distinct keys only, so that no repository fills a table; the others spill.
BY_HASH, BY_SORT = "shuffle_hash", "merge"
STRING_MAP = "map<string,string>"


def _json(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)


def _map(text: Column, path: str) -> Column:
    """Object members in document order, values as text."""
    return F.from_json(_json(text, path), STRING_MAP)


def _string_members(rows: DataFrame, text: str, path: str) -> DataFrame:
    """One row per string member of an object: ordinal, name, value.

    The text is parsed inside a list, because the parser alone overlooks what follows a
    complete document; a malformed text gives no rows.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit("]")))
    whole = listed.isNotNull() & F.try_variant_get(listed, "$[1]", "string").isNull()
    types = F.try_variant_get(listed, "$[0]" + path[1:], "map<string,variant>")
    # in one projection, where the text is parsed once; a filter in between would parse it for each of its conditions
    members = rows.select("*", F.when(whole, types).alias("_types"), F.when(whole, F.map_entries(_map(F.col(text), path))).alias("_members"))
    out = members.select("*", F.posexplode_outer("_members").alias("ordinal", "_e")).filter("_e IS NOT NULL")
    kind = F.schema_of_variant(F.try_element_at("_types", F.col("_e.key")))
    return (
        out.withColumn("name", F.col("_e.key"))
        .withColumn("value", F.col("_e.value"))
        .filter(kind == "STRING")
        .drop("_e", "_types", "_members")
    )


# ---- package.json, pyproject.toml, Makefile --------------------------------------------


def package_json_commands(files: DataFrame) -> DataFrame:
    rows = _string_members(files, "content", "$.scripts")
    return rows.select(
        *FILE_KEY, "ordinal", "name", F.col("value").alias("command"),
        risk_by_name(F.col("name"), dims.PACKAGE_RISK).alias("risk_class"), F.lit(1.0).alias("confidence"),
    )


def package_json_engines(files: DataFrame) -> DataFrame:
    rows = _string_members(files, "content", "$.engines")
    return rows.select(*FILE_KEY, "ordinal", F.concat_ws(" ", "name", "value").alias("runtime"))


def pyproject_documents(files: DataFrame) -> DataFrame:
    return files.select(*FILE_KEY, codecs.toml_to_json("content").alias("doc")).filter("doc IS NOT NULL")


def _in_part(env: Column, position: Column | None = None) -> Column:
    """Place of a command inside its part: environment, then position."""
    at = F.col("ordinal") if position is None else position
    return F.struct(env.cast("long").alias("env"), at.cast("long").alias("position")).alias("ordinal")


def configured_commands(pyproject: DataFrame, package_json: DataFrame, makefile: DataFrame) -> DataFrame:
    """All configured commands of a repository; ``ordinal`` is their order, a struct (source, part, env, position)."""

    def placed(rows: DataFrame, source: int, part: Column, env: Column, position: Column) -> DataFrame:
        place = F.struct(
            F.lit(source).alias("source"), part.cast("int").alias("part"), env.cast("long").alias("env"), position.cast("long").alias("position")
        )
        return rows.withColumn("ordinal", place).select(*FILE_KEY, "ordinal", "name", "command", "risk_class", "confidence")

    zero = F.lit(0)
    return (
        placed(pyproject, 0, F.col("part"), F.col("ordinal.env"), F.col("ordinal.position"))
        .unionByName(placed(package_json, 1, zero, zero, F.col("ordinal")))
        .unionByName(placed(makefile, 2, zero, zero, F.col("ordinal")))
    )


def pyproject_commands(docs: DataFrame) -> DataFrame:
    """Scripts, environment scripts and the implied test command, in that order."""
    out = [*FILE_KEY, "part", "ordinal", "name", "command", "risk_class", "confidence"]
    risk = risk_by_name(F.col("name"), dims.PYPROJECT_RISK)
    scripts = _string_members(docs, "doc", "$.project.scripts").select(
        *FILE_KEY, F.lit(0).alias("part"), _in_part(F.lit(0)), "name", F.col("value").alias("command"),
        risk.alias("risk_class"), F.lit(1.0).alias("confidence"),
    )
    envs = docs.select(
        *FILE_KEY, F.posexplode(F.map_entries(_map(F.col("doc"), "$.tool.hatch.envs"))).alias("env_no", "_env")
    ).select(*FILE_KEY, "env_no", F.col("_env.key").alias("env"), F.col("_env.value").alias("env_doc"))
    hatch = _string_members(envs, "env_doc", "$.scripts").select(
        *FILE_KEY, F.lit(1).alias("part"), _in_part(F.col("env_no")),
        F.concat_ws(":", F.lit("hatch"), "env", "name").alias("name"), F.col("value").alias("command"),
        risk.alias("risk_class"), F.lit(1.0).alias("confidence"),
    )
    pytest = docs.filter(_json(F.col("doc"), "$.tool.pytest").startswith("{")).select(
        *FILE_KEY, F.lit(2).alias("part"), _in_part(F.lit(0), F.lit(0)), F.lit("pytest").alias("name"),
        F.lit("pytest").alias("command"), F.lit("test-execution").alias("risk_class"), F.lit(0.9).alias("confidence"),
    )
    return scripts.select(*out).unionByName(hatch.select(*out)).unionByName(pytest.select(*out))


def pyproject_facts(docs: DataFrame) -> DataFrame:
    """Required Python and the known tools that are configured."""
    doc = F.col("doc")
    tools = kept(F.when(_json(doc, f"$.tool.{t}").isNotNull(), t) for t in dims.KNOWN_TOOLS)
    needed = _json(doc, "$.project.requires-python")
    return docs.select(
        *FILE_KEY, F.when(needed.isNotNull(), F.concat(F.lit("Python "), needed)).alias("runtime"), tools.alias("tools")
    )


def makefile_targets(files: DataFrame) -> DataFrame:
    """First occurrence of every target, in file order."""
    names = F.array_distinct(
        F.regexp_extract_all(F.col("content"), F.lit(r"(?m)^([a-zA-Z_][a-zA-Z0-9_-]*):"), F.lit(1))
    )
    return files.select(*FILE_KEY, F.posexplode(names).alias("ordinal", "name")).select(
        *FILE_KEY, "ordinal", "name", F.concat(F.lit("make "), "name").alias("command"),
        risk_of_make_target(F.col("name")).alias("risk_class"), F.lit(0.9).alias("confidence"),
    )


# ---- Dockerfile, compose, version files ------------------------------------------------


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: (w != "") & ~w.startswith("-"))


def _installs(run: Column) -> Column:
    system = F.regexp_extract(run, r"(?:apt-get|apk|yum|dnf)\s+(?:install|add)\s+(.+?)(?:\s*&&|$)", 1)
    pip = F.regexp_extract(run, r"pip\s+install\s+(.+?)(?:\s*&&|$)", 1)
    npm = F.regexp_extract(run, r"npm\s+install\s+-g\s+(.+?)(?:\s*&&|$)", 1)
    return F.concat(
        _words(system),
        F.transform(_words(pip), lambda w: F.concat(F.lit("pip:"), w)),
        F.transform(_words(npm), lambda w: F.concat(F.lit("npm:"), w)),
    )


def dockerfile_facts(files: DataFrame) -> DataFrame:
    """kind, position and value of every fact; variable names never carry values."""
    joined = files.withColumn("_text", F.regexp_replace("content", r"\\\n\s*", " "))

    def every(pattern: str) -> Column:
        return F.regexp_extract_all(F.col("_text"), F.lit(pattern), F.lit(1))

    cut = joined.select(
        *FILE_KEY,
        every(r"(?im)^FROM\s+(\S+)").alias("images"),
        every(r"(?im)^RUN\s+(.+?)\s*\\?\s*$").alias("runs"),
        every(r"(?im)^ENV\s+(\S+)").alias("envs"),
        every(r"(?im)^EXPOSE\s+(.+)$").alias("exposed"),
        every(r"(?im)^WORKDIR\s+(.+)$").alias("dirs"),
    )
    hints = F.filter(F.transform("images", versions.runtime_hint), lambda h: h.isNotNull())
    names = F.transform("envs", lambda e: F.split_part(e, F.lit("="), F.lit(1)))
    ports = F.transform(F.flatten(F.transform("exposed", _words)), lambda p: F.split_part(p, F.lit("/"), F.lit(1)))
    lists = {
        "base_image": F.col("images"),
        "runtime_hint": hints,
        "tool_install": F.flatten(F.transform("runs", lambda r: _installs(r))),
        "env_name": names,
        "port": ports,
        "workdir": F.slice(F.transform("dirs", lambda d: F.trim(d)), F.lit(-1), F.lit(1)),
    }
    def facts(kind: str, values: Column) -> Column:
        return F.transform(
            values, lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("position"), v.alias("value"))
        )

    arrays = [facts(kind, values) for kind, values in lists.items()]
    # a negative slice of an empty list is an error, hence the guard on workdir
    arrays[-1] = F.when(F.size("dirs") > 0, arrays[-1])
    arrays[-1] = F.coalesce(arrays[-1], F.array().cast("array<struct<kind:string,position:int,value:string>>"))
    return exploded(cut, F.concat(*arrays), "f").select(*FILE_KEY, "f.kind", "f.position", "f.value")


def _env_names(node: Column, path: str) -> Column:
    """Names of a mapping or of ``KEY=value`` lines."""
    raw = _json(node, path)
    from_map = F.map_keys(F.from_json(raw, STRING_MAP))
    from_list = F.transform(F.from_json(raw, "array<string>"), lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    return F.when(raw.startswith("{"), from_map).when(raw.startswith("["), from_list)


def compose_services(files: DataFrame) -> DataFrame:
    docs = files.select(*FILE_KEY, codecs.yaml_to_json("content").alias("doc")).filter("doc IS NOT NULL")
    rows = docs.select(
        *FILE_KEY, F.posexplode(F.map_entries(_map(F.col("doc"), "$.services"))).alias("ordinal", "_s")
    ).filter(F.col("_s.value").startswith("{"))
    node = F.col("_s.value")
    depends = _json(node, "$.depends_on")
    return rows.select(
        *FILE_KEY, "ordinal", F.col("_s.key").alias("service"), _json(node, "$.image").alias("image"),
        _env_names(node, "$.environment").alias("env_names"),
        F.from_json(_json(node, "$.ports"), "array<string>").alias("ports"),
        F.when(depends.startswith("["), F.from_json(depends, "array<string>"))
        .when(depends.startswith("{"), F.map_keys(F.from_json(depends, STRING_MAP))).alias("depends_on"),
        F.from_json(_json(node, "$.volumes"), "array<string>").alias("volumes"),
    )


def version_files(files: DataFrame) -> DataFrame:
    """Runtime hints of single-value version files and of tool lists."""
    lines = F.filter(
        F.transform(F.split("content", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#")
    )
    single = first_match((F.col("path") == p, F.lit(r)) for p, r in dims.VERSION_FILES)
    one = F.when(
        single.isNotNull() & (F.size(lines) > 0),
        F.array(F.struct(single.alias("runtime"), F.get(lines, 0).alias("version"))),
    )

    def tool(line: Column) -> Column:
        parts = F.split(line, r"\s+")
        name = F.lower(F.get(parts, 0))
        known = first_match(((name == k, F.lit(v)) for k, v in dims.TOOL_VERSION_NAMES.items()), name)
        return F.struct(known.alias("runtime"), F.get(parts, 1).alias("version"))

    many = F.filter(F.transform(lines, tool), lambda t: t.version.isNotNull())
    pairs = F.when(F.col("path") == ".tool-versions", many).otherwise(one)
    return files.select(*FILE_KEY, F.posexplode(pairs).alias("ordinal", "p")).select(
        *FILE_KEY, "ordinal", "p.runtime", "p.version"
    )


# ---- workflows -------------------------------------------------------------------------


def workflow_documents(files: DataFrame) -> DataFrame:
    """Parsed workflows with their triggers; ``on`` may have been read as a boolean key."""
    docs = files.select(*FILE_KEY, codecs.yaml_to_json("content").alias("doc")).filter("doc IS NOT NULL")
    on = F.coalesce(_json(F.col("doc"), "$.on"), _json(F.col("doc"), "$.true"))
    triggers = (
        F.when(on.startswith("["), F.from_json(on, "array<string>"))
        .when(on.startswith("{"), F.map_keys(F.from_json(on, STRING_MAP)))
        .when(on.isNotNull(), F.array(on))
        .otherwise(F.array().cast("array<string>"))
    )
    branch = F.array(*map(F.lit, dims.BRANCH_TRIGGERS))
    return docs.withColumn("triggers", triggers).withColumn(
        "schedule_only", ~F.arrays_overlap("triggers", branch)
    )


def workflow_jobs(docs: DataFrame) -> DataFrame:
    """One row per job with runner and matrix."""
    rows = docs.select(
        *FILE_KEY, "doc", "schedule_only",
        F.posexplode(F.map_entries(_map(F.col("doc"), "$.jobs"))).alias("job_no", "_j"),
    ).filter(F.col("_j.value").startswith("{"))
    job = F.col("_j.value")
    runner = _json(job, "$.runs-on")
    raw = F.map_filter(
        F.coalesce(F.from_json(_json(job, "$.strategy.matrix"), STRING_MAP), F.create_map().cast(STRING_MAP)),
        lambda k, v: ~k.isin("include", "exclude") & (v.startswith("[") | v.rlike(r"\$\{\{.*?\}\}")),
    )
    matrix = F.transform_values(
        raw,
        lambda k, v: F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(
            F.array(F.concat(F.lit("<unresolvable:"), v, F.lit(">")))
        ),
    )
    return rows.select(
        *FILE_KEY, "doc", "schedule_only", "job_no", F.col("_j.key").alias("job"), job.alias("job_doc"),
        F.when(runner.startswith("["), F.array_join(F.from_json(runner, "array<string>"), ", ")).otherwise(runner).alias("runs_on"),
        matrix.alias("matrix"),
    )


def workflow_steps(jobs: DataFrame) -> DataFrame:
    steps = F.from_json(_json(F.col("job_doc"), "$.steps"), "array<string>")
    rows = jobs.select(
        *FILE_KEY, "schedule_only", "job_no", "job", "runs_on", "matrix", F.posexplode(steps).alias("step_no", "step")
    )
    step = F.col("step")
    condition = F.nullif(_json(step, "$.if"), F.lit(""))
    tolerant = F.coalesce(~_json(step, "$.continue-on-error").isin("false", "0", ""), F.lit(False))
    return rows.withColumn(
        "certainty", step_certainty(tolerant, F.col("schedule_only"), condition, F.size("matrix") > 0)
    )


def ci_commands(steps: DataFrame) -> DataFrame:
    """Every command line of every run step."""
    run = F.regexp_replace(_json(F.col("step"), "$.run"), r"^\s+|\s+$", "")
    lines = steps.select(
        *FILE_KEY, "job_no", "job", "step_no", "runs_on", "certainty", F.posexplode(F.split(run, "\n")).alias("line_no", "raw")
    ).withColumn("command", F.trim("raw"))
    return lines.filter("command <> '' AND NOT startswith(command, '#')").drop("raw").withColumn(
        "confidence", certainty_confidence(F.col("certainty"))
    )


def ci_runtimes(steps: DataFrame) -> DataFrame:
    """Runtime versions asked for by set-up actions, matrix references resolved."""
    uses = _json(F.col("step"), "$.uses")
    action = F.split_part(uses, F.lit("@"), F.lit(1))
    runtime = first_match((action == a, F.lit(r)) for a, (r, _) in dims.SETUP_ACTIONS.items())
    version = first_match(
        (action == a, _json(F.col("step"), f"$.with.{key}")) for a, (_, key) in dims.SETUP_ACTIONS.items()
    )
    named = steps.withColumn("runtime", runtime).withColumn("_v", version).filter("runtime IS NOT NULL AND _v IS NOT NULL")
    values = F.when(F.col("_v").startswith("["), F.from_json("_v", "array<string>")).otherwise(
        versions.resolve_matrix(F.col("_v"), F.col("matrix"))
    )
    return named.select(
        *FILE_KEY, "job_no", "job", "step_no", "runtime", F.posexplode(values).alias("version_no", "version")
    )


def ci_services(jobs: DataFrame) -> DataFrame:
    members = F.map_entries(_map(F.col("job_doc"), "$.services"))
    rows = jobs.select(*FILE_KEY, "job_no", "job", F.posexplode(members).alias("service_no", "_s"))
    image = F.coalesce(_json(F.col("_s.value"), "$.image"), F.col("_s.key"))
    return rows.select(*FILE_KEY, "job_no", "job", "service_no", F.col("_s.key").alias("service"), image.alias("image"))


def _named_env(text: Column, path: str) -> Column:
    return F.transform(F.map_entries(_map(text, path)), lambda e: versions.env_name(e.key, e.value))


def ci_env_names(docs: DataFrame, jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """Variable names of workflow, jobs and steps."""
    parts = [
        docs.select(*FILE_KEY, F.lit("workflow").alias("level"), F.explode(_named_env(F.col("doc"), "$.env")).alias("name")),
        jobs.select(*FILE_KEY, F.lit("job").alias("level"), F.explode(_named_env(F.col("job_doc"), "$.env")).alias("name")),
        steps.select(*FILE_KEY, F.lit("step").alias("level"), F.explode(_named_env(F.col("step"), "$.env")).alias("name")),
    ]
    return reduce(DataFrame.unionByName, parts)


def setup_steps_claims(files: DataFrame) -> DataFrame:
    """Variables, runtime versions and commands of set-up step files; values are cut off."""
    jobs = workflow_jobs(workflow_documents(files))
    steps = workflow_steps(jobs)
    name = F.explode(F.map_keys(_map(F.col("job_doc"), "$.env")))
    env = jobs.select(*FILE_KEY, name.alias("name")).select(
        *FILE_KEY, F.lit("environment-prerequisite").alias("claim_type"), F.concat(F.lit("Environment variable: "), "name").alias("content")
    )
    uses = _json(F.col("step"), "$.uses")
    version = first_match(
        (uses.contains(a), F.concat(F.lit(f"{label} "), _json(F.col("step"), f"$.with.{key}")))
        for a, (key, label) in dims.SETUP_STEP_LABELS.items()
    )
    runtime = steps.select(*FILE_KEY, F.lit("environment-prerequisite").alias("claim_type"), version.alias("content")).filter("content IS NOT NULL")
    command = ci_commands(steps).select(*FILE_KEY, F.lit("validated-command").alias("claim_type"), F.col("command").alias("content"))
    return env.unionByName(runtime).unionByName(command).withColumn("confidence", F.lit(1.0))


def validate_setup_steps(files: DataFrame) -> DataFrame:
    """Structural errors of set-up step files, one row per error."""
    docs = files.select(*FILE_KEY, codecs.yaml_to_json("content").alias("doc"))
    jobs = _map(F.col("doc"), "$.jobs")
    one = docs.withColumn("_jobs", jobs).withColumn("_n", F.size(F.map_keys("_jobs")))
    name = F.get(F.map_keys("_jobs"), 0)
    job = F.get(F.map_values("_jobs"), 0)
    raw_timeout = _json(job, "$.timeout-minutes")
    timeout = raw_timeout.try_cast("double")
    mapping = job.startswith("{")
    keys = F.map_keys(F.from_json(F.when(mapping, job), STRING_MAP))
    # fixed values: keys a set-up job may and may not carry
    allowed = ("runs-on", "timeout-minutes", "steps", "env", "permissions")
    barred = ("services", "container", "strategy", "needs", "outputs", "if", "concurrency")
    banned = F.array_sort(F.filter(keys, lambda k: k.isin(*barred)))
    unknown = F.array_sort(F.filter(keys, lambda k: ~k.isin(*allowed, *barred)))
    raw_steps = _json(job, "$.steps")
    listed = raw_steps.startswith("[")
    steps = F.from_json(F.when(listed, raw_steps), "array<string>")
    step_errors = F.flatten(F.transform(steps, _step_errors))
    limit = 59
    none = F.array().cast("array<string>")
    single = F.col("_n") == 1
    errors = [
        F.when(F.col("doc").isNull() | F.col("_jobs").isNull(), F.lit("no jobs")),
        F.when(F.col("_n") != 1, F.concat(F.lit("one job is wanted, there are "), F.col("_n"))),
        F.when(single & (name != dims.SETUP_JOB), F.concat(F.lit(f"the job has to be called {dims.SETUP_JOB}, not "), name)),
        F.when(single & ~mapping, F.lit("the job is no mapping")),
        F.when(single & raw_timeout.isNotNull() & timeout.isNull(), F.lit("timeout-minutes is no number")),
        F.when(single & (timeout > limit), F.concat(F.lit("timeout-minutes is "), raw_timeout, F.lit(f", the most is {limit}"))),
        F.when(single & (timeout <= 0), F.concat(F.lit("timeout-minutes is "), raw_timeout, F.lit(", the least is 1"))),
        F.when(single & (F.size(banned) > 0), F.concat(F.lit("keys a set-up job cannot have: "), F.array_join(banned, ", "))),
        F.when(single & (F.size(unknown) > 0), F.concat(F.lit("keys nobody knows: "), F.array_join(unknown, ", "))),
        F.when(single & raw_steps.isNotNull() & ~listed, F.lit("steps is no list")),
    ]
    in_steps = F.when(single, F.coalesce(step_errors, none)).otherwise(none)
    return one.select(*FILE_KEY, F.explode(F.concat(kept(errors), in_steps)).alias("error"))


def _step_errors(step: Column, no: Column) -> Column:
    """A step has to be a mapping, and what it uses pinned to a version."""
    uses = _json(step, "$.uses")
    loose = uses.isNotNull() & ~uses.contains("@")
    return kept([
        F.when(~step.startswith("{"), F.concat(F.lit("step "), no, F.lit(" is no mapping"))),
        F.when(step.startswith("{") & loose, F.concat(F.lit("step "), no, F.lit(" uses "), uses, F.lit(" without a version"))),
    ])


# ---- from facts to claims --------------------------------------------------------------


#: Kinds of letters in a shape, the number that holds a length and the kind of one letter.
LETTERS = 16


def _shape(length: Column, letter: Column) -> Column:
    return length.cast("bigint") * LETTERS + F.ascii(letter) % LETTERS


def _length(shape: Column) -> Column:
    return F.floor(shape / LETTERS).cast("int")


def ci_match(ci: DataFrame, config: DataFrame) -> DataFrame:
    """First configured command each distinct CI command runs.

    ``config`` has (repo_id, ordinal, name, command). The match rules become keys: prefixes
    of the CI line and the line behind a runner for the command text, suffixes for the
    name, runs of words for a command inside the line. Only lengths that commands and
    names of the repository really have, with the first (of a name the last) letter they
    have, are made into keys, so the keys grow with the line, not with its square, and few
    that nothing owns are moved. Keys meet by equality and each key of the configuration
    keeps its first owner, so no two command sets of a repository are ever paired in full.
    """
    line = F.col("ci_command")
    distinct = ci.select("repo_id", normalize_ci_command(F.col("command")).alias("ci_command")).filter(line != "").distinct()
    words_of = F.regexp_extract_all("command", F.lit(r"\w+"), F.lit(0))
    sizes = config.groupBy("repo_id").agg(
        F.collect_set(_shape(F.length("command"), F.col("command"))).alias("_texts"),
        F.collect_set(_shape(F.length("name"), F.right("name", F.lit(1)))).alias("_names"),
        F.collect_set(_shape(F.size(words_of), F.get(words_of, 0))).alias("_counts"),
    )
    size = F.length(line)
    none = F.array().cast("array<bigint>")

    def fitting(shapes: str, letter: Column) -> Column:
        """The lengths up to the line's that go with the letter."""
        fits = F.filter(F.coalesce(shapes, none), lambda x: (x % LETTERS == F.ascii(letter) % LETTERS) & (x >= LETTERS) & (_length(x) <= size))
        return F.transform(fits, _length).alias(f"{shapes}_in")

    met_sizes = distinct.join(sizes.hint(BY_SORT), "repo_id", "left").select("*", fitting("_texts", line), fitting("_names", F.right(line, F.lit(1))))
    prefixes = F.transform("_texts_in", lambda n: F.substring(line, F.lit(1), n))
    suffixes = F.transform("_names_in", lambda n: F.substring(line, size - n + 1, n))
    behind = kept(
        F.when(line.startswith(p), F.trim(F.regexp_replace(line, f"^{p}", ""))) for p in dims.CI_PREFIXES
    )
    worded = met_sizes.withColumn("_w", F.regexp_extract_all(line, F.lit(r"\w+"), F.lit(0)))
    count = F.size("_w")
    runs = F.flatten(
        F.transform(
            F.filter(F.coalesce("_counts", none), lambda x: (x >= LETTERS) & (_length(x) <= count)),
            lambda x: F.transform(
                F.filter(F.sequence(F.lit(1), count - _length(x) + 1), lambda i: F.ascii(F.get("_w", i - 1)) % LETTERS == x % LETTERS),
                lambda i: F.array_join(F.slice("_w", i, _length(x)), " "),
            ),
        )
    )

    def tagged(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.concat(F.lit(f"{kind}:"), k))

    # a key is one text with its kind in front: lists of texts are made distinct by hashing, lists of structs pair by pair;
    # the empty key, which nothing owns, stands for the line itself
    keys = F.array_distinct(
        F.concat(F.array(F.lit("")), tagged("text", prefixes), tagged("text", behind), tagged("name", suffixes), tagged("words", runs))
    )
    asked = exploded(worded, keys, "key").select("repo_id", "ci_command", "key")
    offered = config.select(
        "repo_id", "ordinal", "command",
        F.explode(
            F.array(
                F.concat(F.lit("text:"), "command"),
                F.concat(F.lit("name:"), "name"),
                F.concat(F.lit("words:"), F.array_join(words_of, " ")),
            )
        ).alias("key"),
    )
    # for a run of words the exact text still decides, so its first owner is kept per text
    by_words = F.col("key").startswith("words:")
    text = F.when(by_words, F.col("command")).otherwise(F.lit(""))
    # dealt by what they are joined on, so that they move once
    dealt = offered.select("repo_id", "key", text.alias("text"), "ordinal").repartition("repo_id", "key")
    owners = dealt.groupBy("repo_id", "key", "text").agg(F.min("ordinal").alias("ordinal"))
    escaped = F.regexp_replace("text", r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    inside = F.regexp_like(line, F.concat(F.lit(r"\b"), escaped, F.lit(r"\b")))
    met = asked.join(owners.hint(BY_HASH), ["repo_id", "key"], "left")
    # a line no key of which is owned keeps a null ordinal
    kept_keys = met.filter((F.col("key") == "") | F.col("ordinal").isNotNull() & (~by_words | inside))
    return kept_keys.groupBy("repo_id", "ci_command").agg(F.min("ordinal").alias("ordinal"))


def docs_new_commands(docs: DataFrame, config: DataFrame) -> DataFrame:
    """Documented commands the configuration does not know."""
    known = config.select("repo_id", F.lower(F.trim("command")).alias("_t")).distinct()
    return docs.withColumn("_t", F.lower(F.trim("command"))).join(known, ["repo_id", "_t"], "left_anti").drop("_t")
