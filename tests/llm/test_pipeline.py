import subprocess
import sys

import corpus_pipeline
import pytest

import __spark_entry__ as entry
from attesta.llm import decontamination, simhash, substrings, toxicity
from attesta.llm.queries import ORACLE, QUERIES

from .test_substrings import digests


def test_queries_are_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert set(ORACLE) <= set(QUERIES)


def test_stages_work_on_all_their_predecessor_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "source_mixing"]
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        kept.append(docs)
    toxic = {r["doc_id"] for r in toxicity.toxicity(spark.read.parquet(f"{folder}/documents.parquet"), labels).filter("predicted = 1").collect()}
    whole = {r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = [{r["doc_id"] for r in k.collect()} for k in kept]
    assert ids[0] == whole - toxic
    assert ids[1] == {r["doc_id"] for r in simhash.near_duplicates(kept[0]).filter("doc_id = component_id").collect()}
    assert ids[2] == ids[1]
    cut = {d: n for d, _, n, _ in digests(kept[1])}
    same = {r["doc_id"]: r["text"] for r in kept[1].collect()}
    assert all((r["text"] == same[r["doc_id"]]) == (cut[str(r["doc_id"])] == 0) for r in kept[2].collect())
    assert ids[3] == ids[2] - {r["doc_id"] for r in decontamination.contaminated(kept[2], items).collect()}
    assert ids[4] <= ids[3] and kept[4].filter("mix_copies < 1 OR mix_copies > 3").count() == 0
    assert all(k.columns == kept[0].columns for k in kept[:4])
    assert substrings.WINDOW == 35


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, folder, name):
    import duckdb

    from check import _rows

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df, cur = QUERIES[name](spark, folder), con.execute(ORACLE[name])
    assert _rows(df.columns, df.collect()) == _rows([c[0] for c in cur.description], cur.fetchall())


def test_entry_works_without_these_parts():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('attesta.llm', 'corpus_pipeline'):\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert q and not [n for n in q if n.startswith('op1') or n == 'pipeline'], q\n"
        "e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0], timeout=120)


@pytest.mark.parametrize("package", ["ahocorasick", "xxhash", "zstandard"])
def test_entry_works_without_their_packages(package):
    code = (
        "import sys, warnings\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        f"        if name == {package!r}:\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "with warnings.catch_warnings(record=True) as told:\n"
        "    warnings.simplefilter('always')\n"
        "    import __spark_entry__ as e\n"
        "assert told and len(e.queries()) > 200\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0], timeout=120)
