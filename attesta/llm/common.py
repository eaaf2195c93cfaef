"""Helpers that the operators share: reading, written tables, words, columns of any name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from attesta.session import shared_folder

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
#: ``bytes.split()`` cuts at exactly these, unlike ``str.split()``, which also cuts at other Unicode blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: computed once, and safe when executors are lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def by_batch(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], Iterator[dict[str, list]]]) -> DataFrame:
    """``mapInArrow`` with column lists out: ``work`` yields ``{column: values}`` per batch or part of it."""
    struct = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(struct)
        for batch in batches:
            for out in work(batch):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def col(name: str) -> Column:
    """A column by its whole name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed_row(df: DataFrame) -> Column:
    """All columns of the frame as one struct, so that a job's own names cannot meet theirs; ``struct.*`` opens it again."""
    return F.struct(*[col(c) for c in df.columns])

