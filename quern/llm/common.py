"""What the operators share: intermediate tables and small column helpers."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared

#: Settings while a table is written: shuffle files go when the query ends, and Arrow
#: batches stay small, since each task holds some of them in both processes.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def _while_writing(spark: SparkSession, arrow_rows: int):
    settings = _WHILE_WRITING | {"spark.sql.execution.arrow.maxRecordsPerBatch": str(arrow_rows)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Table(shared.Table):
    """A written table in the shared folder: cuts lineage like checkpoint(), keeps
    columns compressed, survives the loss of executors and can be dropped.  arrow_rows:
    rows of an Arrow batch, fewer where a row is large."""

    def __init__(self, df: DataFrame, arrow_rows: int = 1000):
        with _while_writing(df.sparkSession, arrow_rows):
            super().__init__(df)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that begin like these and that no column of df has."""
    there = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in there:
            name += "_"
        there.add(name.lower())
        out.append(name)
    return out


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def text_names(text: str) -> tuple[Column, Column]:
    """Two longs, of 64 and 60 bits of two hashes, that name a text by its bytes."""
    value = text_or_empty(text)
    return F.xxhash64(value), F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def u64(numbers):
    """uint64 names as the signed longs that Spark keeps."""
    return numbers.view("int64")
