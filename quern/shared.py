"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset the session's checkpoint folder.
    Without either a local master gets a temporary folder (tests on one machine); on a
    cluster that is an error, since executors would each write to their own disk."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


class Table:
    """A written table: computed once, its lineage cut, a lost executor costs its own tasks."""

    def __init__(self, df: DataFrame):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = f"{shared_dir(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """The same rows from a written table, which stays until the folder is emptied."""
    return Table(df).read()


def fresh(df: DataFrame, *stems: str) -> dict[str, str]:
    """A column name for each stem that df doesn't have (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, {}
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken or name.lower() + "_" in taken:
            name += "_"
        out[stem] = name
        taken.add(name.lower())
    return out
