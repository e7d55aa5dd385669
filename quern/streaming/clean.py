"""The cleaning pipeline over a stream of files, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions import text as T
from ..plans.pipelines import SUPPORTED, passing


def read_stream(spark: SparkSession, path: str, schema: str, format: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    """The files of a folder as they come; a path that is a single file is watched
    through its folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(format)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).load(at.getParent().toString())
    return reader.load(path)


def clean_stream(records: DataFrame, rules: T.DocumentRules = T.DocumentRules(), ts: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rules per row, then the first row of each hash.  With a time column the state of
    hashes is dropped `delay` behind the newest row; without one it keeps every hash,
    which suits bounded runs only."""
    passed = passing(records, rules).where(F.col("language").isin(*SUPPORTED))
    if ts:
        return passed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["hash"])
    return passed.dropDuplicates(["hash"])


def take(stream: DataFrame, n: int) -> DataFrame:
    """The first n rows that come (append mode)."""
    return stream.limit(n)


def windowed_counts(events: DataFrame, ts: str, size: str, delay: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Rows and value sums by tumbling or sliding window."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, delay).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def session_counts(events: DataFrame, ts: str, gap: str, delay: str, *keys: str) -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))


def session_updates(events: DataFrame, ts: str, gap: str, delay: str, *keys: str) -> DataFrame:
    """start, last, n, total of each session and key, for run_sessions: the state keeps a session open until
    the watermark has passed its last event by the gap, and a row between two open sessions
    makes them one."""
    window = F.session_window(ts, gap).alias("w")
    counted = events.withWatermark(ts, delay).groupBy(window, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def run_stopping(stream: DataFrame, path: str, checkpoint: str, stop_after: int | None = None) -> bool:
    """Runs over what there is now, in append mode, each batch written under its number, so a batch that is
    done again replaces itself: every row is there once however often the run stops.  With
    stop_after it stops after so many batches; True if it came to the end.  Run again on
    the same checkpoint it takes up offsets and state where they were."""
    done, running = [], []

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        done.append(number)
        if stop_after is not None and len(done) >= stop_after:
            running[0].stop()

    running.append(stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start())
    running[0].awaitTermination()
    return stop_after is None or len(done) < stop_after


def batches_written(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What run_stopping has written, of all its runs."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def run_updates(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Runs over what there is now in update mode; the last state of each key, from the
    updates written as Parquet with the number of their batch."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("__batch", LongType()), StructField("batch", IntegerType())])
    updates = stream.sparkSession.read.schema(schema).parquet(path)
    values = [c for c in stream.columns if c not in keys]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "__batch").alias("__last"))
    return last.select(*keys, *[F.col("__last")[c].alias(c) for c in values])


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs over what there is now, into Parquet; returns that."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
