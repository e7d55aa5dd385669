"""Sinks: corpora, statistics, vocabularies, manifests."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def unique_name(base: str, now: datetime | None = None) -> str:
    """base_YYYYmmdd_HHMMSS."""
    return f"{base}_{(now or datetime.now(timezone.utc)).strftime('%Y%m%d_%H%M%S')}"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _beside(path: str, what: str) -> str:
    return f"{path.rstrip('/')}.{what}-{uuid.uuid4().hex[:12]}"


def replaced(spark: SparkSession, path: str, make) -> None:
    """make(folder) writes to a folder beside path, which then takes path's place.  Until the
    new output is whole the old one stays where it is; if the swap fails it is put back."""
    staged = _beside(path, "new")
    to, files = _hadoop(spark, path)
    new, old = _hadoop(spark, staged)[0], _hadoop(spark, _beside(path, "old"))[0]
    try:
        make(staged)
    except BaseException:
        files.delete(new, True)
        raise
    before = files.exists(to)
    if before and not files.rename(to, old):
        files.delete(new, True)
        raise OSError(f"{path} can't be moved away")
    if not files.rename(new, to):
        if before:
            files.rename(old, to)
        files.delete(new, True)
        raise OSError(f"{path} can't be put in place")
    if before:
        files.delete(old, True)


def write(df: DataFrame, path: str, *, format: str = "parquet", force: bool = False, partition_by: tuple[str, ...] = (), options: dict[str, str] | None = None) -> bool:
    """Writes unless the output is there already; force replaces it, by a folder written
    beside it first, so a job that fails leaves the old output.  True if written."""
    there = exists(df.sparkSession, path)
    if there and not force:
        return False

    def make(to: str) -> None:
        writer = df.write.format(format).options(**(options or {})).mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).save(to)

    if there:
        replaced(df.sparkSession, path, make)
    else:
        make(path)
    return True


def write_json_array(df: DataFrame, path: str, *, position: str | None = None, force: bool = False) -> bool:
    """One file that is one valid JSON array of the rows, in order of position (a column, which stays)
    or as they stand in their partitions.  Tasks write their parts, a comma before each row; the parts
    are then joined in order under the final name, in buffers of 1 MB."""
    spark = df.sparkSession
    if not force and exists(spark, path):
        return False
    ordered = df.orderBy(position) if position else df
    parts = _beside(path, "parts")
    folder, files = _hadoop(spark, parts)

    def make(to: str) -> None:
        row = F.to_json(F.struct(*[f"`{c}`" for c in df.columns]), {"ignoreNullFields": "false"})
        ordered.select(F.concat(F.lit(","), row).alias("value")).write.text(parts)
        out = files.create(_hadoop(spark, to)[0], True)
        try:
            out.write(bytearray(b"[\n"))
            names = sorted(str(s.getPath()) for s in files.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen())
            for k, name in enumerate(names):
                source = files.open(_hadoop(spark, name)[0])
                try:
                    source.seek(0 if k else 1)  # no comma before the first row
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                finally:
                    source.close()
            out.write(bytearray(b"]\n"))
        finally:
            out.close()

    try:
        replaced(spark, path, make)
    finally:
        files.delete(folder, True)
    return True


def write_corpus(df: DataFrame, path: str, **how) -> bool:
    """text, language, source, length, in folders by language."""
    rows = df.select("text", "language", "source", F.length("text").cast("int").alias("length"))
    return write(rows, path, partition_by=("language",), **how)


def write_instructions(df: DataFrame, path: str, force: bool = False) -> bool:
    """The rows, and beside them the distribution of tasks."""
    done = write(df, f"{path}/instructions", format="json", force=force)
    tasks = df.groupBy("task_category").agg(F.count("*").alias("n"))
    return write(tasks, f"{path}/task_distribution", format="json", force=force) and done


def write_statistics(stats: DataFrame, path: str, force: bool = True) -> bool:
    return write(stats.withColumn("written", F.current_timestamp().cast("string")).coalesce(1), path, format="json", force=force)


def write_texts(df: DataFrame, path: str, as_lines: bool = False, force: bool = False, encoding: str = "UTF-8") -> bool:
    """The texts alone, as lines or as JSON lines, in an encoding (of JSON lines)."""
    return write(df.select("text"), path, format="text" if as_lines else "json", force=force, options={} if as_lines else {"encoding": encoding})


def write_vocabulary(spark: SparkSession, vocab: dict[str, int], merges: list[tuple[str, str]], path: str, force: bool = True) -> None:
    write(spark.createDataFrame(list(vocab.items()), "token string, id int"), f"{path}/vocab", force=force)
    write(spark.createDataFrame([(k, *m) for k, m in enumerate(merges)], "rank int, a string, b string"), f"{path}/merges", force=force)


def read_vocabulary(spark: SparkSession, path: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """A vocabulary has a bounded size; it is kept on the driver."""
    vocab = {r["token"]: r["id"] for r in spark.read.parquet(f"{path}/vocab").collect()}
    return vocab, [(r["a"], r["b"]) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]


def write_chats(turns: DataFrame, path: str, force: bool = False) -> bool:
    """conv_id, turn, role, text as one JSON object a conversation, a line each, as chat_history reads
    them: its entries in order of turn.  A conversation is held as one row."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    chats = turns.groupBy("conv_id").agg(entries.alias("chat_history")).select("conv_id", F.current_timestamp().cast("string").alias("session_start"), "chat_history")
    return write(chats, path, format="json", force=force)


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """file, bytes and modified of all files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def disk_usage(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.round(F.coalesce(F.sum("bytes"), F.lit(0)) / 1048576, 1).alias("megabytes"))


def latest_checkpoint(files: DataFrame, needed: tuple[str, ...] = ("config.json",), weights: tuple[str, ...] = ("pytorch_model.bin", "model.bin")) -> DataFrame:
    """The checkpoint-* folder last in string order that holds all the files needed and
    weights under one of their usual names."""
    parts = files.select(F.regexp_extract("file", r"(checkpoint-[^/]+)/[^/]+$", 1).alias("checkpoint"), F.regexp_extract("file", r"([^/]+)$", 1).alias("name"))
    kind = F.when(F.col("name").isin(*weights), "weights").when(F.col("name").isin(*needed), F.col("name"))
    whole = parts.where(F.col("checkpoint") != "").groupBy("checkpoint").agg(F.count_distinct(kind).alias("n"))
    return whole.where(F.col("n") == len(needed) + 1).agg(F.max("checkpoint").alias("checkpoint"))
