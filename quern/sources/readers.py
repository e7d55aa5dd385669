"""Scans: JSON lines, JSON arrays, text lines, registered sources, chat files."""

from __future__ import annotations

import logging

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .. import schemas
from ..functions.extract import configured_text, language_matches, text_by_source
from ..operators.order import head, head_per_source
from ..shared import fresh
from .specs import SourceSpec, active

log = logging.getLogger(__name__)

#: Sentences for runs without a training file, and for a tokenizer without its sources.
FALLBACK_SENTENCES = (
    "아침마다 강가를 따라 천천히 걷습니다.", "도서관에는 조용히 읽을 자리가 많아요.", "비가 그친 뒤에 무지개가 보였습니다.", "시장에서 사과와 배를 샀어요.",
    "The ferry leaves the harbour at noon.", "Bread tastes best while it is warm.", "겨울에는 해가 일찍 집니다.", "기차를 타고 바다를 보러 갔습니다.",
)
FALLBACK_TOKENIZER_TEXTS = (
    "어제 저녁에는 친구와 함께 국수를 먹었습니다.", "We painted the old fence on Saturday morning.", "창문을 열자 시원한 바람이 들어왔어요.",
    "Please water the plants while I am away.", "이 길로 곧장 가면 작은 다리가 나옵니다.", "A small lamp stood beside the wooden chair.",
)


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores where the scan gives fewer partitions than there are
    cores (a single small file); a large scan stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def json_lines(spark: SparkSession, path: str, schema: str = schemas.RAW, glob: str = "*.jsonl", strip_prefix: str = "", named: str | None = None) -> DataFrame:
    """All matching files; source is the file's name without its ending (and prefix), or the
    first group of the pattern `named` in its whole path.  Lines that aren't JSON objects are left out."""
    corrupt = "_corrupt"
    rows = spark.read.schema(f"{schema}, {corrupt} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).option("pathGlobFilter", glob).json(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), named, 1) if named else F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return rows.where(F.col(corrupt).isNull()).withColumn("source", F.regexp_replace(name, f"^{strip_prefix}", "")).drop(corrupt)


def corrupt_lines(spark: SparkSession, path: str, schema: str = schemas.RAW, glob: str = "*.jsonl") -> DataFrame:
    """The lines that json_lines leaves out, with their file."""
    rows = spark.read.text(path, pathGlobFilter=glob).where(F.length(F.trim("value")) > 0).withColumn("file", F.col("_metadata.file_name"))
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return rows.where(parsed.isNull() | parsed["_corrupt"].isNotNull()).select("file", "value")


def instruction_lines(spark: SparkSession, path: str) -> DataFrame:
    """instruction_raw_<source>.jsonl below a folder: files, or folders of that name with the parts that Spark wrote."""
    return json_lines(spark, f"{path}/instruction_raw_*.jsonl", schemas.RAW_INSTRUCTION, "*", named=r"/instruction_raw_([^/]*)\.jsonl(?:/[^/]*)?$")


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that is one JSON array: of objects, or of strings as column text.  Where the brackets
    have lines of their own and no element spans lines (as write_json_array lays it out) lines are
    parsed, by as many tasks as the file has splits; any other layout is one task a file."""
    element = StructType.fromDDL(schema) if schema else StringType()
    lines = spark.read.text(path)
    # a comma stands before or after an element
    value = F.btrim("value", F.lit(" \t\r,"))
    parsed = F.from_json(F.concat(F.lit("["), value, F.lit("]")), ArrayType(element))
    outer = value.isin("[", "]", "")
    n = lambda c: F.count_if(c)
    other = lines.groupBy(F.col("_metadata.file_path")).agg(n(value == "[").alias("opens"), n(value == "]").alias("closes"), n(~outer & parsed.isNull()).alias("cut"))
    if other.where("opens != 1 OR closes != 1 OR cut > 0").isEmpty():
        rows = lines.where(~outer).select(F.explode(parsed).alias("text"))
        return rows.select("text.*") if schema else rows
    if schema:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "array<string>")).alias("text"))


def training_lines(spark: SparkSession, path: str, name: str = "mixed_pretraining.jsonl") -> DataFrame:
    """text of the training file, or without one 1,000 made-up rows."""
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found):
        return spark.read.schema("text string").json(f"{path}/{name}").where("text IS NOT NULL")
    options = F.array(*[F.lit(s) for s in FALLBACK_SENTENCES])
    turn = (F.col("id") % len(FALLBACK_SENTENCES)).cast("int") + 1
    return spark.range(1000).select(F.concat(F.element_at(options, turn), F.lit(" 샘플 "), (F.col("id") + 1).cast("string"), F.lit("번째 문장입니다.")).alias("text"))


def vocabulary_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """text: the field of .jsonl files (missing is empty), the lines of .txt files."""
    out = spark.createDataFrame([], "text string")
    for path in paths:
        if path.endswith(".jsonl"):
            out = out.unionByName(spark.read.schema("text string").json(path).select(F.coalesce("text", F.lit("")).alias("text")))
        elif path.endswith(".txt"):
            out = out.unionByName(spark.read.text(path).select(F.col("value").alias("text")))
    return out


def tokenizer_sample(korean: DataFrame | None, english: DataFrame | None, position: str, spark: SparkSession, rows: int = 5000, longer_than: int = 100) -> DataFrame:
    """The first rows of each language, then those long enough; a few fixed sentences
    where a language can't be had."""
    if korean is None or english is None:
        return spark.createDataFrame([(t,) for t in FALLBACK_TOKENIZER_TEXTS], "text string")
    heads = [head(d, position, rows).select("text") for d in (korean, english)]
    return heads[0].unionByName(heads[1]).where(F.length("text") > longer_than)


def head_in_files(spark: SparkSession, format: str, path: str, field: str, limit: int) -> DataFrame:
    """The first `limit` rows as they stand in the files, by file and place.  Files are counted in
    order, one, then as many again, until there are enough rows (Parquet by its footers);
    files before the one with the last row are taken whole, and of that one the rows before
    a row index, or where the format has none the splits before one, of which alone rows are numbered."""
    raw = spark.read.format(format).load(path)
    files = sorted(raw.inputFiles())
    if not files:
        return raw.limit(limit)
    base = {} if len(files) == 1 else {"basePath": path}
    load = lambda some: spark.read.format(format).schema(raw.schema).options(**base).load(some)
    at, taken, total = F.col("_metadata.file_path"), 0, 0
    counts: dict[str, int] = {}
    while taken < len(files) and total < limit:
        more = files[taken : taken + max(1, taken)]
        taken += len(more)
        # text formats parse a row as the scan below does only where a field is asked for
        counted = load(more).groupBy(at.alias("file")).agg(F.count("*").alias("n"), *([] if format == "parquet" else [F.count(field)]))
        counts |= {r["file"]: r["n"] for r in counted.collect()}
        total = sum(counts.values())
    leading, before, last = load(files[:taken]), 0, None
    for file in sorted(counts):
        if before + counts[file] > limit:
            last = file
            break
        before += counts[file]
    if last is None:
        return leading
    need, whole, own = limit - before, leading.where(at < last), leading.where(at == last)
    if format == "parquet":
        return leading.where((at < last) | (at == last) & (F.col("_metadata.row_index") < need))
    start = F.col("_metadata.file_block_start")
    split = 0
    for block, n in sorted(tuple(r) for r in own.groupBy(start.alias("b")).agg(F.count("*"), F.count(field)).select("b", "count(1)").collect()):
        split = block
        if n > need:
            break
        need -= n
        split = block + 1
    x = fresh(raw, "place", "number")
    placed = own.where(start == split).withColumn(x["place"], F.monotonically_increasing_id())
    # the rows of one split
    numbered = placed.withColumn(x["number"], F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(x["place"])))
    return whole.unionByName(own.where(start < split)).unionByName(numbered.where(F.col(x["number"]) <= need).drop(*x.values()))


def read_source(spark: SparkSession, spec: SourceSpec, mode: str = "full", position: str | None = None) -> DataFrame:
    """text, source, language of one source: raw rows up to the limit, the language
    filter, the text field stripped and cut, then the minimum length.  The limit takes
    the first rows by position, or without one by their place in the files."""
    limit = spec.limits.get(mode)
    if limit is None:
        raw = spark.read.format(spec.format).load(spec.path)
    elif position:
        raw = head(spark.read.format(spec.format).load(spec.path), position, limit)
    else:
        raw = head_in_files(spark, spec.format, spec.path, spec.text_field, limit)
    return _of_source(raw, spec)


def _of_source(raw: DataFrame, spec: SourceSpec) -> DataFrame:
    if spec.filter_field and spec.filter_value:
        raw = raw.where(language_matches(F.col(spec.filter_field), spec.filter_value))
    text = configured_text(F.col(spec.text_field), spec.max_text_length)
    return raw.select(text.alias("text"), F.lit(spec.name).alias("source"), F.lit(spec.language).alias("language")).where(F.length("text") >= max(1, spec.min_text_length))


def read_sources(spark: SparkSession, specs: list[SourceSpec], mode: str = "full", position: str | None = None, failed: dict[str, str] | None = None, strict: bool = False) -> DataFrame:
    """All enabled sources by priority.  One that can't be read is logged and left out (its
    fallback action, skip or continue, says no more than that), and named in `failed` with
    its error where a dict is given; strict raises the error instead."""
    out = spark.createDataFrame([], "text string, source string, language string, priority int")
    for spec in active(specs):
        try:
            out = out.unionByName(read_source(spark, spec, mode, position).withColumn("priority", F.lit(spec.priority)))
        except PySparkException as error:  # no such path, field or format
            if strict:
                raise
            if failed is not None:
                failed[spec.name] = str(error)
            log.warning("source %s: %s (%s)", spec.name, error, spec.fallback_action)
    return out


def fixed_sources(frames: dict[str, DataFrame], limits: dict[str, int], position: str) -> DataFrame:
    """Raw rows of several sources, each up to its own limit, with the source's name."""
    parts = [head_per_source(df.withColumn("source", F.lit(name)), "source", position, limits[name]) if name in limits else df.withColumn("source", F.lit(name)) for name, df in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def corpus_records(raw: DataFrame) -> DataFrame:
    """The raw rows with a text, and that text."""
    return raw.withColumn("text", text_by_source(raw)).where("text IS NOT NULL")


def chat_history(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """conv_id, turn, role, text of saved chats, one file each; with `lines` of files with
    one chat a line, which name their conv_id."""
    if lines:
        rows = spark.read.schema("conv_id long, chat_history array<struct<role:string,content:string>>").json(path)
        return rows.select("conv_id", F.posexplode("chat_history").alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("m.role").alias("role"), F.col("m.content").alias("text"))
    schema = "session_start string, settings map<string,string>, chat_history array<struct<role:string,content:string>>"
    files = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("conv_id", F.xxhash64(F.col("_metadata.file_path")))
    return files.select("conv_id", F.posexplode("chat_history").alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def stream_source(spark: SparkSession, spec: SourceSpec, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """The rows of a source marked for streaming, as they come: the same columns and rules
    as read_source, without its limit (see stream_head)."""
    return _of_source(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(spec.format).load(spec.path), spec)


def stream_head(spark: SparkSession, spec: SourceSpec, schema: str, path: str, checkpoint: str, mode: str = "full", files_per_trigger: int = 1) -> DataFrame:
    """A source read as a stream up to its limit: the first raw rows in order of the files' arrival, then of
    their place, with read_source's rules.  The stream stops as soon as it has them, so
    later files are never opened; run again on the same checkpoint it goes on where it was."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(spec.format).load(spec.path)
    limit = spec.limits.get(mode)
    x = fresh(raw, "file", "block", "row")
    index = F.col("_metadata.row_index") if spec.format == "parquet" else F.monotonically_increasing_id()
    placed = raw.withColumns({x["file"]: F.col("_metadata.file_path"), x["block"]: F.col("_metadata.file_block_start"), x["row"]: index})
    started: list = []

    def counted(below: int) -> int:
        """Raw rows in the batches before this one, by what they have written."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/counts")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return 0
        return spark.read.schema("n long, batch long").parquet(f"{path}/counts").where(F.col("batch") < below).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def save(batch: DataFrame, number: int) -> None:
        left = None if limit is None else limit - counted(number)
        if left is None or left > 0:
            rows = batch if left is None else batch.orderBy(*[x[k] for k in ("file", "block", "row")]).limit(left)
            # a batch that is done again replaces what it wrote before
            _of_source(rows, spec).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
            read = min(batch.count(), left if left is not None else 1 << 62)
            spark.createDataFrame([(read,)], "n long").write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
            left = None if left is None else left - read
        if left is not None and left <= 0:
            started[0].stop()

    started.append(placed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start())
    started[0].awaitTermination()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "text string, source string, language string")
    return spark.read.schema("text string, source string, language string").parquet(f"{path}/rows").select("text", "source", "language")


def sample_instructions(spark: SparkSession) -> DataFrame:
    """Three pairs in each language, to try things with."""
    rows = [
        ("한국의 수도는 어디인가요?", "", "한국의 수도는 서울입니다.", "ko"), ("다음 문장을 요약하세요.", "오늘은 날씨가 맑고 바람이 적게 붑니다.", "맑고 바람이 적은 날입니다.", "ko"),
        ("건강에 좋은 습관을 알려주세요.", "", "규칙적인 운동과 충분한 수면이 좋습니다.", "ko"), ("What is the capital of Korea?", "", "The capital of Korea is Seoul.", "en"),
        ("Summarize the sentence.", "It is sunny today and there is little wind.", "A sunny, calm day.", "en"), ("Tell me one healthy habit.", "", "Sleep long enough every night.", "en"),
    ]
    return spark.createDataFrame(rows, "instruction string, input string, output string, language string")
