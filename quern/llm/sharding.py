"""Sharding by sampled splitters, with DataFrame and SQL functions only.

Rows are ordered by (hash of the text, doc_id, a tie key), so equal texts are
neighbours.  A bounded, size-weighted sample of keys gives quantile boundaries;
rows are range-partitioned by them; ranges that hold too many bytes are
subdivided by further splitters until none is overfull.  The bytes before each
range plus a running sum inside it give the place of every row in the whole
order, and equal stretches of that order are the shards: their sizes differ by
no more than one row.  A third of all rows may share one text, or even be one
row repeated: the rest of the key still splits them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, text_or_empty

_KEY = ["__hash", "__id", "__tie"]
_KEY_JSON = "array<struct<h:bigint,i:bigint,t:bigint>>"


def _literal(rows: list, ddl: str) -> Column:
    """A constant array; Spark folds it to a literal."""
    return F.from_json(F.lit(json.dumps(rows)), ddl)


def _key() -> Column:
    return F.struct(*[F.col(c).alias(a) for c, a in zip(_KEY, "hit")])


def _splitters(rows: DataFrame, n: int, sample: int, seed: int) -> list:
    """n - 1 quantile boundaries of a sample of about `sample` keys (at most, on average), drawn with
    probability by size: each row gets an exponential arrival time at the rate of
    its size, and those before a time that follows from the whole size are the sample."""
    uniform = (F.shiftrightunsigned(F.xxhash64(*_KEY, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    arrival = -F.log(uniform) / F.col("size")
    # a row of size s arrives before t with probability 1 - exp(-s t), about s t, so a filter
    # leaves about `sample` rows, of which no task has to hold more than its own
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    drawn = rows.select(*_KEY, arrival.alias("arrival")).where(F.col("arrival") < sample / max(total, 1))
    ordered = drawn.agg(F.sort_array(F.collect_list(_key())).alias("k"))
    at = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda j: F.get("k", F.floor(j * F.size("k") / n).cast("int")))
    found = ordered.select(F.array_distinct(F.array_compact(at)).alias("s")).first()
    return [tuple(k) for k in found["s"]] if n > 1 else []


def _range_of(splitters: list) -> Column:
    """How many splitters are at or below the row's key, by binary search."""
    if not splitters:
        return F.lit(0)
    table = _literal([dict(zip("hit", s)) for s in splitters], _KEY_JSON)
    n, steps = len(splitters), [1 << k for k in reversed(range(len(splitters).bit_length()))]
    below = lambda at, step: (at + step <= n) & (F.get(table, at + step - 1) <= _key())
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(below(at, step), at + step).otherwise(at))


def _order_of(docs: DataFrame, doc_id: str) -> Column:
    """The id as a long: itself, or of other types a hash; null comes first."""
    whole = docs.schema[doc_id].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.coalesce(F.col(doc_id).cast("long") if whole else F.when(F.col(doc_id).isNotNull(), F.xxhash64(doc_id)), F.lit(-(1 << 63)))


def shard(
    docs: DataFrame, *, shards: int = 24, ranges_per_shard: int = 16, rows_per_range: int = 2_000_000, sample_per_range: int = 32, overfull: float = 2.0, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, shard, slot, and
    a struct `carried` of the columns named in carry.

    There are ranges_per_shard ranges to a shard, and more where a range would hold more
    than rows_per_range rows of mean size; sample and tables on the driver are bounded by
    that number and the two factors.  Ids may have any type.  Null text has no bytes (checksum 0), a
    null doc_id sorts first, repeated rows are separate rows, and fewer rows than
    shards leave shards empty.  An empty table gives an empty table."""
    body = text_or_empty(text)
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.struct(*carry).alias("carried") if carry else F.lit(None).cast("string").alias("carried"),
        F.conv(F.substring(F.md5(body.cast("binary")), 1, 15), 16, 10).cast("long").alias("__hash"),
        _order_of(docs, doc_id).alias("__id"),
        F.xxhash64(F.monotonically_increasing_id()).alias("__tie"),
    )
    rows = Table(base)
    ranges = max(shards * ranges_per_shard, -(-rows.read().count() // rows_per_range))
    splitters = _splitters(rows.read(), ranges, ranges * sample_per_range, 1)
    last_full = None
    while True:
        ranged = rows.read().withColumn("__range", _range_of(splitters))
        totals = {r["__range"]: (r["bytes"], r["n"]) for r in ranged.groupBy("__range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        total = sum(b for b, _ in totals.values())
        full = {k: b for k, (b, n) in totals.items() if n > 1 and b * ranges > overfull * total}
        # until none is overfull, or none of them could be divided
        if not full or sorted(full.values()) == last_full:
            break
        last_full = sorted(full.values())
        parts = sum(-(-b * ranges // total) for b in full.values())
        inside = ranged.where(F.col("__range").isin(list(full)))
        splitters = sorted({*splitters, *_splitters(inside, 2 * parts, 2 * parts * sample_per_range, 1 + len(splitters))})

    before, bytes_at, rows_at = [], 0, 0
    for k in range(len(splitters) + 1):
        before.append({"b": bytes_at, "r": rows_at})
        bytes_at, rows_at = bytes_at + totals.get(k, (0, 0))[0], rows_at + totals.get(k, (0, 0))[1]
    table = _literal(before, "array<struct<b:bigint,r:bigint>>")
    run = Window.partitionBy("__range").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, 0)
    place = ranged.select("*", F.sum("size").over(run).alias("__bytes"), F.count("*").over(run).alias("__rows"))
    start = F.get(table, F.col("__range"))["b"] + F.col("__bytes") - F.col("size")
    ranked = Table(
        place.select(
            "doc_id", "size", "text_crc32", "carried",
            F.least(F.lit(shards - 1), F.floor((start * shards).cast("decimal(38,0)") / max(total, 1))).cast("int").alias("shard"),
            (F.get(table, F.col("__range"))["r"] + F.col("__rows") - 1).alias("rank"),
        )
    )
    rows.drop()
    first = {r["shard"]: r["rank"] for r in ranked.read().groupBy("shard").agg(F.min("rank").alias("rank")).collect()}
    firsts = _literal([first.get(k, 0) for k in range(shards)], "array<bigint>")
    return ranked.read().select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.get(firsts, F.col("shard"))).alias("slot"), *(["carried"] if carry else []))


def write_shards(docs: DataFrame, path: str, *, shards: int = 24, text: str = "text", doc_id: str = "doc_id", files_per_shard: int = 1, slots_per_file: int = 1_000_000) -> None:
    """The rows as Parquet under path/shard=K, in slot order within each file.

    Null texts count 8 bytes and are kept as null; repeated rows and ties lie side by
    side, each written once; an empty table gives an empty folder."""
    assigned = shard(docs, shards=shards, text=text, doc_id=doc_id, carry=tuple(docs.columns))
    part = F.floor(F.col("slot") / slots_per_file)
    assigned.select("carried.*", F.col("shard").alias("shard"), F.col("slot").alias("__slot")).withColumn("__part", F.floor(F.col("__slot") / slots_per_file)).repartition(
        shards * files_per_shard, "shard", "__part"
    ).sortWithinPartitions("shard", "__slot").drop("__part", "__slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t
),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 8 AS size,
    ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
),
bytes AS (SELECT doc_id, size, h, hex(encode(text)) AS x FROM d),
crc AS (
  SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT],
      list_transform(range(size - 8), lambda i: ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::BIGINT)),
      lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) AS c
  FROM bytes, crc_table
),
p AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS before,
    row_number() OVER (ORDER BY h, doc_id) AS rank, sum(size) OVER () AS total
  FROM d
),
s AS (SELECT *, least(23, floor(before * 24 / total))::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, c::BIGINT AS text_crc32, 'bytes' AS law, shard,
  (rank - min(rank) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM s JOIN crc USING (doc_id)
"""
