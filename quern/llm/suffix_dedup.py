"""Suffix-array dedup by bucket-pointer refinement.

A byte goes if some string of `length` bytes that covers it also starts at any
other place of the corpus.  A full suffix array of the corpus is not needed to
decide that; its buckets are:

1. Bucket identifiers of q-grams come from recursion over later offsets: the
   bucket of 2q bytes at i is named by the pair (bucket of q bytes at i, bucket
   of q bytes at i + q), from 8 bytes up to 64 and 96 (`_buckets`).
2. Every string of `length` bytes is represented by the suffix that starts at
   its smallest 96-gram bucket identifier (leftmost of equals).  That choice
   depends on the string alone, so equal strings choose equal places.  Neighbouring
   strings share their suffix, about 50 of them each: a run.
3. Initial buckets: runs by that 96-gram.  Only buckets of two or more go on.
4. Refinement: in each bucket, runs are sorted into classes by the bucket
   identifiers of all the later offsets that they reach (the run's whole block of
   bytes).  A class of two or more is repeated in full.  A bucket with a single
   class is finished.
5. Otherwise one run of each class is cut, at fixed distances from its suffix, into
   stretches of 16 strings.  The bytes that a stretch's strings have in common are
   its bucket, its whole block of bytes is its class, and steps 3 and 4 are repeated
   with them.
6. What is still open is refined to single strings, named by the identifiers at
   later offsets up to `length` bytes, and regrouped one by one.

Every regrouping is a count with map-side combination, written, and joined back on the
group's key; Spark may split the large side.  No group is gathered anywhere.
The removed runs of bytes are then merged within each document (bounded by its
length) and cut out by native expressions.

Identifiers have 64 bits and are only compared within a bucket of equal 96-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytesnp import BYTE_CODE, U64, combine, flat, mix, pieces
from .common import Table, fresh, let, text_or_empty, u64

Q = 96


def _buckets(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of the 64-gram and of the 96-gram at every offset."""
    size = len(raw) - 7
    eight = np.zeros(max(size, 0), U64)
    for i in range(8):
        eight = (eight << U64(8)) | raw[i : i + size].astype(U64) if size > 0 else eight
    name, q = mix(eight + BYTE_CODE[0]), 8
    while q < 64:
        name = combine(name[:-q], name[q:]) if len(name) > q else name[:0]
        q *= 2
    return name, combine(name[:-32], name[32:]) if len(name) > 32 else name[:0]


def _span_names(b64: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of raw[start:end], 64 bytes or more each, by the 64-gram buckets at
    later offsets: every 64 bytes, and at the end."""
    last = end - 64
    name = combine(b64[start], (end - start).astype(U64))
    steps = int((end - start).max(initial=64)) // 64 + 1
    for k in range(1, steps + 1):
        name = combine(name, b64[np.minimum(start + 64 * k, last)])
    return name


def _uniform_names(b64: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    name = b64[start]
    for k in [*range(64, length - 64, 64), length - 64]:
        name = combine(name, b64[start + k])
    return name


def _runs(raw: np.ndarray, offsets: np.ndarray, length: int):
    """(document, first start, last start, bucket, block name) of every run: the
    strings of `length` bytes that share their representative suffix."""
    none = np.empty(0, np.int64)
    windows = len(raw) - length + 1
    if windows <= 0:
        return none, none, none, none.view(U64), none.view(U64)
    b64, b96 = _buckets(raw)
    span = length - Q + 1
    blocks = -(-len(b96) // span)
    table = np.full(blocks * span, ~U64(0))
    table[: len(b96)] = b96
    table = table.reshape(blocks, span)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(doc[:windows] == doc[length - 1 :])
    if not len(starts):
        return none, none, none, none.view(U64), none.view(U64)
    value = least[starts]
    # Where the same smallest 96-gram stands twice in reach, neighbouring strings
    # may choose different places; a new run then begins as the chosen place leaves.
    opens = np.ones(len(starts), bool)
    opens[1:] = (value[1:] != value[:-1]) | (starts[1:] != starts[:-1] + 1)
    gone = np.zeros(len(starts), bool)
    gone[1:] = b96[starts[:-1]] == value[:-1]  # the suffix began at the string before
    opens |= gone
    at = np.flatnonzero(opens)
    low, high = starts[at], starts[np.append(at[1:], len(starts)) - 1]
    return doc[low], low, high, value[at], _span_names(b64, low, high + length)


_RUN = "bucket long, block long, k1 long, k2 long, low int, n int"


def _run_rows(length: int):
    def rows(batches):
        for batch in pieces(batches, "text"):
            raw, offsets = flat(batch.column("text"))
            doc, low, high, bucket, block = _runs(raw, offsets, length)
            k1, k2 = (np.asarray(batch.column(k)) for k in ("k1", "k2"))
            arrays = [u64(bucket), u64(block), k1[doc], k2[doc], (low - offsets[doc]).astype(np.int32), (high - low + 1).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=[x.split()[0] for x in _RUN.split(", ")])

    return rows


#: Strings of a stretch.
STRETCH = 16

_STRETCH = "bucket long, block long, alone boolean, k1 long, k2 long, base int, low int, n int"


def _block_arrays(batch: pa.RecordBatch):
    raw, offsets = flat(batch.column("block_bytes").cast(pa.binary()).view(pa.utf8()))
    return raw, offsets, {k: np.asarray(batch.column(k)) for k in batch.schema.names if k not in ("block_bytes", "inner")}


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within it) for n things of each owner."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def _stretch_rows(length: int):
    """The stretches of each asked run."""

    def rows(batches):
        for batch in pieces(batches, "block_bytes"):
            raw, offsets, c = _block_arrays(batch)
            b64, b96 = _buckets(raw)
            owner, place = _spread(np.diff(offsets))
            owner, place = owner[: len(b96)], place[: len(b96)]
            bucket = c["bucket"].view(U64)
            at = np.flatnonzero((b96 == bucket[owner]) & (place <= length - Q))
            suffix = place[at[np.unique(owner[at], return_index=True)[1]]]
            last = suffix - (c["n"].astype(np.int64) - 1)
            first_part, parts = last // STRETCH, suffix // STRETCH - last // STRETCH + 1
            of, part = _spread(parts)
            part = part + first_part[of]
            far, near = np.minimum(suffix[of], part * STRETCH + STRETCH - 1), np.maximum(last[of], part * STRETCH)
            start = suffix[of] - far
            core = _uniform_names(b64, offsets[of] + suffix[of] - part * STRETCH, length - STRETCH + 1)
            name = combine(combine(bucket[of], part.astype(U64)), core)
            n = far - near + 1
            block = _span_names(b64, offsets[of] + start, offsets[of] + start + n - 1 + length)
            arrays = [u64(name), u64(block), c["members"][of] == 1, c["k1"][of], c["k2"][of], c["low"][of], (c["low"][of] + start).astype(np.int32), n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=[x.split()[0] for x in _STRETCH.split(", ")])

    return rows


_STRING = "bucket long, name long, alone boolean, k1 long, k2 long, low int"


def _string_rows(length: int):
    """The strings of each open stretch, from its run's block of bytes."""

    def rows(batches):
        for batch in pieces(batches, "block_bytes"):
            raw, offsets, c = _block_arrays(batch)
            inner = batch.column("inner")
            block = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(inner.offsets)))
            field = {k: np.asarray(inner.flatten().field(k)) for k in ("bucket", "low", "n")}
            alone = np.asarray(inner.flatten().field("alone").cast(pa.int8())).astype(bool)
            of, step = _spread(field["n"].astype(np.int64))
            low = field["low"][of] + step
            own = block[of]
            b64, _ = _buckets(raw)
            name = _uniform_names(b64, offsets[own] + low - c["low"][own], length)
            arrays = [field["bucket"][of], u64(name), alone[of], c["k1"][own], c["k2"][own], low.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=[x.split()[0] for x in _STRING.split(", ")])

    return rows


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """k1, k2 name a row by content: they don't change when a lost scan is redone.
    Rows that agree in both hold the same text and so lose the same bytes."""
    value = text_or_empty(text)
    return docs.select(F.xxhash64(value).alias("k1"), F.xxhash64(doc_id).alias("k2"), value.alias("text"))


def repeated_spans(docs: DataFrame, *, length: int = 200, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """k1, k2, spans: the maximal runs [from, to) of repeated bytes of each
    document that has any."""
    if not 2 * Q <= length + 64 or length < 128:
        raise ValueError("length must be 128 or more")
    keyed = _keyed(docs, text, doc_id)
    # written, so that the texts are named once
    runs = Table(keyed.where(F.octet_length("text") >= length).mapInArrow(_run_rows(length), _RUN))
    shared = Table(runs.read().groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").select("bucket"))
    candidates = Table(runs.read().join(shared.read(), "bucket", "left_semi"))
    runs.drop()
    shared.drop()

    rep = F.min(F.struct("k1", "k2", "low", "n")).alias("rep")
    classes = Table(candidates.read().groupBy("bucket", "block").agg(F.count("*").alias("members"), rep))
    mixed = Table(classes.read().groupBy("bucket").agg(F.count("*").alias("classes")).where("classes > 1").select("bucket"))
    asked = classes.read().join(mixed.read(), "bucket", "left_semi").select("bucket", "members", "rep.*")
    asked_of = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("bucket", "members", "low", "n")).alias("runs"))
    # A run's key may fit several equal rows; any of them has the same bytes.
    blocks = (
        keyed.join(asked_of, ["k1", "k2"])
        .dropDuplicates(["k1", "k2"])
        .select("k1", "k2", F.col("text").cast("binary").alias("bytes"), F.explode("runs").alias("run"))
        .select("k1", "k2", "run.*", F.expr(f"substring(bytes, run.low + 1, run.n + {length - 1})").alias("block_bytes"))
    )
    blocks = Table(blocks)

    stretches = Table(blocks.read().mapInArrow(_stretch_rows(length), _STRETCH))
    rep = F.min(F.struct(F.col("alone").alias("alone"), "k1", "k2", "base", "low", "n")).alias("rep")
    parts = Table(stretches.read().groupBy("bucket", "block").agg(F.count("*").alias("members"), rep))
    mixed_parts = Table(parts.read().groupBy("bucket").agg(F.count("*").alias("classes")).where("classes > 1").select("bucket"))
    still = parts.read().join(mixed_parts.read(), "bucket", "left_semi").select("bucket", "rep.k1", "rep.k2", "rep.base", "rep.low", "rep.n", (F.col("rep.alone") & (F.col("members") == 1)).alias("alone"))
    of_block = still.groupBy("k1", "k2", F.col("base").alias("low")).agg(F.collect_list(F.struct("bucket", "low", "n", "alone")).alias("inner"))
    opened = blocks.read().select("k1", "k2", "low", "block_bytes").join(of_block, ["k1", "k2", "low"])
    strings = Table(opened.mapInArrow(_string_rows(length), _STRING))
    blocks.drop()
    twice = Table(strings.read().groupBy("bucket", "name").agg(F.count("*").alias("times")).where("times > 1").select("bucket", "name"))
    singles = strings.read().where("alone").join(twice.read(), ["bucket", "name"], "left_semi").select("k1", "k2", "low", (F.col("low") + length).alias("high"))
    end = (F.col("low") + F.col("n") + (length - 1)).alias("high")
    several = parts.read().where("members > 1").select("bucket", "block")
    stretched = stretches.read().where("alone").join(several, ["bucket", "block"], "left_semi").select("k1", "k2", "low", end)
    full = classes.read().where("members > 1").select("bucket", "block")
    whole = candidates.read().join(full, ["bucket", "block"], "left_semi").select("k1", "k2", "low", end)

    row = Window.partitionBy("k1", "k2").orderBy("low")
    reach = F.max("high").over(row.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("opens").over(row.rowsBetween(Window.unboundedPreceding, 0))
    merged = (
        whole.unionByName(stretched).unionByName(singles)
        .groupBy("k1", "k2", "low")
        .agg(F.max("high").alias("high"))
        .withColumn("opens", F.when(F.col("low") <= reach, 0).otherwise(1))
        .withColumn("island", island)
        .groupBy("k1", "k2", "island")
        .agg(F.min("low").alias("from"), F.max("high").alias("to"))
        .groupBy("k1", "k2")
        .agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("spans"))
    )
    out = Table(merged)
    for table in (candidates, classes, mixed, stretches, parts, mixed_parts, strings, twice):
        table.drop()
    return out.read()


def _kept(raw: Column, spans: Column) -> Column:
    """The bytes outside of the spans, joined."""
    gaps = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.struct(
            F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["to"]).alias("from"),
            F.coalesce(F.get(spans, i)["from"], F.octet_length(raw)).alias("to"),
        ),
    )
    parts = F.transform(gaps, lambda g: F.hex(F.substring(raw, g["from"] + 1, g["to"] - g["from"])))
    return F.unhex(F.array_join(parts, ""))


def _whole_characters(raw: Column, spans: Column) -> Column:
    """Spans shrunk to whole code points, so that what is left is valid UTF-8."""
    tail = lambda at: F.length(F.regexp_extract(F.hex(F.substring(raw, at + 1, 3)), "^(?:[89AB].)*", 0)) / 2  # noqa: E731  continuation bytes from here on
    back = lambda at: F.length(F.regexp_extract(F.hex(F.substring(raw, F.greatest(at - 2, F.lit(1)), F.least(at, F.lit(3)))), "(?:[C-F].)?(?:[89AB].)*$", 0)) / 2  # noqa: E731  bytes since the last lead byte
    inward = F.transform(
        spans,
        lambda s: F.struct(
            (s["from"] + tail(s["from"])).cast("int").alias("from"),
            F.when(tail(s["to"]) > 0, s["to"] - back(s["to"])).otherwise(s["to"]).cast("int").alias("to"),
        ),
    )
    return F.filter(inward, lambda s: s["from"] < s["to"])


def remove_repeats(docs: DataFrame, *, length: int = 200, text: str = "text", doc_id: str = "doc_id", whole_characters: bool = False, into: str = "repeats") -> DataFrame:
    """Every row of docs with a struct `into` of n_bytes, n_removed, n_spans,
    spans and kept (the remaining bytes).

    Null or empty text: 0 bytes, nothing removed.  Texts shorter than `length`
    keep all.  Repeated rows and exact copies of `length` bytes or more lose
    everything.  Null doc_ids are allowed; further columns stay, whatever their
    names (one of the name of `into` is replaced).  whole_characters: spans shrink to whole code points (the kept bytes
    are then valid UTF-8).  An empty table gives an empty table."""
    key1, key2, own = fresh(docs, "key1", "key2", "spans")
    spans = repeated_spans(docs, length=length, text=text, doc_id=doc_id).select(F.col("k1").alias(key1), F.col("k2").alias(key2), F.col("spans").alias(own))
    value = text_or_empty(text)
    joined = docs.withColumns({key1: F.xxhash64(value), key2: F.xxhash64(doc_id)}).join(spans, [key1, key2], "left")
    raw = value.cast("binary")
    found = F.coalesce(own, F.array().cast("array<struct<from:int,to:int>>"))
    if whole_characters:
        found = F.when(F.col(own).isNull(), found).otherwise(_whole_characters(raw, found))
    result = let(
        F.struct(raw.alias("raw"), found.alias("spans")),
        lambda x: F.struct(
            F.octet_length(x["raw"]).cast("long").alias("n_bytes"),
            F.aggregate(x["spans"], F.lit(0).cast("long"), lambda n, s: n + (s["to"] - s["from"])).alias("n_removed"),
            F.size(x["spans"]).cast("long").alias("n_spans"),
            x["spans"].alias("spans"),
            F.when(F.size(x["spans"]) == 0, x["raw"]).otherwise(_kept(x["raw"], x["spans"])).alias("kept"),
        ),
    )
    return joined.withColumn(into, result).drop(key1, key2, own)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", F.sha2("repeats.kept", 256).alias("kept_sha256")
    )


#: Every string of 200 bytes in hexadecimal, by its md5.
SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
s AS MATERIALIZED (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT r, x, unnest(range(n - 199)) AS i FROM d WHERE n >= 200)),
p AS (SELECT r, i FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
o AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM p),
spans AS (SELECT r, min(i) AS a, max(i) + 200 AS z FROM (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS span FROM o) GROUP BY r, span),
gaps AS (
  SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS f, a AS t FROM spans
  UNION ALL SELECT r, max(z), max(n) FROM spans JOIN d USING (r) GROUP BY r
  UNION ALL SELECT r, 0, n FROM d WHERE r NOT IN (SELECT r FROM spans)
),
kept AS (SELECT r, string_agg(substr(x, (2 * f + 1)::BIGINT, (2 * (t - f))::BIGINT), '' ORDER BY f) AS h FROM gaps JOIN d USING (r) GROUP BY r),
gone AS (SELECT r, sum(z - a) AS removed, count(*) AS spans FROM spans GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN gone USING (r)
"""
