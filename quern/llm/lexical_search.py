"""Ranked lexical search, document at a time over compressed postings.

Index: every task cuts its documents into shards of bounded text.  A shard's documents
are numbered in order of their ids; each term has its postings there, the gaps between
document numbers and the term frequencies as variable-length bytes.  Nothing is shuffled.

Search: the cursors of an item's terms stand in a heap by their next document.  The merge
goes through the shard in strides of document numbers: the heap gives the lists that have
documents in the next stride, their postings of it are summed, so all its documents are
complete, and lists without any are not touched.  Finished documents go to a bounded heap by
score, then document; each shard gives its best rows, and those of all shards are merged.

Terms are maximal runs of 0-9, A-Z, a-z and characters beyond ASCII, with A-Z lower-cased,
named by 64-bit hashes.  The score of a document (whole numbers, div rounds down):

    weight = floor(1000 * ln((2 N + 2) / (2 df + 1)))
    m      = 100 - 75 + (75 * n * N) div L
    score  = sum of weight * ((10**9 * tf) div (1000 * tf + 8 * m)), over the item's terms with repeats

N: documents with a term, L: all their terms, n: terms of the document, df: documents that
hold the term, tf: its occurrences in the document.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesnp import ALNUM_FOLDED, U64, flat, pieces, words
from .common import Table, u64

#: Bounds: distinct terms that are sent to the tasks (8 bytes each), bytes of items in one round.
_SENT_TERMS, _ITEM_BYTES = 1_000_000, 8 << 20
_SHIFT = U64(42)

# ------------------------------------------------------------------ compression


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of 7 bits each, the lowest first, all but a value's last with the high bit;
    and how many bytes each value has."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        size += values >= 1 << bits
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        there = size > k
        out[start[there] + k] = ((values[there] >> (7 * k)) & 0x7F) | ((size[there] > k + 1) * 0x80)
    return out, size


def unpack(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    last = np.flatnonzero(data < 0x80)
    if not len(last):
        return np.empty(0, np.int64)
    start = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(start, last - start + 1)
    return np.add.reduceat((data & 0x7F).astype(np.int64) << (7 * place), start)


# ------------------------------------------------------------------------ index


class Terms:
    """A set of terms: their first bits in a table, which rules out most others, and sorted."""

    def __init__(self, names: np.ndarray):
        self.names, self.bits = names, np.zeros(1 << 22, bool)
        self.bits[names >> _SHIFT] = True

    def has(self, term: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.zeros(len(term), bool)
        return self.names[np.minimum(np.searchsorted(self.names, term), len(self.names) - 1)] == term


def _terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) of all terms of a batch."""
    w = words(*flat(texts), ALNUM_FOLDED)
    return w.doc, w.hash


def _shard(held: list[pa.RecordBatch], number: int, terms: Terms | None, kind: pa.DataType) -> pa.RecordBatch:
    """A shard's rows: one of its documents (ids, lengths), then one for each term."""
    table = pa.Table.from_batches(held)
    table = table.take(pc.sort_indices(table.column("id"), null_placement="at_end"))
    document, name, length, done = [], [], [], 0
    for piece in pieces(table.to_batches(), "text"):
        doc, term = _terms_of(piece.column("text"))
        length.append(np.bincount(doc, minlength=piece.num_rows))
        if terms is not None:
            maybe = np.flatnonzero(terms.bits[term >> _SHIFT])
            maybe = maybe[terms.has(term[maybe])]
            doc, term = doc[maybe], term[maybe]
        document.append(doc + done)
        name.append(term)
        done += piece.num_rows
    length, document = np.concatenate(length), np.concatenate(document)
    name, of = np.unique(np.concatenate(name), return_inverse=True)
    place, tf = np.unique(of.astype(np.int64) * done + document, return_counts=True)
    of, document = place // done, place % done
    first = np.searchsorted(of, np.arange(len(name) + 1))
    gap = np.diff(document, prepend=0)
    gap[first[:-1]] = document[first[:-1]]
    body, size = pack(np.stack([gap, tf], axis=1).ravel())
    ends = np.concatenate([[0], np.cumsum(size)])[2 * first]
    lengths, _ = pack(length)
    offsets = np.concatenate([[0], len(lengths) + ends]).astype(np.int32)
    n = len(name)
    columns = {
        "shard": pa.array(np.full(n + 1, number, np.int64)),
        "term": pa.concat_arrays([pa.array([None], pa.int64()), pa.array(u64(name))]),
        "df": pa.array(np.concatenate([[np.count_nonzero(length)], np.diff(first)])),
        "n_terms": pa.array(np.concatenate([[length.sum()], np.zeros(n, np.int64)])),
        "ids": pa.ListArray.from_arrays(pa.array([0] + [done] * (n + 1), pa.int32()), table.column("id").combine_chunks().cast(kind)),
        "body": pa.Array.from_buffers(pa.binary(), n + 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(lengths.tobytes() + body.tobytes())]),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def index(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", terms: np.ndarray | None = None, shard_bytes: int = 16 << 20) -> DataFrame:
    """shard, term, df, n_terms, ids, body: for each shard a row without a term (df: its
    documents with a term, n_terms: all their terms, ids, body: the documents' lengths)
    and one for each term (df, body: postings); of only the given terms where these
    (sorted names) are given.

    Null text has no term; a document without terms has its place but counts nowhere; ids may
    have any type with an order, null comes last, rows that share an id are documents
    of their own.  An empty table gives an empty index."""

    def rows(batches):
        held, size, number, task = [], 0, 0, TaskContext.get().partitionId() << 32
        wanted = None if terms is None else Terms(terms)
        for batch in pieces(batches, "text"):
            held.append(batch)
            size += int(pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0) + 16 * batch.num_rows
            if size >= shard_bytes:
                yield _shard(held, task + number, wanted, batch.column("id").type)
                held, size, number = [], 0, number + 1
        if held:
            yield _shard(held, task + number, wanted, held[0].column("id").type)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(rows, f"shard long, term long, df long, n_terms long, ids array<{kind}>, body binary")


# ----------------------------------------------------------------------- search


def merge(lists: list[tuple[np.ndarray, np.ndarray]], best: int, stride: int) -> list[tuple[int, int]]:
    """(score, document) of the best documents, highest first, ties by document: a k-way
    merge of postings (ascending documents, gains), the next document of each in a heap."""
    cursors = [(int(docs[0]), k, 0) for k, (docs, _) in enumerate(lists) if len(docs)]
    heapq.heapify(cursors)
    found: list[tuple[int, int]] = []  # (score, -document), the worst first
    while cursors:
        low = cursors[0][0]
        until = low + stride
        documents, gains = [], []
        while cursors and cursors[0][0] < until:
            _, k, at = cursors[0]
            docs, gain = lists[k]
            to = at + int(np.searchsorted(docs[at:], until))
            documents.append(docs[at:to])
            gains.append(gain[at:to])
            if to < len(docs):
                heapq.heapreplace(cursors, (int(docs[to]), k, to))
            else:
                heapq.heappop(cursors)
        score = np.zeros(stride, np.int64)
        np.add.at(score, np.concatenate(documents) - low, np.concatenate(gains))
        hopeful = np.flatnonzero(score > (found[0][0] if len(found) == best else 0))
        if len(hopeful) > best:
            least = np.partition(score[hopeful], len(hopeful) - best)[len(hopeful) - best]
            hopeful = hopeful[score[hopeful] >= least]
        for d in hopeful.tolist():
            entry = (int(score[d]), -(low + d))
            if len(found) < best:
                heapq.heappush(found, entry)
            elif entry > found[0]:
                heapq.heapreplace(found, entry)
    return [(s, -d) for s, d in sorted(found, reverse=True)]


def _best_of_shard(items: list[tuple[int, np.ndarray, np.ndarray]], documents: int, tokens: int, best: int, stride: int, kind: str):
    """items: (key, terms, repeats); documents, tokens: N and L."""
    names = ["item", "score", "doc_id"]

    def rows(shard: pa.Table) -> pa.Table:
        head = shard.filter(pc.is_null(shard.column("term")))
        ids = head.column("ids").combine_chunks().flatten()
        m = 25 + (75 * unpack(head.column("body")[0].as_py()) * documents) // tokens
        listed = shard.filter(pc.greater(shard.column("weight"), 0))
        postings = {}
        for term, weight, body in zip(*(listed.column(c).to_pylist() for c in ("term", "weight", "body"))):
            gap, tf = unpack(body).reshape(-1, 2).T
            docs = np.cumsum(gap)
            postings[term] = docs, weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
        found = []
        for key, terms, repeats in items:
            lists = [(postings[t][0], postings[t][1] * q) for t, q in zip(terms.tolist(), repeats.tolist()) if t in postings]
            found += [(key, s, d) for s, d in merge(lists, best, stride)]
        key, score, doc = (np.array(x, np.int64) for x in (zip(*found) if found else ([], [], [])))
        return pa.table([pa.array(key), pa.array(score), ids.take(pa.array(doc))], names=names)

    return rows, f"item long, score long, doc_id {kind}"


def _read_items(items: DataFrame, text: str, item_id: str) -> Table:
    """key, item_id, terms, repeats: one row per row of items, its distinct terms."""

    def rows(batches):
        for batch in pieces(batches, "text"):
            doc, term = _terms_of(batch.column("text"))
            name, of = np.unique(term, return_inverse=True)
            place, n = np.unique(doc * max(len(name), 1) + of, return_counts=True)
            doc, name = place // max(len(name), 1), name[place % max(len(name), 1)]
            first = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(first, pa.array(v)) for v in (u64(name), n)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("item_id"), *lists], names=["key", "item_id", "terms", "repeats"])

    keyed = items.select(F.monotonically_increasing_id().alias("key"), F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    return Table(keyed.mapInArrow(rows, f"key long, item_id {items.schema[item_id].dataType.simpleString()}, terms array<long>, repeats array<long>"))


def search(
    docs: DataFrame, items: DataFrame, *, best: int = 10, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", indexed: DataFrame | None = None, stride: int = 1024, shard_bytes: int = 16 << 20
) -> DataFrame:
    """item_id, rank, doc_id, score: the `best` documents of each row of items that score
    above 0, equal scores by doc_id.

    Without `indexed` (an index of docs) the postings of the items' terms are made here;
    beyond 1,000,000 distinct terms the index has all.  Items go in rounds of 8 MB of
    terms; each round reads only its terms' postings.  Null and empty items find nothing,
    repeated items are items of their own, rows that share doc_id are documents of their
    own (of equal rank their order is open).  Empty tables give an empty table."""
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    asked = _read_items(items, item_text, item_id)
    terms = asked.read().select(F.explode("terms").alias("term"))
    entries = terms.count()
    sent = None
    if indexed is None:
        if entries <= _SENT_TERMS:
            sent = np.unique(np.array([r["term"] for r in terms.distinct().collect()], np.int64).view(U64))
        postings = Table(index(docs, text=text, doc_id=doc_id, terms=sent, shard_bytes=shard_bytes))
        indexed = postings.read()
    n, tokens = indexed.where("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    wanted = terms.distinct()
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long")
    counted = indexed.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weights = Table(counted.select("term", weight.alias("weight")))
    rounds = max(1, -(-16 * entries // _ITEM_BYTES))
    in_round = F.pmod(F.xxhash64("key"), F.lit(rounds))
    found: list[Table] = []
    for k in range(rounds if tokens else 0):
        block = [(r["key"], np.array(r["terms"], np.int64), np.array(r["repeats"], np.int64)) for r in asked.read().where(in_round == k).select("key", "terms", "repeats").collect()]
        mine = spark.createDataFrame(pa.table({"term": np.unique(np.concatenate([np.empty(0, np.int64), *(t for _, t, _ in block)]))}))
        # a round's terms are bounded, and so is this side
        known = F.broadcast(weights.read().join(F.broadcast(mine), "term"))
        # a shard's documents have weight null; a shard holds a bounded text, so the group is bounded
        rows = indexed.join(known, "term", "left").where("weight > 0 OR term IS NULL").select("shard", "term", "weight", "ids", "body")
        best_of, schema = _best_of_shard(block, n, tokens, best, stride, kind)
        found.append(Table(rows.groupBy("shard").applyInArrow(best_of, schema)))
    merged = spark.createDataFrame([], f"item long, score long, doc_id {kind}")
    for table in found:
        merged = merged.unionAll(table.read())
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = merged.withColumn("rank", rank).where(F.col("rank") <= best)
    return ranked.join(asked.read().select(F.col("key").alias("item"), "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
tf AS MATERIALIZED (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item, term, count(*) AS q FROM (SELECT item, unnest(w) AS term FROM i) GROUP BY ALL),
scored AS (
  SELECT item, row, sum(q * floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w) * s.n) // s.l))))::BIGINT AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN d USING (row), s GROUP BY item, row
),
ranked AS (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank FROM scored JOIN d USING (row) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN i USING (item) WHERE rank <= 10
"""
