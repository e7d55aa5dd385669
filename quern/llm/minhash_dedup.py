"""Near-duplicate documents by ProbMinHash, banding and verification.

Signature: every shingle of `size` words is a Poisson process whose rate is its
weight, 1 for each distinct shingle, since links are decided by sets.  Its arrivals go
to random registers; a register keeps the earliest arrival, and a shingle stops as
soon as its next arrival is later than all registers of its document (early
termination).  Two documents agree in a register with probability equal to their
probability Jaccard similarity.  With weight 1 that is the Jaccard similarity of
their sets; larger weights would let it fall below that.

Banding: rows of the signature form bands; documents that agree in a band share a
bucket.  Each bucket is represented by its most central member, the one with the
most bucket mates in all, and every member is compared with that hub.

The rest: members that the hub's class doesn't hold are compared with all other
members of the hub's buckets.  This goes by blocks of bounded size, whose signatures
meet in one numpy comparison; only pairs whose estimate comes near the threshold
become rows.  So no bucket is expanded into pairs and none is cut short.

A group of more than a block gets further hubs first, a few rounds of one comparison
a member.  Jaccard distance is a metric: members linked to hub A can't be linked to
members linked to hub B if the hubs lie further apart than both reach and the threshold
together.  Such members need no comparison with each other.  If more than a block is left
still, as where a template makes texts similar but not near duplicates, they meet by their
rarest shingles (a prefix filter), and only those that may be linked by frequent shingles
alone go into blocks.

Verification: the Jaccard similarity of the two texts' sets of 64-bit shingle names.
Classes are the connected components of the verified links, found by alternating
large-star and small-star steps.  All this is between different texts: rows of equal
text are one text from the start, whatever their ids.

Aggregates by a key that may be hot (a bucket, a hub, a class) are written before they
are joined back, so that both sides of the join come by a plain exchange and Spark may
split the large one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesnp import SPACE_FOLDED, U64, combine, flat, mix, pieces, window_names, words
from .common import Table, fresh, text_or_empty, text_names, u64

# ---------------------------------------------------------------- signatures


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, name, count) of the distinct shingles of each document, by
    document and name.  A text of fewer words is one shingle of all its words."""
    w = words(raw, offsets, SPACE_FOLDED)
    at, name = window_names(w.hash, w.doc, size)
    doc = w.doc[at]
    n_words = np.diff(w.first)
    few = np.flatnonzero((n_words > 0) & (n_words < size))
    short = np.zeros(len(few), U64)
    for k in range(size - 1):
        there = n_words[few] > k
        short[there] = combine(short[there], w.hash[w.first[few[there]] + k])
    doc, name = np.concatenate([doc, few]), np.concatenate([name, mix(short + U64(1))])
    order = np.lexsort((name, doc))
    doc, name = doc[order], name[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])
    first = np.flatnonzero(new)
    return doc[first], name[first], np.diff(np.append(first, len(doc)))


def prob_min_hash(doc: np.ndarray, name: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """n_docs x registers names of the shingles that arrived first."""
    earliest = np.full(n_docs * registers, np.inf)
    chosen = np.zeros(n_docs * registers, U64)
    time = np.zeros(len(doc))
    latest = np.full(n_docs, np.inf)
    turn = 0
    while len(doc):
        turn += 1
        random = mix(name + U64(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
        time = time - np.log((np.right_shift(random, U64(11)).astype(float) + 0.5) / float(1 << 53)) / weight
        live = time < latest[doc]
        doc, name, weight, time, random = doc[live], name[live], weight[live], time[live], random[live]
        slot = doc * registers + (mix(random + U64(1)) % U64(registers)).astype(np.int64)
        np.minimum.at(earliest, slot, time)
        first = earliest[slot] == time
        chosen[slot[first]] = name[first]
        touched = np.unique(doc)
        latest[touched] = earliest.reshape(n_docs, registers)[touched].max(axis=1)
    return chosen.reshape(n_docs, registers)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Probability Jaccard similarity, as two signatures estimate it."""
    return float((a == b).mean())


_SIGNED = "n int, bands array<long>, signature binary"


def _signed(size: int, bands: int, rows_per_band: int):
    def rows(batches):
        for batch in pieces(batches, "text"):
            raw, offsets = flat(batch.column("text"))
            n_docs = len(offsets) - 1
            doc, name, _ = shingles(raw, offsets, size)
            signature = prob_min_hash(doc, name, np.ones(len(doc)), n_docs, bands * rows_per_band)
            n = np.bincount(doc, minlength=n_docs)
            keys = np.tile(mix(np.arange(1, bands + 1, dtype=U64)), (n_docs, 1))
            for k in range(rows_per_band):
                keys = combine(keys, signature[:, k::rows_per_band])
            has = n > 0
            offs = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(u64(keys[has].ravel())))
            short = pa.array([row.tobytes() for row in (signature >> U64(48)).astype(np.uint16)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("c1", "c2", "id")], pa.array(n.astype(np.int32)), lists, short], names=["c1", "c2", "id", "n", "bands", "signature"])

    return rows


def _sets(size: int):
    def rows(batches):
        for batch in pieces(batches, "text"):
            raw, offsets = flat(batch.column("text"))
            doc, name, _ = shingles(raw, offsets, size)
            offs = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(offs), pa.array(u64(name)))], names=["node", "set"])

    return rows


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> Table:
    """node, label: the smallest node of its connected component, for all nodes of
    the edges (a, b).  Alternating large-star and small-star steps on tables; each
    step is a minimum with map-side combination and a join that Spark may split."""
    current = Table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    while True:
        e = current.read()
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = Table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        large = both.join(least.read(), F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        stars = Table(large)
        e2 = stars.read()
        low = Table(e2.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"))
        small = e2.join(low.read(), F.col("a") == F.col("u")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        following = Table(small.where("a > b").distinct())
        for table in (least, stars, low, current):
            table.drop()
        current = following
        state = tuple(current.read().agg(F.count("*"), F.sum((F.xxhash64("a", "b") % (1 << 31)).cast("decimal(20,0)"))).first())
        if state == before:
            break
        before = state
    e = current.read()
    out = Table(e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct())
    current.drop()
    return out


# -------------------------------------------------------------- deduplication


def _named(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    c1, c2 = text_names(text)
    return docs.select(c1.alias("c1"), c2.alias("c2"), F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))


def _classes(docs: DataFrame, text: str, doc_id: str, size: int, similarity: float, bands: int, rows_per_band: int, margin: float) -> Table:
    """c1, c2, id, rows, label of all different texts: id is the smallest doc_id that has
    the text, label names its class."""
    named = _named(docs, text, doc_id)
    id_type = named.schema["id"].dataType.simpleString()
    signed = named.mapInArrow(_signed(size, bands, rows_per_band), f"c1 long, c2 long, id {id_type}, {_SIGNED}")
    # map-side combination: rows of a text that many share are one before the shuffle
    each = signed.groupBy("c1", "c2").agg(F.min("id").alias("id"), F.count("*").alias("rows"), *[F.any_value(c).alias(c) for c in ("n", "bands", "signature")])
    texts = Table(each.withColumn("node", F.monotonically_increasing_id()))
    first = texts.read()

    banded = first.select("node", "n", F.posexplode("bands").alias("band", "key"))
    counts = Table(banded.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1"))
    shared = Table(banded.join(counts.read(), ["band", "key"]))
    mates = shared.read().groupBy("node").agg(F.sum("members").alias("mates"))
    scored = shared.read().join(mates, "node")
    hubs = Table(scored.groupBy("band", "key").agg(F.max(F.struct("mates", (-F.col("node")).alias("minus"), "n")).alias("h")))
    hub = shared.read().join(hubs.read(), ["band", "key"]).select("node", "n", (-F.col("h.minus")).alias("hub"), F.col("h.n").alias("hub_n"))
    grouped = Table(hub.distinct())
    for table in (counts, shared, hubs):
        table.drop()

    # the candidates grow with the corpus, so they are merged, not broadcast; of the rows
    # of one text only those of its smallest id meet
    spread = F.xxhash64("id").alias("spread")
    asked = first.select("c1", "c2", spread, "node").join(grouped.read().select("node").distinct(), "node", "left_semi")
    fetched = named.select("c1", "c2", spread, "text").join(asked.hint("merge"), ["c1", "c2", "spread"]).dropDuplicates(["c1", "c2", "spread"])
    sets = Table(fetched.select("node", "text").mapInArrow(_sets(size), "node long, set array<long>"))
    fits = F.least("n", "hub_n") >= F.greatest("n", "hub_n") * similarity
    pairs = grouped.read().where((F.col("node") != F.col("hub")) & fits).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    links = Table(_verified(pairs, sets.read(), similarity))
    labels = components(links.read())
    compared = first.select("node", "signature").join(sets.read(), "node")
    marked = Table(_marked(grouped.read(), labels.read()))
    sizes = Table(_sizes(marked.read()))
    rounds: list[Table] = []
    if sizes.read().where(F.col("all_n") > _BLOCK).limit(1).count():
        marked, sizes, rounds = _further_hubs(marked, sizes, links.read(), sets.read(), similarity)
    if sizes.read().where(F.col("odd_n") > _BLOCK).limit(1).count():
        marked, sizes, alike = _by_rare_shingles(marked, sizes, sets.read(), first.select("node", "signature"), similarity, margin, bands * rows_per_band)
        rounds.append(alike)
    more = Table(_rest(marked.read(), sizes.read(), compared, similarity, margin, bands * rows_per_band))
    found = links.read()
    for table in (more, *rounds):
        found = found.unionAll(table.read())
    classes = components(found)
    out = Table(first.select("c1", "c2", "id", "rows", "node").join(classes.read(), "node", "left").select("c1", "c2", "id", "rows", F.coalesce("label", "node").alias("label")))
    for table in (texts, grouped, sets, links, labels, marked, sizes, more, classes, *rounds):
        table.drop()
    return out


def near_duplicates(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", size: int = 5, similarity: float = 0.8, bands: int = 25, rows_per_band: int = 5, margin: float = 0.12
) -> DataFrame:
    """doc_id, class_id, class_size (rows): one row per row of docs; class_id is the
    smallest doc_id of its class.

    Null text is an empty text; equal texts (empty ones too) are of one class; a
    text without words has no other near copies, one of fewer than `size` words is
    a single shingle.  Ids may have any type with an order and need not be unique: rows
    that share an id but not the text are rows like any others.  A row without doc_id
    gets class_id from the rows of its class that have one, or null.  An empty table
    gives an empty table."""
    texts = _classes(docs, text, doc_id, size, similarity, bands, rows_per_band, margin)
    named = Table(texts.read().groupBy("label").agg(F.min("id").alias("class_id"), F.sum("rows").alias("class_size")))
    result = texts.read().join(named.read(), "label").select("c1", "c2", "class_id", "class_size")
    return _named(docs, text, doc_id).select("c1", "c2", F.col("id").alias("doc_id")).join(result, ["c1", "c2"]).select("doc_id", "class_id", "class_size")


def deduplicate(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", size: int = 5, similarity: float = 0.8, bands: int = 25, rows_per_band: int = 5, margin: float = 0.12
) -> DataFrame:
    """One row of docs for each class of near_duplicates, all columns: a row of its
    smallest doc_id (without any, a row without; several texts of that id: the one of the
    smaller hash; rows alike in both: any of them).  Further columns may have any names."""
    texts = _classes(docs, text, doc_id, size, similarity, bands, rows_per_band, margin)
    stays = texts.read().groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "c1", "c2")).alias("s"))
    keys = fresh(docs, "c1", "c2", "spread")
    stay = stays.select(*[c.alias(k) for c, k in zip((F.col("s.c1"), F.col("s.c2"), F.xxhash64("s.id")), keys)])
    c1, c2 = text_names(text)
    rows = docs.withColumns(dict(zip(keys, (c1, c2, F.xxhash64(doc_id)))))
    return rows.join(stay, keys, "left_semi").dropDuplicates(keys).drop(*keys)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose shingle sets' Jaccard similarity reaches it."""
    return _overlapping(pairs, sets).where(F.col("both") >= similarity * F.col("union")).select("a", "b")


def _overlapping(pairs: DataFrame, sets: DataFrame, b_sets: DataFrame | None = None) -> DataFrame:
    """The pairs a, b with the sizes of their sets' intersection and union; b_sets: a
    smaller table that has those of all b."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("a_set"))
    right = (sets if b_sets is None else b_sets).select(F.col("node").alias("b"), F.col("set").alias("b_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    union = F.size("a_set") + F.size("b_set") - both
    return pairs.join(left, "a").join(right, "b").select(*pairs.columns, both.alias("both"), union.alias("union"))


#: Shingles of a block, about.
_BLOCK = 200_000


def _marked(grouped: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of each hub's group but the hub, with their class; odd: it isn't
    the hub's."""
    named = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    with_label = grouped.where("node != hub").join(labels, "node", "left").join(named, "hub", "left")
    label, hub_label = F.coalesce("label", "node"), F.coalesce("hub_label", "hub")
    return with_label.select("node", "n", "hub", label.alias("label"), (label != hub_label).alias("odd"))


def _sizes(marked: DataFrame) -> DataFrame:
    """Shingles of all members and of the odd ones, of the groups with something to compare."""
    sums = marked.groupBy("hub").agg(F.count("*").alias("size"), F.sum("n").alias("all_n"), F.sum(F.when(F.col("odd"), F.col("n"))).alias("odd_n"))
    return sums.where("odd_n > 0 AND size > 1")


#: Rounds of further hubs in a group of more than a block.
_ROUNDS = 4


def _further_hubs(marked: Table, sizes: Table, links: DataFrame, sets: DataFrame, similarity: float) -> tuple[Table, Table, list[Table]]:
    """(members, sizes, links found): in groups of more than a block, odd are only the
    members that have to meet all others.

    To begin with those are all that aren't linked to the hub itself.  Each round takes one
    of them as a hub, links what is near it, and if it lies far enough from the group's
    earlier hubs, lets those members go: linked to it or to an earlier one, two members are
    of one class or too far apart."""
    large = sizes.read().where(F.col("all_n") > _BLOCK).select("hub")
    inside = marked.read().join(large, "hub")
    direct = links.select(F.col("a").alias("node"), F.col("b").alias("hub"))
    left = Table(inside.select("hub", "node").join(direct, ["hub", "node"], "left_anti"))
    reach = 1 - similarity
    hubs = large.select("hub", F.col("hub").alias("earlier"), F.lit(reach).alias("reach"))
    found: list[Table] = []
    # what the rounds need of the sets; the lists of ids are written, so that Spark knows
    # their size and sends them to the sets where they are small, not the sets around
    ids = Table(inside.select("node").unionAll(large.select(F.col("hub").alias("node"))).distinct())
    own_sets = Table(sets.join(ids.read(), "node", "left_semi"))
    sets = own_sets.read()
    used: list[Table] = [ids, own_sets]
    for turn in range(_ROUNDS):
        place = F.xxhash64("node", F.lit(turn))
        picked = Table(left.read().groupBy("hub").agg(F.min_by("node", place).alias("b"), F.count("*").alias("size")).where("size > 1").select("hub", "b"))
        picked_sets = Table(sets.join(picked.read().select(F.col("b").alias("node")).distinct(), "node", "left_semi"))
        pairs = Table(left.read().join(picked.read(), "hub").select("hub", F.col("node").alias("a"), "b").where("a != b"))
        near = Table(_overlapping(pairs.read(), sets, picked_sets.read()).where(F.col("both") >= similarity * F.col("union")))
        own = picked.read().join(near.read().groupBy("hub").agg(F.max(1 - F.col("both") / F.col("union")).alias("own")), "hub", "left")
        to_hubs = Table(own.select("hub", "b", F.coalesce("own", F.lit(0.0)).alias("own")).join(hubs, "hub").withColumnRenamed("earlier", "a").where("a != b"))
        apart = _overlapping(to_hubs.read(), sets, picked_sets.read())
        gap = 1 - F.col("both") / F.col("union") - F.col("own") - F.col("reach")
        far = Table(apart.groupBy("hub", "b").agg(F.min(gap).alias("gap"), F.max("own").alias("reach")).where(F.col("gap") > reach + 1e-9).select("hub", "b", "reach"))
        gone = near.read().join(far.read().select("hub"), "hub", "left_semi").select("hub", F.col("a").alias("node"))
        gone = gone.unionAll(far.read().select("hub", F.col("b").alias("node")))
        following = Table(left.read().join(gone, ["hub", "node"], "left_anti"))
        used.append(Table(hubs.unionByName(far.read().select("hub", F.col("b").alias("earlier"), "reach"))))
        hubs = used[-1].read()
        found.append(Table(near.read().select("a", "b")))
        for table in (left, picked, picked_sets, pairs, near, to_hubs, far):
            table.drop()
        left = following
    met = left.read().select("hub", "node", F.lit(True).alias("met"))
    odd = F.when(F.col("large"), F.coalesce("met", F.lit(False))).otherwise(F.col("odd"))
    every = marked.read().join(large.select("hub", F.lit(True).alias("large")), "hub", "left").join(met, ["hub", "node"], "left")
    again = Table(every.select("node", "n", "hub", "label", F.coalesce(odd, F.col("odd")).alias("odd")))
    counted = Table(_sizes(again.read()))
    for table in (marked, sizes, left, *used):
        table.drop()
    return again, counted, found


#: Members of a posting, at most, whose pairs are estimated one by one.
_POSTING = 256


def _by_rare_shingles(marked: Table, sizes: Table, sets: DataFrame, signatures: DataFrame, similarity: float, margin: float, registers: int) -> tuple[Table, Table, Table]:
    """(members, sizes, links found): in groups with more than a block of odd members, odd
    are only those that may have a link by frequent shingles alone.

    With the shingles of a set in one order, rare ones first, two sets of n and m <= n that
    reach the similarity t have their first common shingle among the first n - ceil(t * n) + 1 of the
    larger and the first m - ceil(2 * t / (1 + t) * m) + 1 of the smaller.  So a template that many
    texts share makes no candidates where they have more of their own than that, which is
    so whenever it makes them less similar than t."""
    large = sizes.read().where(F.col("odd_n") > _BLOCK).select("hub")
    members = Table(marked.read().join(large, "hub").groupBy("node").agg(F.max("odd").alias("odd"), F.any_value("n").alias("n"), F.any_value("label").alias("label")))
    shingled = members.read().select("node", "n", "odd").join(sets, "node").select("node", "n", "odd", F.explode("set").alias("shingle"))
    times = Table(shingled.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1"))
    own = Window.partitionBy("node")
    # shingles of no other member stand first in the order and are left out
    place = F.row_number().over(own.orderBy("times", "shingle")) - F.count("*").over(own)

    def within(share: float):
        return F.col("place") <= 1 - F.ceil(F.col("n") * share - 1e-9)

    placed = shingled.join(times.read(), "shingle").withColumn("place", place).where(within(similarity))
    first = Table(placed.select("node", "odd", "shingle", within(2 * similarity / (1 + similarity)).alias("short")))
    counts = [F.count("*").alias("members"), F.count_if("odd").alias("odds"), F.count_if(F.col("short") & F.col("odd")).alias("short_odd"), F.count_if(F.col("short") & ~F.col("odd")).alias("short_even")]
    lists = Table(first.read().groupBy("shingle").agg(*counts).where("members > 1 AND odds > 0 AND short_odd + short_even > 0").select("shingle", "members", "short_even"))
    frequent = first.read().join(lists.read().where(F.col("members") > _POSTING), "shingle")
    hot = Table(frequent.where(F.col("odd") & (F.col("short") | (F.col("short_even") > 0))).select("node").distinct())
    few = first.read().select("node", "shingle").join(lists.read().where(F.col("members") <= _POSTING).select("shingle"), "shingle", "left_semi")
    row = F.struct("node", "n", "label", "odd", "signature")
    postings = few.join(members.read().join(signatures, "node"), "node").groupBy("shingle").agg(F.collect_list(row).alias("members"))
    pairs = Table(postings.select("members").mapInArrow(_estimated(similarity, margin, registers), "a long, b long").distinct())
    found = Table(_verified(pairs.read(), sets, similarity))
    every = marked.read().join(large.withColumn("large", F.lit(True)), "hub", "left").join(hot.read().withColumn("hot", F.lit(True)), "node", "left")
    odd = F.when(F.col("large"), F.col("odd") & F.coalesce("hot", F.lit(False))).otherwise(F.col("odd"))
    again = Table(every.select("node", "n", "hub", "label", odd.alias("odd")))
    counted = Table(_sizes(again.read()))
    for table in (marked, sizes, members, times, first, lists, hot, pairs):
        table.drop()
    return again, counted, found


def _estimated(similarity: float, margin: float, registers: int):
    """The pairs of a posting, one of them odd, whose estimate comes near the similarity."""

    def rows(batches):
        for batch in batches:
            lists = batch.column("members")
            starts, flat_rows = np.asarray(lists.offsets), lists.flatten()
            starts = starts - starts[0]
            node, n, label = (np.asarray(flat_rows.field(k)) for k in ("node", "n", "label"))
            odd = np.asarray(flat_rows.field("odd").cast(pa.int8())).astype(bool)
            signature = np.frombuffer(b"".join(flat_rows.field("signature").to_pylist()), np.uint16).reshape(-1, registers)
            found = [np.empty((0, 2), np.int64)]
            for low, high in zip(starts[:-1], starts[1:]):
                i, j = (x + low for x in np.triu_indices(high - low, 1))
                ask = (label[i] != label[j]) & (odd[i] | odd[j]) & (np.minimum(n[i], n[j]) >= np.maximum(n[i], n[j]) * similarity)
                i, j = i[ask], j[ask]
                near = (signature[i] == signature[j]).sum(axis=1) >= (similarity - margin) * registers
                found.append(np.stack([node[i[near]], node[j[near]]], axis=1))
            pairs = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], names=["a", "b"])

    return rows


def _rest(marked: DataFrame, sizes: DataFrame, compared: DataFrame, similarity: float, margin: float, registers: int) -> DataFrame:
    """The further links a, b: in each hub's group, of odd members with any other
    member of another class.  A pair is looked at if its estimate is at least
    similarity - margin (some 3.5 deviations of a signature), and is a link if its sets
    say so."""
    open_groups = marked.join(sizes, "hub").join(compared, "node")
    row = F.struct("node", "n", "label", "signature", "set")

    def blocks(rows: DataFrame, total: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col(total) / _BLOCK)).cast("int")
        return rows.groupBy("hub", block.alias(f"{name}_block")).agg(F.collect_list(row).alias(name))

    left, right = blocks(open_groups.where("odd"), "odd_n", "odd"), blocks(open_groups, "all_n", "all")
    return left.join(right, "hub").select("odd", "all").mapInArrow(_compared(similarity, margin, registers), "a long, b long").distinct()


def _compared(similarity: float, margin: float, registers: int):
    def side(column):
        rows = column.flatten()
        field = {k: rows.field(k) for k in ("node", "n", "label", "signature", "set")}
        signature = np.frombuffer(b"".join(field["signature"].to_pylist()), np.uint16).reshape(-1, registers)
        sets = field["set"]
        return *(np.asarray(field[k]) for k in ("node", "n", "label")), signature, np.asarray(sets.offsets), np.asarray(sets.values)

    def links(batch):
        node, n, label, signature, first, names = side(batch.column("odd"))
        node2, n2, label2, signature2, first2, names2 = side(batch.column("all"))
        for i in range(len(node)):
            near = np.flatnonzero((label2 != label[i]) & (np.minimum(n2, n[i]) >= np.maximum(n2, n[i]) * similarity))
            alike = near[(signature2[near] == signature[i]).sum(axis=1) >= (similarity - margin) * registers]
            if not len(alike):
                continue
            own = np.sort(names[first[i] : first[i + 1]])
            size = first2[alike + 1] - first2[alike]
            start = np.cumsum(size) - size
            theirs = names2[np.repeat(first2[alike] - start, size) + np.arange(size.sum())]
            same = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            both = np.add.reduceat(same.astype(np.int64), start)
            yield from ((node[i], node2[k]) for k in alike[both >= similarity * (len(own) + size - both)])

    def rows(batches):
        for whole in batches:
            for k in range(whole.num_rows):
                found = np.array(list(links(whole.slice(k, 1))), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(found.max(axis=1)), pa.array(found.min(axis=1))], names=["a", "b"])

    return rows


def op2_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: All pairs that share a shingle, exactly.
SQL = r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min(doc_id), text) AS id, text, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) GROUP BY text),
w AS (SELECT id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
g AS MATERIALIZED (SELECT DISTINCT id, md5(array_to_string(w[i:i + 4], ' ')) AS k FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n FROM g GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM g a JOIN g b ON a.k = b.k AND a.id < b.id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 5 * shared.n >= 4 * (x.n + y.n - shared.n)),
sides AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id, id AS other FROM t UNION SELECT reach.id, sides.b FROM reach JOIN sides ON reach.other = sides.a),
labels AS (SELECT id, min(other) AS label FROM reach GROUP BY id),
classes AS (SELECT label, min(doc_id) AS class_id, sum(n)::BIGINT AS class_size FROM labels JOIN t USING (id) GROUP BY label)
SELECT d.doc_id, class_id, class_size FROM documents d JOIN t ON t.text = coalesce(d.text, '') JOIN labels USING (id) JOIN classes USING (label)
"""
