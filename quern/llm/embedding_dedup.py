"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors are one row with a count, so copies never meet.  The rest lie in groups by their
nearest pivot (a bounded sample) and the ring of their angle to it.  The triangle
inequality on angles decides many pairs of groups as a whole: too far apart for any link,
or so near that all their pairs are links.  All other pairs meet in tiles of two blocks
of at most 8,192 vectors.

In a tile each unit vector u is s * q + r, with q in int8.  For two vectors

    |u.v - s t q.p| <= |r| (1 + |r'|) + |r'| (1 + |r|) + |r| |r'| = |r| + |r'| + 3 |r| |r'|

by Cauchy and Schwarz (|s q| <= 1 + |r|), so two more columns make one matrix product
give (s t q.p + bound - threshold) / (s t) for all pairs of the tile.  q and p are whole
numbers, exact in single precision; what its sums may round is added to the bound.  Pairs where this isn't
negative are computed again in double precision, and only that decides.

A tile returns one row for each of its vectors that has links: how many, and the smallest
vector of its component inside the tile.  No pair becomes a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table
from .minhash_dedup import components

#: Bounds: vectors of a block, pivots, rows of a tile that are multiplied at once.
_BLOCK, _PIVOTS, _STRIP = 8192, 256, 1024
#: Angles are known to about 1e-8 near 0; decisions on whole groups keep well clear of that.
_SURE = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled by a power of two first, so that no
    square is lost or overflows."""
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q int8, scale, bound): |u - scale * q| <= bound, row by row."""
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    rest = u - scale[:, None] * q
    return q, scale, np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-12) + 1e-15


def _sides(u: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The matrices whose product is at least 0 wherever the cosine may reach the threshold."""
    q, s, r = quantised(u)
    at_least = threshold - 4 * (u.shape[1] + 4) * 2.0**-24
    left = np.column_stack([q, (r - at_least) / s, (1 + 3 * r) / s])
    return left.astype(np.float32), np.column_stack([q, 1 / s, r / s]).astype(np.float32)


def _union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins a[k] and b[k] for all k; root[x] is the smallest of x's component."""
    while len(a):
        a, b = root[a], root[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, root[root]):
            root[:] = root[root]


def links(a: np.ndarray, b: np.ndarray | None, weight_a: np.ndarray, weight_b: np.ndarray, threshold: float, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors each row of a and each of b links with, counted with the other's
    weight; root (of the rows of a, then of b) joins what is linked.  Without b the
    pairs inside a."""
    one = b is None
    ua = unit(a)
    ub = ua if one else unit(b)
    left, right = _sides(ua, threshold)[0], _sides(ub, threshold)[1]
    n_a, n_b, shift = np.zeros(len(ua), np.int64), np.zeros(len(ub), np.int64), 0 if one else len(ua)
    few = max(1, (1 << 21) // max(1, ua.shape[1]))
    for low in range(0, len(ua), _STRIP):
        since = low if one else 0
        maybe = left[low : low + _STRIP] @ right[since:].T >= 0
        if one:
            maybe &= np.arange(since, len(ub)) > np.arange(low, low + len(maybe))[:, None]
        row, col = np.nonzero(maybe)
        if len(row) > maybe.size // 16:
            close = (ua[low : low + _STRIP] @ ub[since:].T)[row, col] >= threshold
        else:
            close = np.concatenate([np.einsum("ij,ij->i", ua[low + row[k : k + few]], ub[since + col[k : k + few]]) for k in range(0, len(row), few)] or [np.empty(0)]) >= threshold
        row, col = low + row[close], since + col[close]
        np.add.at(n_a, row, weight_b[col])
        np.add.at(n_b, col, weight_a[row])
        _union(root, row, shift + col)
    return (n_a + n_b, n_b) if one else (n_a, n_b)


# ------------------------------------------------------------------------ groups


def _angles(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ v.T, -1, 1))


def _grouped(pivots: np.ndarray, theta: float):
    """group and angle of each vector: its nearest pivot's ring, ring 0 being those of
    which any two are linked.  Vectors of another dimension than the pivots' go by it."""
    rings = math.ceil(math.pi / theta) + 1

    def rows(batches):
        for batch in batches:
            lists = batch.column("embedding")
            first = np.asarray(lists.offsets).astype(np.int64)
            dim, values = np.diff(first), np.asarray(lists.values)
            group, angle = -1 - dim % 64, np.zeros(len(dim))
            mine = np.flatnonzero(dim == pivots.shape[1])
            if len(mine):
                found = _angles(unit(values[first[mine][:, None] + np.arange(pivots.shape[1])]), pivots)
                nearest = found.argmin(axis=1)
                angle[mine] = found[np.arange(len(mine)), nearest]
                group[mine] = nearest * rings + np.where(angle[mine] < theta / 2 - _SURE, 0, 1 + angle[mine] // theta)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), lists, pa.array(group), pa.array(angle)], names=["node", "n", "embedding", "grp", "angle"])

    return rows, rings


def _decided(stats: list, pivots: np.ndarray, rings: int, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two square matrices over the groups (may be linked, all pairs are), and the groups."""
    group = np.array([r["grp"] for r in stats], np.int64)
    low, high = (np.array([r[c] for r in stats]) for c in ("low", "high"))
    has = group >= 0
    between = np.zeros((len(group), len(group)))
    between[np.ix_(has, has)] = _angles(pivots, pivots)[np.ix_(group[has] // rings, group[has] // rings)]
    np.fill_diagonal(between, 0)
    between[(group[:, None] // rings == group // rings) & has[:, None] & has] = 0
    farthest = between + high[:, None] + high
    nearest = np.maximum(between - high[:, None] - high, np.maximum(low[:, None] - between - high, low - between - high[:, None]))
    maybe = np.where(has[:, None] & has, nearest <= theta + _SURE, group[:, None] == group)
    return maybe, has[:, None] & has & (farthest < theta - _SURE), group


# ------------------------------------------------------------------------- tiles


def _packed(nodes: pa.Table) -> pa.Table:
    lists = nodes.column("embedding").combine_chunks()
    dims = np.diff(np.asarray(lists.offsets))
    row = {"block": nodes.column("block")[:1], "node": [nodes.column("node").to_pylist()], "n": [nodes.column("n").to_pylist()], "dim": [dims.tolist()], "vectors": [np.asarray(lists.flatten()).tobytes()]}
    kinds = {"block": pa.string(), "node": pa.list_(pa.int64()), "n": pa.list_(pa.int64()), "dim": pa.list_(pa.int32()), "vectors": pa.binary()}
    return pa.table({k: v if k == "block" else pa.array(v, kinds[k]) for k, v in row.items()})


def _tiles(threshold: float, kind: type):
    def side(x):
        node, n, dim = (np.array(x[c], np.int64) for c in ("node", "n", "dim"))
        return node, n, dim, np.cumsum(dim) - dim, np.frombuffer(x["vectors"], kind)

    def rows(batches):
        for batch in batches:
            for pair in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                one = pair["left"]["block"] == pair["right"]["block"]
                node_a, n_a, dim_a, first_a, values_a = side(pair["left"])
                node_b, n_b, dim_b, first_b, values_b = side(pair["right"])
                for d in np.intersect1d(dim_a, dim_b).tolist():
                    at_a, at_b = np.flatnonzero(dim_a == d), np.flatnonzero(dim_b == d)
                    nodes = node_a[at_a] if one else np.concatenate([node_a[at_a], node_b[at_b]])
                    order = np.argsort(nodes)
                    # the smallest place of a component is to be its smallest node
                    place, a = np.argsort(order), values_a[first_a[at_a][:, None] + np.arange(d)]
                    root = np.arange(len(nodes))
                    if one:
                        count, _ = links(a[order], None, n_a[at_a][order], n_a[at_a][order], threshold, root)
                    else:
                        b = values_b[first_b[at_b][:, None] + np.arange(d)]
                        own, other = links(a, b, n_a[at_a], n_b[at_b], threshold, mapped := np.arange(len(nodes)))
                        count = np.concatenate([own, other])[order]
                        _union(root, place, place[mapped])
                    some = np.flatnonzero(count)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[order][some]), pa.array(nodes[order][root[some]]), pa.array(count[some])], names=["a", "b", "links"])

    return rows


def _linked(distinct: Table, threshold: float, block: int, kind: str) -> tuple[DataFrame, list[Table]]:
    """a, b, links: nodes with links, b of their component; rows of a node add up."""
    spark, theta = distinct.spark, math.acos(threshold)
    vectors = distinct.read()
    n = vectors.count()
    # a bounded sample, by hash: some 4 times the pivots wanted
    pivots = min(_PIVOTS, max(1, n // (4 * block)))
    drawn = [r for r in vectors.where(F.pmod(F.xxhash64("node", F.lit(12)), F.lit(max(n, 1))) < 4 * pivots + 16).select("embedding").limit(8 * pivots + 64).collect()]
    sizes = [len(r["embedding"]) for r in drawn]
    common = max(set(sizes), key=sizes.count, default=1)
    sample = unit(np.array([r["embedding"] for r in drawn if len(r["embedding"]) == common][:pivots] or [[1.0] * common]))
    assign, rings = _grouped(sample, theta)
    grouped = Table(vectors.mapInArrow(assign, f"node long, n long, embedding array<{kind}>, grp long, angle double"))
    stats = grouped.read().groupBy("grp").agg(F.count("*").alias("rows"), F.sum("n").alias("weight"), F.min("node").alias("least"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()
    maybe, sure, group = _decided(stats, sample, rings, theta)

    # groups whose pairs are all links: a count and a root for each, of a bounded number of groups
    weight, least = (np.array([r[c] for r in stats], np.int64) for c in ("weight", "least"))
    joined = np.arange(len(group))
    _union(joined, *np.nonzero(sure))
    root = np.full(len(group), np.iinfo(np.int64).max)
    np.minimum.at(root, joined, least)
    whole = [(int(group[k]), int((sure[k] * weight).sum()), int(root[joined[k]]), bool(sure[k, k])) for k in np.flatnonzero(sure.any(axis=1))]
    given = spark.createDataFrame(whole, "grp long, all long, root long, inside boolean")
    # a row of a group that is linked in itself counts all of the group but itself
    by_group = grouped.read().join(F.broadcast(given), "grp").select(F.col("node").alias("a"), F.col("root").alias("b"), (F.col("all") - F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("links"))

    blocks = {int(g): -(-r["rows"] // block) for g, r in zip(group, stats)}
    counts = spark.createDataFrame(list(blocks.items()), "grp long, blocks long")
    named = F.concat_ws(":", "grp", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks"))).alias("block")
    packed = Table(grouped.read().join(F.broadcast(counts), "grp").select(named, "node", "n", "embedding").groupBy("block").applyInArrow(_packed, "block string, node array<long>, n array<long>, dim array<int>, vectors binary"))
    pairs = [(int(group[i]), blocks[int(group[i])], int(group[j]), blocks[int(group[j])]) for i, j in zip(*np.nonzero(np.triu(maybe & ~sure)))]
    by_groups = spark.createDataFrame(pairs, "g long, gn long, h long, hn long").select("g", "h", F.explode(F.sequence(F.lit(0), F.col("gn") - 1)).alias("i"), "hn").select("g", "h", "i", F.explode(F.sequence(F.lit(0), F.col("hn") - 1)).alias("j"))
    met = by_groups.where("g != h OR i <= j").select(F.concat_ws(":", "g", "i").alias("x"), F.concat_ws(":", "h", "j").alias("y"))
    side = F.struct("block", "node", "n", "dim", "vectors")
    left = met.join(packed.read().select(F.col("block").alias("x"), side.alias("left")), "x")
    right = met.join(packed.read().select(F.col("block").alias("y"), side.alias("right")), "y")
    tiles = left.join(right.select("x", "y", "right"), ["x", "y"]).select("left", "right")
    # a row is two blocks
    found = Table(tiles.mapInArrow(_tiles(threshold, np.float32 if kind == "float" else np.float64), "a long, b long, links long"), arrow_rows=4)
    return found.read().unionAll(by_group), [found, packed, grouped]


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.95, embedding: str = "embedding", vec_id: str = "vec_id", block: int = _BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors.  Rows are linked if
    their cosine (in double precision) is at least the threshold (in (0, 1)); n_links counts the
    other rows linked, component_id is the smallest vec_id reachable by links.

    Vectors that are null, empty, zero or hold null, NaN or infinity have no links, and
    vectors of different dimensions none with each other.  Equal vectors are linked, whatever their
    ids; rows that share an id are rows of their own.  A row without vec_id has the
    component_id of the others of its component, or null; kept is vec_id = component_id (both
    null: true).  Other columns are not read.  An empty table gives an empty table."""
    kind = "double" if vectors.schema[embedding].dataType.elementType.typeName() == "double" else "float"
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("embedding"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    each = rows.where(valid).groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    distinct = Table(each.withColumn("node", F.monotonically_increasing_id()))
    found, tables = _linked(distinct, threshold, block, kind)
    labels = components(found.select("a", "b"))
    counted = Table(found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node"))
    nodes = distinct.read().join(counted.read(), "node", "left").join(labels.read(), "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = Table(nodes.groupBy("label").agg(F.min("id").alias("component_id")))
    result = Table(nodes.join(smallest.read(), "label").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"))
    for table in (*tables, labels, counted, smallest, distinct):
        table.drop()
    # a vector that many rows share: both sides come by a plain exchange, which Spark may split
    linked = rows.where(valid).join(result.read().hint("merge"), "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS e, len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS valid FROM embeddings
),
u AS MATERIALIZED (SELECT row, e FROM v WHERE valid),
links AS MATERIALIZED (SELECT a.row AS a, b.row AS b FROM u a JOIN u b ON a.row <> b.row AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT row, row AS other FROM v UNION SELECT reach.row, links.b FROM reach JOIN links ON reach.other = links.a),
c AS (SELECT reach.row, min(vec_id) AS component_id FROM reach JOIN v ON v.row = reach.other GROUP BY reach.row),
n AS (SELECT a AS row, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (row) LEFT JOIN n USING (row)
"""
