"""Lexical search and embedding near-duplicates against brute force on awkward tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import embedding_dedup, lexical_search

# ------------------------------------------------------------------------ op11

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute_search(docs, items, best):
    held = [(d, terms(t)) for d, t in docs]
    n, total = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for doc, w in held:
            tf, m = Counter(w), 25 + (75 * len(w) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms(text) if t in tf)
            scored += [(-score, doc)] if score > 0 else []
        out += [(item, k + 1, doc, -s) for k, (s, doc) in enumerate(sorted(scored)[:best])]
    return sorted(out)


def search_tables():
    rng = random.Random(11)
    word = lambda: rng.choice(["the", "Of", "é", "ß1", f"w{rng.randrange(60)}", f"rare{rng.randrange(5000)}"])
    docs = [(k, " ".join(word() for _ in range(rng.randrange(1, 90)))) for k in rng.sample(range(10_000), 300)]
    docs += [(20_000, None), (20_001, ""), (20_002, " .,; \n"), (20_003, "W1 w1-W1_the " * 9000), (20_004, docs[0][1]), (20_005, docs[0][1]), (-3, docs[0][1])]
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 40)))) for k in range(25)] + [(90, None), (91, ""), (92, "nowhere"), (93, docs[0][1]), (94, "the the the of of")]
    return docs, items


@pytest.mark.parametrize(("stride", "shard_bytes"), [(7, 2000), (1024, 1 << 24)])
def test_search_equals_brute_force(spark, stride, shard_bytes):
    docs, items = search_tables()
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, score int, term string").repartition(3)
    i = spark.createDataFrame([(*r, 2, "y") for r in items], "item_id long, text string, rank int, doc_id string")
    found = lexical_search.search(d, i, stride=stride, shard_bytes=shard_bytes).collect()
    assert sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found) == brute_search(docs, items, 10)


def test_search_by_a_whole_index_in_rounds(spark, monkeypatch):
    docs, items = search_tables()
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    whole = lexical_search.index(d, shard_bytes=5000).persist()
    monkeypatch.setattr(lexical_search, "_ITEM_BYTES", 3000)
    found = lexical_search.search(d, i, best=3, indexed=whole).collect()
    assert sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found) == brute_search(docs, items, 3)
    monkeypatch.setattr(lexical_search, "_SENT_TERMS", 5)
    assert sorted(map(tuple, lexical_search.search(d, i, best=3).collect())) == sorted(map(tuple, found))
    whole.unpersist()


def test_search_repeated_rows_other_ids_and_empty_tables(spark):
    d = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("a", "one two"), (None, "one two"), (None, None), ("z", "three")], "doc_id string, text string")
    i = spark.createDataFrame([(None, "ONE two"), (5, "one"), (5, "one")], "item_id int, text string")
    found = [tuple(r)[:3] for r in lexical_search.search(d, i).collect()]
    one = [(1, "a"), (2, "a"), (3, "b"), (4, None)]
    assert Counter(found) == Counter([(None, *x) for x in one] + [(5, *x) for x in one] * 2)
    for docs, items in ((d.where("false"), i), (d, i.where("false")), (d.where("text IS NULL"), i)):
        out = lexical_search.search(docs, items)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_packed_numbers():
    rng = random.Random(1)
    values = np.array([rng.randrange(1 << rng.randrange(1, 62)) for _ in range(2000)] + [0, 127, 128, (1 << 62) - 1], np.int64)
    raw, size = lexical_search.pack(values)
    assert len(raw) == size.sum() and np.array_equal(lexical_search.unpack(raw.tobytes()), values)
    assert len(lexical_search.unpack(b"")) == 0


# ------------------------------------------------------------------------ op12


def brute_links(rows, threshold):
    """(row number, n_links, component) by every pair in double precision."""
    n, near = len(rows), [set() for _ in rows]
    good = [e is not None and len(e) > 0 and None not in e and all(map(math.isfinite, e)) and any(e) for _, e in rows]
    u = [np.array(e, float) / np.linalg.norm(np.array(e, float)) if g else None for (_, e), g in zip(rows, good)]
    for a in range(n):
        for b in range(a):
            if good[a] and good[b] and len(u[a]) == len(u[b]) and u[a] @ u[b] >= threshold:
                near[a].add(b)
                near[b].add(a)
    out, seen = [None] * n, set()
    for a in range(n):
        if a not in seen:
            group, todo = {a}, [a]
            while todo:
                more = near[todo.pop()] - group
                group |= more
                todo += more
            seen |= group
            ids = [rows[k][0] for k in group if rows[k][0] is not None]
            for k in group:
                out[k] = (rows[k][0], len(near[k]), min(ids, default=None))
    return Counter((v, k, c, v == c) for v, k, c in out)


def embeddings(kind=np.float32):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(40, 16))
    near = lambda v, s: v + rng.normal(size=16) * s * np.linalg.norm(v) / 4
    x = [rng.normal(size=16) for _ in range(150)] + [near(base[k % 40], [0.05, 0.2, 0.31, 0.33][k % 4]) for k in range(200)]
    x += [near(base[0], 0.03) for _ in range(120)] + [near(base[1], 0.3) for _ in range(80)]  # a tight and a loose group
    chain = [base[2] + t * base[3] for t in np.linspace(0, 3, 40)]
    x += chain + [x[0]] * 5 + [2 * x[1], -x[1], x[200] * 8, x[201], x[201]]
    rows = [(int(k), v.astype(kind).tolist()) for k, v in zip(rng.permutation(len(x)), x)]
    odd = [None, [], [0.0] * 16, [1.0] * 15 + [None], [1.0] * 15 + [math.nan], [math.inf] + [0.0] * 15, [1.0, 2.0], [2.0, 4.1], [1.0], [-1.0], [3.0]]
    rows += [(1000 + k, v) for k, v in enumerate(odd)] + [(7, x[0].tolist()), (None, x[0].tolist()), (None, [0.0] * 16), (None, [1.0, -7.0, 1.0])]
    return rows


@pytest.mark.parametrize(("block", "kind"), [(8192, "float"), (40, "float"), (13, "double")])
def test_links_equal_brute_force(spark, block, kind):
    rows = [(v, None if e is None else [x if x is None or kind == "double" else float(np.float32(x)) for x in e]) for v, e in embeddings(np.float32 if kind == "float" else np.float64)]
    table = spark.createDataFrame([(*r, 5, 6) for r in rows], f"vec_id long, embedding array<{kind}>, node int, n_links int").repartition(3)
    found = Counter(map(tuple, embedding_dedup.near_duplicates(table, block=block).collect()))
    assert found == brute_links(rows, 0.95)


def test_links_of_empty_tables(spark):
    table = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(table).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert embedding_dedup.near_duplicates(table.where("false")).count() == 0


def test_bounds_hold():
    """The product is never negative where the cosine reaches the threshold."""
    rng = np.random.default_rng(3)
    for d in (1, 2, 7, 64, 700, 1500):
        a = embedding_dedup.unit(rng.normal(size=(300, d)) ** 3 * 10.0 ** rng.integers(-200, 90, (300, 1)))
        b = embedding_dedup.unit(a + rng.normal(size=a.shape) * rng.uniform(0, 0.6, (300, 1)) / d**0.5)
        q, s, r = embedding_dedup.quantised(a)
        assert (np.linalg.norm(a - q * s[:, None], axis=1) <= r).all() and np.allclose(np.linalg.norm(a, axis=1), 1)
        cosine = (a * b).sum(axis=1)
        for threshold in np.concatenate([[0.5, 0.95, 0.999], np.maximum(cosine[:40], 0.01)]):
            product = embedding_dedup._sides(a, threshold)[0] @ embedding_dedup._sides(b, threshold)[1].T
            assert (product[a @ b.T >= threshold] >= 0).all()


def test_groups_are_decided_as_a_whole():
    """What the angles decide holds for every pair of the groups."""
    rng = np.random.default_rng(5)
    theta = math.acos(0.95)
    base = rng.normal(size=(6, 12))
    x = embedding_dedup.unit(base[rng.integers(0, 6, 800)] + rng.normal(size=(800, 12)) * rng.choice([0.01, 0.05, 0.3, 1], (800, 1)))
    pivots = x[:9]
    import pyarrow as pa

    rows, rings = embedding_dedup._grouped(pivots, theta)
    batch = pa.RecordBatch.from_arrays([pa.array(range(800)), pa.array([1] * 800), pa.array(x.tolist())], names=["node", "n", "embedding"])
    out = next(rows([batch]))
    grp, angle = np.asarray(out.column("grp")), np.asarray(out.column("angle"))
    stats = [{"grp": g, "low": angle[grp == g].min(), "high": angle[grp == g].max()} for g in np.unique(grp)]
    maybe, sure, group = embedding_dedup._decided(stats, pivots, rings, theta)
    assert sure.any() and (~maybe).any() and not (sure & ~maybe).any()
    for i, g in enumerate(group):
        for j, h in enumerate(group):
            linked = x[grp == g] @ x[grp == h].T >= 0.95
            assert not sure[i, j] or linked.all()
            assert maybe[i, j] or not linked.any()
