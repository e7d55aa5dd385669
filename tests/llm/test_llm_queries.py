"""The operators' queries against their SQL in DuckDB, on the smallest tables and on
awkward ones: substitutions, copies, passages that repeat, nulls, ties."""

from __future__ import annotations

import os
import random

import duckdb
import pytest

from quern.llm import queries

DATA = "/root/testdata/sf0.001"


def canonical(rows):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in rows)


def same(spark, name, at, files):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "conversations"):
        if os.path.exists(f"{at}/{table}.parquet"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet{files}'")
    frame = queries.queries()[name](spark, at)
    columns = sorted(frame.columns)
    ours = canonical([r[c] for c in columns] for r in frame.collect())
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert ours == canonical([dict(zip(names, r))[c] for c in columns] for r in found.fetchall())
    return len(ours)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert same(spark, name, DATA, "") > 0


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    rng, at = random.Random(44), str(tmp_path_factory.mktemp("awkward"))
    word = lambda n: rng.choice("abcdeé") * 2 + str(rng.randrange(n))
    items = [" ".join(word(40) for _ in range(n)) for n in (4, 5, 7, 12, 13, 20, 60, 60)]
    passage = " ".join(word(10**6) for _ in range(80))
    texts = [None, "", "  \n ", "one", "One", "a b c", "A b c"]
    for k in range(150):
        w = [word(40 if k % 3 else 10**6) for _ in range(rng.randrange(5, 160))]
        if k % 4 == 0:
            own = rng.choice(items).split()
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = "changed"
            w[3:3] = own
        if k % 5 == 0:
            w.append(passage)
        texts.append(" ".join(w))
    for k in range(40):
        own = texts[7 + k].split()
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = "edit"
        texts.append(" ".join(own))
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate([*items, None, ""])], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spots = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    near = [[x + rng.gauss(0, 0.15) for x in rng.choice(spots)] for _ in range(80)]
    odd = [None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] * 6, near[0], near[0], [2 * x for x in near[1]]]
    spark.createDataFrame([(k, e, 0) for k, e in enumerate([*near, *odd])], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{at}/embeddings.parquet")
    said = lambda: rng.choice([None, "", "a", "a b", "c\n d", "é"])
    turns = [(c, rng.choice([None, *range(9)]), rng.choice(["user", None, "x"]), said()) for c in range(0, 300, 2) for _ in range(rng.randrange(1, 6))]
    spark.createDataFrame([*turns, (None, 1, "user", "a")], "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql_on_awkward_tables(spark, awkward, name):
    assert same(spark, name, awkward, "/*.parquet") > 0
