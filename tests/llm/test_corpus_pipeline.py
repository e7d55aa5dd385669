"""Every stage of the pipeline against brute force or its rule."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from quern.llm.encode import default_path, encoder
from quern.llm.license_scan import tokens
from quern.llm.minhash_dedup import near_duplicates
from quern.llm.quality_classifier import classify, train


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    at = str(tmp_path_factory.mktemp("sf"))
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 3) + str(rng.randrange(3000))
    passage = " ".join(word() for _ in range(70))
    item = " ".join(word() for _ in range(40))
    rows, labels = [], []
    for k in range(260):
        w = [word() for _ in range(rng.randrange(40, 160))]
        bad = k % 5 == 0
        text = " ".join(f"{x}###" for x in w) if bad else " ".join(w)
        if k % 13 == 1 and not bad:
            text += " " + passage
        if k % 17 == 3 and not bad:
            text = item + " " + text
        rows.append((k, text, "en", f"src{k % 3}", len(text)))
        labels.append((k, int(not bad), 0))
    rows += [(1000 + k, rows[k + 1][1], "en", "copy", 1) for k in (0, 1, 2)] + [(2000, None, None, None, None), (2001, "", "en", "x", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, item


def test_stages(spark, folder, tmp_path):
    at, item = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    names = docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, at)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {(r.doc_id, r.text) for r in docs.collect()} if k < 4 else docs.collect()
        if k < 4:
            assert docs.columns == names
        if name == "quality_classifier":
            verdict = classify(before, train(before, spark.read.parquet(f"{at}/labels.parquet"))).where("predicted = 1")
            assert {r.doc_id for r in verdict.collect()} == {d for d, _ in kept[name]}
            bad = sum("###" in (t or "") for _, t in kept[name])
            assert bad <= 5 and len(kept[name]) >= 0.95 * sum("###" not in (r.text or "") for r in before.collect())
        if name == "minhash_near_dedup":
            classes = {r.class_id for r in near_duplicates(before).collect()}
            assert len(kept[name]) == len(classes) and not {1000, 1001, 1002} & {d for d, _ in kept[name]}
        if name == "suffix_array_dedup":
            texts = {r.doc_id: (r.text or "").encode() for r in before.collect()}
            for d, t in kept[name]:
                own, rest = texts[d], (t or "").encode()
                assert len(rest) <= len(own)
            assert {d for d, _ in kept[name]} == set(texts)
            assert sum(len(t or "") for _, t in kept[name]) < sum(map(len, texts.values()))
        if name == "decontamination":
            w = tuple(tokens(item))
            assert not any(w == tuple(tokens(t or "")[i : i + len(w)]) for _, t in kept[name] for i in range(len(tokens(t or ""))))
            gone = {r.doc_id: r.text for r in before.collect() if r.doc_id not in {d for d, _ in kept[name]}}
            assert all(set(w[:13]) & set(tokens(t)) or set(w[-13:]) & set(tokens(t)) for t in gone.values())
    encode = encoder(default_path())
    left = kept["decontamination"]
    assert sum(r.length for r in kept["packing"]) == sum(len(encode(t or "")) + 1 for _, t in left)


def test_stages_by_plain_loops(spark, folder, tmp_path):
    """Each stage's result from what it was given, by loops over the texts."""
    from collections import Counter
    from zlib import crc32

    import numpy as np
    from test_classifiers import plain_score
    from test_llm_operators import brute_classes, brute_repeats, plain_overlaps
    from tokenizers import Tokenizer

    at, item = folder
    docs, rows = spark.read.parquet(f"{at}/documents.parquet"), None
    # whole copies of the item go with the repeated passages; half of it is left to the benchmark stage
    own = " ".join([*[f"own{k}" for k in range(30)], *item.split()[:20], *[f"more{k}" for k in range(30)]])
    docs = docs.unionByName(spark.createDataFrame([(5000, own, "en", "half", len(own))], docs.schema))
    library = Tokenizer.from_file(default_path())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        texts = [t or "" for _, t in before]
        stage(spark, docs, at).write.parquet(f"{tmp_path}/{k}")
        made = spark.read.parquet(f"{tmp_path}/{k}").collect()
        if name == "quality_classifier":
            model = train(docs, spark.read.parquet(f"{at}/labels.parquet"))
            rows = [(d, t) for d, t in before if plain_score(t, model) >= 0.3]
        elif name == "minhash_near_dedup":
            rows = [min((before[i] for i in c), key=lambda r: (r[0] is None, r[0])) for c in brute_classes(before)]
        elif name == "suffix_array_dedup":
            removed = list(brute_repeats([t.encode() for t in texts], 200))
            assert sum(n for _, n, _, _ in removed) > 0 and all(t.isascii() for t in texts)
            assert Counter((r.doc_id, len(r.text or "")) for r in made) == Counter((d, n - gone) for (d, _), (n, gone, _, _) in zip(before, removed))
            assert all(r.n_chars == len(r.text or "") for r in made if (r.doc_id or 0) < 260)
            rows = [(r.doc_id, r.text) for r in made]
        elif name == "decontamination":
            found = {d for d, _ in plain_overlaps(texts, [item])}
            assert found
            rows = [r for i, r in enumerate(before) if i not in found]
        else:
            expected = Counter()
            for d, t in before:
                ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
                start = 0
                while start < len(ids):
                    left = len(ids) - start
                    length = min(2048, 1 << left.bit_length() - 1)
                    expected[d, start, length, crc32(ids[start : start + length].tobytes()), len(ids)] += 1
                    start += length
            assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in made) == expected
            break
        assert Counter((r.doc_id, r.text) for r in made) == Counter(rows), name
        docs = spark.read.parquet(f"{tmp_path}/{k}")


def test_run_and_empty(spark, folder, tmp_path):
    at, _ = folder
    assert corpus_pipeline.run(spark, at).count() > 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_with_clashing_names(spark, folder, tmp_path):
    at, _ = folder
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    from pyspark.sql import functions as F

    wide = spark.read.parquet(f"{at}/documents.parquet").withColumns({c: F.lit(1) for c in ("score", "predicted", "quality", "node", "row", "label", "repeats", "kept", "size", "bucket", "verdict", "__repeats", "__c1", "__c2", "__spread", "__key1", "__k1", "__spans", "c1", "c2", "spread", "key1", "key1_", "spans")})
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    docs = wide
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        columns, docs = docs.columns, spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert docs.columns == columns
