"""The operators against brute force on small and awkward tables: nulls, empty and
long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import (
    decontamination,
    encode,
    factorization,
    license_scan,
    minhash_dedup,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    suffix_dedup,
    token_counts,
    toxicity,
)

SCHEMA = "doc_id long, text string, lang string, rank int, size int, node long, row string, kept int, label int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward(rng=None):
    rng = rng or random.Random(3)
    long = " ".join(words(rng, 6000))
    base = " ".join(words(rng, 120))
    texts = [None, "", " \n\t ", "one", "two words", "é" * 300, "😀 mixed ünï " * 40, long, long, base, base + " tail", base.replace("w1", "x1", 1), "a" * 500, "ab" * 300, "\x00\x01 odd", base, None]
    return [(k, t, "en", 1, 2, 3, "r", 4, 5) for k, t in enumerate(texts)] + [(3, "one", "en", 1, 2, 3, "r", 4, 5), (None, base, "en", 1, 2, 3, "r", 4, 5), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------- op1


def test_overlaps_find_passages_and_substitutions(spark):
    rng = random.Random(5)
    items = [" ".join(words(rng, n, 5000)) for n in (40, 25, 9, 3)]
    changed = items[0].split()
    changed[11], changed[24] = "zzz", "yyy"
    short = items[2].split()
    rows = [
        (0, " ".join([*words(rng, 50, 5000), *items[0].upper().split(), *words(rng, 20, 5000)])), (1, " ".join([*words(rng, 30, 5000), *changed])), (2, " ".join(words(rng, 200, 5000))),
        (3, " ".join(["pre", *short, "post"])), (4, items[3]), (5, None), (6, ""), (7, items[1]), (7, items[1]), (None, items[1]),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)] + [(9, None, "x"), (10, "", "x")], "item_id long, text string, doc_id string")
    got = Counter((r.doc_id, r.item_id) for r in decontamination.overlaps(docs, bench).collect())
    assert got == Counter({(0, 0): 1, (1, 0): 1, (3, 2): 1, (7, 1): 2, (None, 1): 1})
    one = [r for r in decontamination.overlaps(docs, bench).collect() if r.doc_id == 1][0]
    assert (one.doc_first, one.item_first, one.n_tokens, one.n_matched) == (30, 0, 40, 38)
    small = Counter((r.doc_id, r.item_id) for r in decontamination.overlaps(docs, bench, block_bytes=64).collect())
    assert small == got  # the benchmark in many blocks
    left = decontamination.decontaminate(docs, bench).collect()
    assert sorted(r.doc_id for r in left) == [2, 4, 5, 6]


def test_overlaps_on_awkward_tables(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.overlaps(docs, bench).count() == 0
    assert decontamination.decontaminate(docs, bench).count() == docs.count()
    some = spark.createDataFrame([(1, " ".join(words(random.Random(1), 30)))], "item_id long, text string")
    assert decontamination.overlaps(empty, some).count() == 0
    assert decontamination.decontaminate(docs, some).columns == docs.columns


def test_best_stretch():
    assert decontamination.best_stretch(np.array([0, 1, 1, 0, 1, 1, 1, 0], bool), 1) == (1, 7, 5)
    assert decontamination.best_stretch(np.zeros(3, bool)) == (0, 0, 0)


def test_lawful_stretch_against_all_stretches():
    rng = random.Random(21)
    for n in (0, 1, 5, 13, 20, 40):
        for share in (0.7, 0.8, 0.9):
            for _ in range(40):
                equal = [rng.random() < rng.choice([0.5, 0.8, 0.9]) for _ in range(n)]
                most = max((sum(equal[a:b]) for a in range(n) for b in range(a + 1, n + 1) if round(100 * sum(equal[a:b])) >= round(100 * share) * (b - a)), default=0)
                first, end, matched = decontamination.lawful_stretch(np.array(equal, bool), share)
                assert matched == most == sum(equal[first:end]) and round(100 * matched) >= round(100 * share) * (end - first)


def test_overlaps_with_one_substitution_anywhere(spark):
    rng = random.Random(22)
    item = [f"p{k}" for k in range(13)]
    rows = [(k, " ".join([*words(rng, 20), *item[:k], "zzz", *item[k + 1 :], *words(rng, 20)])) for k in range(13)]
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_matched) for r in decontamination.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {k: (12 if k in (0, 12) else 11 if k in (1, 11) else 13, 11 if k in (1, 11) else 12) for k in range(13)}


def test_masks_fit_every_lawful_pattern():
    for tokens in (*range(5, 17), 20, 21):
        fit = [re.compile(m.replace("0", ".")) for m in decontamination.masks(tokens)]
        for n in range(1, tokens + 1):
            for k in range(n // 5 + 1):
                if n - k < 0.8 * min(13, tokens):
                    continue
                for gone in itertools.combinations(range(1, n - 1), k):
                    pattern = "".join("01"[i not in gone] for i in range(n))
                    assert any(f.search(pattern) for f in fit), (tokens, pattern)
    assert decontamination.masks(4) == () and decontamination.masks(500) == decontamination.masks(26)


def test_masks_ignore_a_place_at_every_length():
    for tokens in range(1, 60):
        family = decontamination.masks(tokens, least_item=1)
        assert family and all(("0" in m) == (tokens > 2) and len(m) <= tokens for m in family)
    assert decontamination.masks(9, share=1.0) and all("0" in m for m in decontamination.masks(100, 50, 0.9))


def test_short_items_match_where_they_are_asked_for(spark):
    items = {1: "alpha", 2: "beta gamma", 3: "one two three", 4: "one two three four", 9: "", 10: None}
    texts = {0: "x alpha y", 1: "beta zz gamma", 2: "beta gamma", 3: "q one two three r", 4: "one two xx four one two three four", 5: None, 6: ""}
    docs, bench = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.doc_first, r.n_tokens) for r in decontamination.overlaps(docs, bench, least_item=1).collect()}
    assert got == {(0, 1, 1, 1), (2, 2, 0, 2), (3, 3, 1, 3), (4, 3, 4, 3), (4, 4, 4, 4)}
    assert not decontamination.overlaps(docs, bench).count()


def test_overlaps_find_every_lawful_substitution(spark):
    rng = random.Random(23)
    rows, items, expected = [], [], set()

    def case(item, gone, passage=None):
        copy = [f"z{rng.randrange(10**9)}" if k in gone else x for k, x in enumerate(passage or item)]
        rows.append((len(rows), " ".join(["pre", *copy, "post"])))
        expected.add((len(rows) - 1, items.index(item)))

    for n, k in ((5, 1), (6, 1), (7, 1), (8, 1), (9, 1), (10, 2), (11, 2), (12, 2), (13, 2)):
        items.append([f"i{n}x{j}" for j in range(n)])
        for gone in itertools.combinations(range(n), k):
            case(items[-1], gone)
    items.append([f"long{j}" for j in range(500)])
    for n, k in ((13, 2), (15, 3)):
        for gone in itertools.combinations(range(n), k):
            case(items[-1], gone, items[-1][100 : 100 + n])
    case(items[-1], range(4, 500, 5))
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    lawful = lambda r: sum(x in r[1].split() for x in items[dict(expected)[r[0]]]) >= 0.8 * min(13, len(items[dict(expected)[r[0]]]))
    assert all(map(lawful, rows))
    got = {(r.doc_id, r.item_id) for r in decontamination.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == expected


def plain_overlaps(texts, items, share=0.8):
    """Every item laid over every text at every offset."""
    out = {}
    for d, text in enumerate(texts):
        w = license_scan.tokens(text or "")
        for i, item in enumerate(items):
            t = license_scan.tokens(item or "")
            least, rows = share * min(13, len(t)), []
            for diagonal in range(-len(t) + 1, len(w)) if len(t) >= 5 else ():
                low, high = max(diagonal, 0), min(diagonal + len(t), len(w))
                equal = [w[p] == t[p - diagonal] for p in range(low, high)]
                if sum(equal) < least:
                    continue
                first, end, n = decontamination.best_stretch(np.array(equal, bool))
                if n < max(least, share * (end - first)):
                    first, end, n = decontamination.lawful_stretch(np.array(equal, bool))
                if n >= least:
                    rows.append((n, -(low + first), low + first, low + first - diagonal, end - first))
            if rows:
                out[d, i] = max(rows)
    return out


@pytest.mark.parametrize("vocabulary", [1, 2, 4, 30])
def test_overlaps_against_every_offset(vocabulary):
    rng = random.Random(25)
    items = [" ".join(words(rng, n, vocabulary)) for n in (4, 5, 8, 13, 20, 40, 40)]
    texts = ["", None, items[5], " ".join([*words(rng, 30, 50), items[4], *words(rng, 10, 50)]), *[" ".join(words(rng, rng.randrange(120), vocabulary)) for _ in range(12)]]
    seeds = decontamination._Seeds(items)
    assert decontamination._best(*decontamination.flat(pa.array(texts)), seeds, 0.8) == plain_overlaps(texts, items)


def test_short_items_where_asked(spark):
    docs = spark.createDataFrame([(0, "yes"), (1, "The Answer is 42 then"), (2, "answer 42"), (3, "a b c x")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "answer is 42"), (1, "yes"), (2, "a b c d")], "item_id long, text string")
    assert decontamination.overlaps(docs, bench).count() == 0
    assert {(r.doc_id, r.item_id, r.doc_first, r.n_matched) for r in decontamination.overlaps(docs, bench, least_item=1).collect()} == {(0, 1, 0, 1), (1, 0, 1, 3)}


def test_one_word_that_fills_text_and_items_is_cheap():
    import time

    seeds = decontamination._Seeds([" ".join(["same"] * (200 + k)) for k in range(20)])
    began = time.process_time()
    found = decontamination._best(*decontamination.flat(pa.array([" ".join(["same"] * 2000)])), seeds, 0.8)
    assert found == {(0, k): (200 + k, 0, 0, 0, 200 + k) for k in range(20)} and time.process_time() - began < 5


def test_overlaps_with_the_benchmark_in_many_blocks(spark):
    rng = random.Random(26)
    items = [" ".join(words(rng, 30, 3000)) for _ in range(40)]
    docs = spark.createDataFrame([(k, " ".join([*words(rng, 20), items[k % 40], *words(rng, 20)]) if k % 3 else " ".join(words(rng, 60))) for k in range(90)], "doc_id long, text string")
    bench = spark.createDataFrame([(k % 50, items[k % 40]) for k in range(100)], "item_id long, text string")  # items repeat
    size = sum(len(x) for x in items)
    for blocks in (1, 10, 50):
        got = Counter((r.doc_id, r.item_id) for r in decontamination.overlaps(docs, bench, block_bytes=size // blocks + 1).collect())
        assert got == Counter((k, j % 50) for k in range(90) if k % 3 for j in range(100) if j % 40 == k % 40)
        assert {r.doc_id for r in decontamination.decontaminate(docs, bench, block_bytes=size // blocks + 1).collect()} == {k for k in range(90) if k % 3 == 0}


def test_overlaps_hold_few_hits_at_a_time(monkeypatch):
    rng = random.Random(24)
    item, texts = words(rng, 60, 3), [" ".join(words(rng, 300, 3)) for _ in range(5)] + [""]
    seeds = decontamination._Seeds([" ".join(item), " ".join(item[:9]), ""])
    whole = decontamination._best(*decontamination.flat(pa.array(texts)), seeds, 0.8)
    monkeypatch.setattr(decontamination, "AT_ONCE", 50)
    assert whole and decontamination._best(*decontamination.flat(pa.array(texts)), seeds, 0.8) == whole


# ------------------------------------------------------------------- op2


def shingle_set(text, size=5):
    w = [x for x in re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_classes(rows):
    parent = {k: k for k in range(len(rows))}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    sets = [shingle_set(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if (rows[a][1] or "") == (rows[b][1] or "") or rows[a][0] == rows[b][0] is not None or union and both >= 0.8 * union:
                parent[find(a)] = find(b)
    members = defaultdict(set)
    for k in range(len(rows)):
        members[find(k)].add(k)
    return sorted(sorted(m) for m in members.values())


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**9)}"
    return " ".join(w)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(11)
    rows, k = [], 0
    for size in (12, 60, 150, 400):
        for _ in range(3):
            base = " ".join(words(rng, size, 3000))
            for edits in (0, 0, 1, 1, 2, 3, 5, 8, 12):
                rows.append((k, edited(rng, base, edits) if edits else base))
                k += 1
    hot = " ".join(words(rng, 150, 3000))
    rows += [(k + i, edited(rng, hot, rng.choice([0, 1, 2, 3, 4, 5, 6, 7]))) for i in range(150)]
    rng.shuffle(rows)
    got = defaultdict(set)
    place = {d: i for i, (d, _) in enumerate(rows)}
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in minhash_dedup.near_duplicates(frame).collect():
        got[r.class_id].add(place[r.doc_id])
    assert sorted(sorted(m) for m in got.values()) == brute_classes(rows)
    stay = minhash_dedup.deduplicate(frame).collect()
    assert len(stay) == len(got) and {r.doc_id for r in stay} == set(got)


def test_near_duplicates_on_awkward_tables(spark, docs, empty):
    found = minhash_dedup.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    by = defaultdict(set)
    for r in found:
        by[r.doc_id].add(r.class_id)
    assert by[0] == by[1] == by[16] == {0} and by[7] == by[8] == {7} and by[9] == by[10] == by[11] == by[15] == {9} and by[3] == {3}
    assert by[None] == {0, 9}
    kept = minhash_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and minhash_dedup.near_duplicates(empty).count() == 0 and minhash_dedup.deduplicate(empty).count() == 0


def test_further_hubs_of_large_groups(spark, monkeypatch):
    """Families that share some text, so that they meet in buckets: the classes are those of
    all pairs, and members of families far apart don't go into blocks."""
    rng = random.Random(27)
    common, rows = words(rng, 60, 10**6), []
    for family in range(6):
        base = words(rng, 120, 10**6)
        for _ in range(25):
            text = edited(rng, " ".join(base), rng.randrange(0, 4))
            rows.append((len(rows), " ".join([*common, *text.split()]) if family < 4 else text))
    for k in range(40):  # a chain, each like the next, and lone texts with the common part
        rows.append((len(rows), " ".join(words(random.Random(99), 300, 10**6)[4 * k : 4 * k + 150])))
        rows.append((len(rows), " ".join([*common, *words(rng, 100, 10**6)])))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    place = {d: i for i, (d, _) in enumerate(rows)}
    seen = []
    rest = minhash_dedup._rest
    monkeypatch.setattr(minhash_dedup, "_rest", lambda marked, *more: seen.append(marked.where("odd").count()) or rest(marked, *more))
    for block in (200_000, 2_000):
        monkeypatch.setattr(minhash_dedup, "_BLOCK", block)
        got = defaultdict(set)
        for r in minhash_dedup.near_duplicates(frame, bands=40, rows_per_band=2).collect():
            got[r.class_id].add(place[r.doc_id])
        assert sorted(sorted(m) for m in got.values()) == brute_classes(rows)
    assert seen[1] < seen[0]


def test_texts_of_one_template_meet_by_rare_shingles(spark, monkeypatch):
    """Texts that share a template at similarities of 0.66 to 0.78, near copies among them: the
    classes are those of all pairs, and few texts go into blocks."""
    rng = random.Random(28)
    template, rows = words(rng, 170, 10**6), []
    for k in range(120):
        rows.append((len(rows), " ".join([*template, *words(rng, 25 if k % 2 else 42, 10**6)])))
        if k % 4 == 0:
            rows.append((len(rows), edited(rng, rows[-1][1], rng.randrange(1, 6))))
    for _ in range(30):  # of one class, whose own words are frequent
        rows.append((len(rows), edited(rng, " ".join([*template, *words(random.Random(5), 30, 10**6)]), rng.randrange(0, 2))))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, rest = [], minhash_dedup._rest
    monkeypatch.setattr(minhash_dedup, "_rest", lambda marked, *more: seen.append(marked.where("odd").select("node").distinct().count()) or rest(marked, *more))
    for block, posting in ((10**9, 256), (2_000, 256), (2_000, 8)):
        monkeypatch.setattr(minhash_dedup, "_BLOCK", block)
        monkeypatch.setattr(minhash_dedup, "_POSTING", posting)
        got = defaultdict(set)
        for r in minhash_dedup.near_duplicates(frame, bands=40, rows_per_band=2).collect():
            got[r.class_id].add(r.doc_id)
        assert sorted(sorted(m) for m in got.values()) == brute_classes(rows)
    assert seen[0] > 100 and seen[1] < seen[0] / 4 and seen[2] < seen[0]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_duplicates_ids_of_any_kind(spark, kind):
    rng = random.Random(17)
    base, other, third = (" ".join(words(rng, 150, 3000)) for _ in range(3))
    near = edited(rng, base, 2)
    rows = [(-5, base), (-7, near), (3, other), (3, third), (3, other), (None, near), (None, "no id at all"), (-1, "minus one"), (-(2**63), "the least")]
    frame = spark.createDataFrame([(None if d is None else d if kind == "long" else f"k{d}", t, 1) for d, t in rows], f"doc_id {kind}, text string, c1 int").repartition(4)
    name = lambda d: None if d is None else d if kind == "long" else f"k{d}"
    got = Counter(tuple(r) for r in minhash_dedup.near_duplicates(frame).collect())
    first = min(name(-5), name(-7))
    expected = [(-5, first, 3), (-7, first, 3), (None, first, 3), (3, name(3), 2), (3, name(3), 2), (3, name(3), 1), (None, None, 1), (-1, name(-1), 1), (-(2**63), name(-(2**63)), 1)]
    assert got == Counter((name(d), c, n) for d, c, n in expected)
    kept = minhash_dedup.deduplicate(frame)
    assert kept.columns == frame.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(first, base if first == name(-5) else near), (name(3), other), (name(3), third), (None, "no id at all"), (name(-1), "minus one"), (name(-(2**63)), "the least")])


def test_recall_of_links_by_similarity(spark):
    """Pairs alone in their family: above the threshold all must be found, below none."""
    rng = random.Random(18)
    rows, truth = [], {}
    for k in range(400):
        base = " ".join(words(rng, rng.choice([40, 120, 300]), 10**6))
        copy = edited(rng, base, rng.randrange(1, 9))
        a, b = shingle_set(base), shingle_set(copy)
        truth[2 * k] = len(a & b) >= 0.8 * len(a | b)
        rows += [(2 * k, base), (2 * k + 1, copy)]
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {k: got[k + 1] == k for k in truth}
    assert sum(truth.values()) > 100 and not any(linked[k] for k in truth if not truth[k])
    assert sum(linked[k] for k in truth if truth[k]) >= 0.99 * sum(truth.values())


def test_very_long_texts(spark):
    """Megabytes of one word, of few words, and of distinct words, through the operators."""
    rng = random.Random(19)
    texts = ["same " * 300_000, "a b " * 200_000, " ".join(words(rng, 250_000, 50_000)), "x" * 1_000_000, "\n" * 1_000_000]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(9, texts[2])], "doc_id long, text string")
    classes = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(frame).collect()}
    assert classes == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 9: 2}
    bench = spark.createDataFrame([(0, "same " * 30), (1, " ".join(texts[2].split()[1000:1030]))], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_matched) for r in decontamination.overlaps(frame, bench).collect()} == {(0, 0, 30), (2, 1, 30), (9, 1, 30)}
    assert {r.doc_id: (r.quality.n_words, r.quality.base_failed) for r in quality_rules.judge(frame).collect()} == {0: (300_000, True), 1: (400_000, True), 2: (250_000, False), 3: (1, True), 4: (0, True), 9: (250_000, False)}
    assert sum(r.size for r in sharding.shard(frame).collect()) == sum(len(t) + 8 for t in [*texts, texts[2]])
    gone = {r.doc_id: (r.repeats.n_bytes, r.repeats.n_removed) for r in suffix_dedup.remove_repeats(frame).drop("text").collect()}
    assert gone == {0: (1_500_000, 1_500_000), 1: (800_000, 800_000), 2: (len(texts[2]), len(texts[2])), 3: (10**6, 10**6), 4: (10**6, 10**6), 9: (len(texts[2]), len(texts[2]))}
    assert {r.doc_id: r.n_words for r in license_scan.scan(frame).collect()} == {0: 300_000, 1: 400_000, 2: 250_000, 3: 1, 4: 0, 9: 250_000}
    marks = spark.createDataFrame([(k, k % 2, k % 2) for k in range(6)], "doc_id long, quality int, toxic int")
    for module in (quality_classifier, toxicity):
        assert module.classify(frame, module.train(frame, marks)).count() == 6


def test_prob_min_hash_estimates_probability_jaccard():
    rng = np.random.default_rng(2)
    names = rng.integers(0, 2**63, 90).astype(np.uint64)
    weights = rng.integers(1, 3, (2, 90)).astype(float)
    weights[0, :20], weights[1, 70:] = 0, 0
    doc, name, weight = [], [], []
    for d in range(2):
        there = weights[d] > 0
        doc += [d] * there.sum()
        name += names[there].tolist()
        weight += weights[d][there].tolist()
    signature = minhash_dedup.prob_min_hash(np.array(doc), np.array(name, np.uint64), np.array(weight), 2, 4000)
    exact = sum(1 / np.maximum(weights[0] / weights[0][k], weights[1] / weights[1][k]).sum() for k in range(90) if weights[0][k] and weights[1][k])
    assert abs(minhash_dedup.estimate(signature[0], signature[1]) - exact) < 0.03


def test_candidates_by_the_sets_whatever_the_counts(spark):
    cycle = [f"c{k}" for k in range(60)]
    rows = [(0, " ".join(cycle + cycle[:4])), (1, " ".join(cycle + cycle[:34]))]  # one set of shingles, half of them twice
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.class_id for r in minhash_dedup.near_duplicates(frame, bands=1, rows_per_band=60).collect()} == {0}
    assert minhash_dedup.deduplicate(frame, bands=1, rows_per_band=60).count() == 1


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)]
    edges = [e for e in edges if e[0] != e[1]]
    label = {}
    for a, b in edges:
        label.setdefault(a, a)
        label.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    table = minhash_dedup.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.label for r in table.read().collect()} == label


# ------------------------------------------------------------------- op3


def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + i for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for i in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_counts(spark, docs, empty):
    rng = random.Random(8)
    texts = [r[1] for r in awkward()] + [" ".join(words(rng, n, v)) for n in (3, 4, 5, 6, 30, 200) for v in (1, 2, 5, 50)] + ["a b\r\nc | d\n\na b\r\n # $", "x\ny\nx\nx", "A!! B!! C!!"]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r.doc_id: r.quality for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        q, expected = got[k], brute_rules(t)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == expected, t
        assert q.base_failed == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert not (q.base_failed and q.kept)
    assert quality_rules.judge(docs).columns == [*docs.columns, "quality"] and quality_rules.judge(empty).count() == 0


# ------------------------------------------------------------------- op4


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_sharding_laws(spark, docs, empty, shards):
    rng = random.Random(9)
    same = " ".join(words(rng, 50))
    rows = [(k, " ".join(words(rng, rng.randrange(1, 300)))) for k in range(400)] + [(1000 + k, same) for k in range(300)] + [(7777, same)] * 200 + [(None, None)] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard(frame, shards=shards, ranges_per_shard=4, sample_per_range=8).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    slots, total = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
    assert set(slots) <= set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(total.values()) - min(total.values()) <= 2 * max(size(t) for _, t in rows)
    assert sharding.shard(empty).count() == 0 and sharding.shard(docs).count() == docs.count()


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, f"{tmp_path}/shards", shards=3)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == docs.count() and set(docs.columns) <= set(back.columns)


# ------------------------------------------------------------------- op5


def brute_repeats(texts, length):
    seen = Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    for b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        yield len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()


def spliced(rng, sources, pieces):
    out = ""
    for _ in range(pieces):
        s = rng.choice(sources)
        a = rng.randrange(len(s))
        out += s[a : a + rng.randrange(1, 420)]
    return out


@pytest.mark.parametrize("alphabet", ["ab", string.ascii_lowercase + " ", "aé😀"])
def test_repeats_against_all_strings(spark, alphabet):
    rng = random.Random(len(alphabet))
    sources = ["".join(rng.choice(alphabet) for _ in range(900)) for _ in range(5)] + ["".join(rng.choice(alphabet) for _ in range(7)) * 80]
    texts = [spliced(rng, sources, rng.randrange(1, 7)) for _ in range(60)] + [sources[0], sources[0][:199], sources[0][:200], "", None, "a" * 700, "a" * 199]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(frame).select("doc_id", "repeats.*").collect())
    expected = brute_repeats([(t or "").encode() for _, t in rows], 200)
    assert got == Counter((d, *e) for (d, _), e in zip(rows, expected))


def test_repeats_keep_whole_characters_and_other_columns(spark, docs, empty):
    both = "é€😀" * 90
    rows = [(0, "x" + both + "ö1"), (1, "yy" + both + "ü2")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for r in suffix_dedup.remove_repeats(frame, whole_characters=True).collect():
        assert r.repeats.kept.decode() in ("xö1", "yyü2")
    assert suffix_dedup.remove_repeats(docs).columns == [*docs.columns, "repeats"] and suffix_dedup.remove_repeats(docs).count() == docs.count()
    assert suffix_dedup.remove_repeats(empty).count() == 0


# -------------------------------------------------------------- op6 and op7


def labelled(spark, n=700, seed=6):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        w = words(rng, rng.randrange(20, 120))
        bad = rng.random() < 0.3
        toxic = rng.random() < 0.2
        if toxic:
            w[3:3] = ["vile", "folk"] if rng.random() < 0.7 else ["dross"]
        rows.append((k, " ".join(x + "***" if bad else x for x in w), "x", 1))
        labels.append((k, int(not bad), int(toxic)))
    labels += [(None, 1, 1), (3, None, None), (99999, 0, 1)]
    return spark.createDataFrame(rows + [(None, "text", "x", 1), (5000, None, None, None), (5001, "", "", 0)], "doc_id long, text string, label string, index int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def test_classifiers_learn_and_score(spark):
    docs, labels, rows, marks = labelled(spark)
    for module, column, threshold in ((quality_classifier, 1, 0.3), (toxicity, 2, 0.5)):
        model = module.train(docs, labels)
        got = {r.doc_id: r for r in module.classify(docs, model).collect()}
        assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in got.values())
        held = [m for m in marks[:-3] if zlib.crc32(str(m[0]).encode()) % 5 == 0]
        right = sum(got[m[0]].predicted == m[column] for m in held)
        assert right >= 0.93 * len(held), (module.__name__, right, len(held))


def test_held_out_rows_teach_nothing(spark):
    docs, labels, _, _ = labelled(spark, 200)
    flipped = labels.withColumn("quality", F.when(factorization.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_classifier.train(docs, labels), quality_classifier.train(docs, flipped)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_classifiers_on_awkward_tables(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (quality_classifier, toxicity):
        model = module.train(docs, none)
        assert module.classify(docs, model, score="s", predicted="p").columns == [*docs.columns, "s", "p"]
        assert module.classify(docs, model).count() == docs.count() and module.classify(empty, model).count() == 0


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    model = factorization.Model(0.3, rng.normal(size=20), rng.normal(size=(20, 4)), factorization.Settings(), False)
    index, value = rng.permutation(20)[:9], rng.normal(size=9)
    pairs = sum(model.factors[index[a]] @ model.factors[index[b]] * value[a] * value[b] for a in range(9) for b in range(a))
    assert np.isclose(model.logits(np.array([0, 9]), index, value)[0], 0.3 + model.weights[index] @ value + pairs)


# ------------------------------------------------------------- op8 and op10


def test_encoder_equals_the_tokenizers_library():
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(encode.default_path()), encode.encoder(encode.default_path())
    rng = random.Random(12)
    pool = [chr(k) for k in range(0x3000) if not 0xD800 <= k < 0xE000] + ["<|endoftext|>", "'s", " ", "\n", "  ", "　", "\x85"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(500)]
    texts += ["".join(rng.choice(" \n\t\r\x0b\x1c\x85\xa0ab1.'éÀ한") for _ in range(rng.randrange(40))) for _ in range(1500)]
    assert [x.ids for x in theirs.encode_batch(texts, add_special_tokens=False)] == [ours(t) for t in texts]


def test_encoder_on_very_long_runs(monkeypatch):
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(encode.default_path()), encode.encoder(encode.default_path())
    long = [" " * 2_000_000 + "x", "\t" * 2_000_000, "a" + "\n" * 2_000_000 + "b", " " * 1_100_000 + "<|endoftext|> z", "\u3000" * 1_100_000 + " q", "word 's " * 600_000, "ab" * 1_500_000]
    for text in long:
        assert theirs.encode(text, add_special_tokens=False).ids == ours(text)
    monkeypatch.setattr(encode, "LONG_RUN", 3)  # every run by the long way
    rng = random.Random(31)
    parts = [" ", "  ", "\n", "\t", "\x85", "\xa0", "\x1c", "\u2009", "a", "b1", ".", "'s", "<|endoftext|>", "é", "한"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert theirs.encode(text, add_special_tokens=False).ids == ours(text)


def test_encoder_leaves_other_vocabularies_to_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    text = "Some Words, and  more: ünï 12's"
    assert encode.encoder(path)(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark, docs, empty, tmp_path):
    docs.withColumn("key", F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/keyed")
    keyed = spark.read.parquet(f"{tmp_path}/keyed")
    pieces = packing.pack(keyed, keep=("key", "doc_id"), with_ids=True).collect()
    source = {r.key: r.text for r in keyed.collect()}
    ours = encode.encoder(encode.default_path())
    by = defaultdict(list)
    for r in pieces:
        by[r.key].append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and len(r.ids) == r.length == 1 << r.bucket
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert len({r.sequence_id for r in pieces}) == len(pieces)
    for key, text in source.items():
        own = sorted(by[key], key=lambda r: r.start)
        ids = [i for r in own for i in r.ids]
        assert ids == [*ours(text or ""), 1] and all(r.doc_tokens == len(ids) for r in own)
        assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1])
    assert packing.pack(empty).count() == 0
    packing.write_buckets(keyed, f"{tmp_path}/buckets")
    assert Counter((r.doc_id, r.start, tuple(r.ids), r.bucket) for r in spark.read.parquet(f"{tmp_path}/buckets").collect()) == Counter((r.doc_id, r.start, tuple(r.ids), r.bucket) for r in pieces)


def test_long_white_space_in_packing_and_counts(spark):
    rows = spark.createDataFrame([(1, "a" + " " * 1_100_000 + "b"), (2, "\n" * 1_100_000)], "doc_id long, text string")
    ours = encode.encoder(encode.default_path())
    sizes = {r.doc_id: len(ours(r.text)) for r in rows.collect()}
    assert {r.doc_id: r.n for r in packing.pack(rows).groupBy("doc_id").agg((F.sum("length") - 1).alias("n")).collect()} == sizes
    assert {r.length for r in token_counts.histogram(rows).collect()} == set(sizes.values())


def test_length_histogram(spark, docs, empty):
    ours = encode.encoder(encode.default_path())
    lengths = [len(ours(r.text or "")) for r in docs.collect()]
    hist = token_counts.histogram(docs, block=3)
    for r in hist.collect():
        assert r.documents == lengths.count(r.length) and r.documents_total == len(lengths) and r.tokens_total == sum(lengths)
        assert r.documents_at_least == sum(x >= r.length for x in lengths) and r.tokens_at_least == sum(x for x in lengths if x >= r.length)
        assert r.truncated_total == sum(min(x, r.length) for x in lengths) and abs(r["quantile"] - sum(x <= r.length for x in lengths) / len(lengths)) < 1e-8
    for r in token_counts.at_limits(hist, [0, 1, 7, 10**6]).collect():
        assert r.truncated_total == sum(min(x, r.limit) for x in lengths) and r.documents_over == sum(x > r.limit for x in lengths) and r.tokens_lost == sum(lengths) - r.truncated_total
    for r in token_counts.quantiles(hist, [0.1, 0.5, 1.0]).collect():
        assert r.length == min(x for x in lengths if sum(y <= x for y in lengths) >= r.share * len(lengths))
    assert token_counts.histogram(empty).count() == 0


def test_ids_of_any_kind(spark, docs):
    """Negative and string ids, ids that stand for several texts, through operators 4, 5, 8 and 9."""
    rng = random.Random(35)
    long = " ".join(words(rng, 200))
    rows = [(-3, long), (-3, "other"), (7, long[:400] + " own end"), (None, "mit license"), (-(2**63), ""), (2**63 - 1, None)]
    for kind in ("long", "string"):
        name = lambda d: None if d is None else d if kind == "long" else f"k{d}"  # noqa: E731, B023
        frame = spark.createDataFrame([(name(d), t) for d, t in rows], f"doc_id {kind}, text string").repartition(3)
        assert Counter(r.doc_id for r in sharding.shard(frame, shards=3).collect()) == Counter(name(d) for d, _ in rows)
        gone = {(r.doc_id, r.text): r.repeats.n_removed for r in suffix_dedup.remove_repeats(frame).collect()}
        assert gone[name(-3), long] == gone[name(7), rows[2][1]] == 400 and sum(gone.values()) == 800 and len(gone) == len(rows)
        assert Counter((r.doc_id, r.doc_tokens) for r in packing.pack(frame).where("start = 0").collect()) == Counter((name(d), len(encode.encoder(encode.default_path())(t or "")) + 1) for d, t in rows)
        assert {(r.doc_id, r.labels) for r in license_scan.scan(frame).collect() if r.labels} == {(None, "mit")}


# ------------------------------------------------------------------- op9


def test_license_base_places(spark):
    rng = random.Random(14)
    some = ["mit", "MIT", "license", "License", "apache", "general", "public", "x", "é", "LICENSE."]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randrange(12))) for _ in range(200)] + [None, "", "the-MIT-license", "mit licensE\nApache/license mit"]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        w, places, labels = license_scan.tokens(t or ""), [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            here = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places, labels = places + here, labels | ({label} if here else set())
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_suffix_automaton_matching_statistics():
    rng = random.Random(15)
    sequences = [[rng.randrange(4) for _ in range(30)] for _ in range(3)]
    automaton = license_scan.SuffixAutomaton(sequences)
    parts = {tuple(s[a:b]) for s in sequences for a in range(30) for b in range(a + 1, 31)}
    stream = [rng.randrange(5) for _ in range(400)]
    for end, (length, state) in enumerate(automaton.statistics(stream), 1):
        assert length == max((n for n in range(1, end + 1) if tuple(stream[end - n : end]) in parts), default=0)
        if length:
            sequence, to = automaton.place[state]
            assert sequences[sequence][to - length : to] == stream[end - length : end]


def plain_matches(stream, sequences, least):
    """All pairs of places: equal runs that can't grow."""
    out = set()
    for k, s in enumerate(sequences):
        for i in range(len(stream)):
            for j in range(len(s)):
                if stream[i] == s[j] and not (i and j and stream[i - 1] == s[j - 1]):
                    n = 0
                    while i + n < len(stream) and j + n < len(s) and stream[i + n] == s[j + n]:
                        n += 1
                    if n >= least:
                        out.add((i, n, k, j))
    return out


def test_matches_at_every_place_of_every_template():
    rng = random.Random(33)
    for _ in range(40):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(40))] for _ in range(4)]
        sequences[1] += sequences[0][5:25] + sequences[0][:15]
        automaton = license_scan.SuffixAutomaton(sequences)
        stream = [rng.randrange(4) for _ in range(60)] + sequences[0][3:20] + sequences[1][2:30]
        for least in (2, 4, 6):
            found = license_scan.long_matches(automaton, automaton.standing(least), stream, least)
            assert len(found) == len(set(found)) and set(found) == plain_matches(stream, sequences, least)


def test_every_template_is_told_from_those_it_shares_text_with(spark):
    rng = random.Random(34)
    rows = []
    for label, text in license_scan.TEMPLATES.items():
        w = text.split()
        for put in (None, len(w) // 3, len(w) // 2):
            body = w if put is None else [*w[:put], "inserted", *w[put:]]
            rows.append((label, len(rows) % 7, " ".join([*words(rng, len(rows) % 7), *body, *words(rng, 30)])))
    frame = spark.createDataFrame(rows, "doc_id string, before int, text string")
    for r in license_scan.scan(frame, keep=("doc_id", "before")).collect():
        assert r.labels.split(",") == sorted({r.doc_id, *filter(None, r.base_labels.split(","))}), r
        assert [(s.label, s.first_word) for s in r.spans] == [(r.doc_id, r.before)] and r.score > 0.95
    shared = {"a": " ".join(f"s{k}" for k in range(30)) + " " + " ".join(f"a{k}" for k in range(20)), "b": " ".join(f"s{k}" for k in range(30)) + " " + " ".join(f"b{k}" for k in range(20))}
    text = shared["b"].replace("s15", "s15 inserted")
    one = license_scan.scan(spark.createDataFrame([(0, text)], "doc_id long, text string"), templates=shared).first()
    assert one.labels == "b" and one.score == 1.0


def plain_chains(matches, gap):
    """Chains by trying every lawful row of matches; None where two rows cover the most."""
    out = []
    for template in sorted({m[2] for m in matches}):
        own = sorted((a, n, t) for a, n, k, t in matches if k == template)

        def follows(x, y):
            (a, n, t), (b, m, u) = own[x], own[y]
            return a < b and t < u and a + n < b + m and t + n < u + m and b - a - n <= gap and u - t - n <= gap

        covered = lambda row: len({p for k in row for p in range(own[k][2], own[k][2] + own[k][1])})
        best = []
        for end in range(len(own)):
            rows, open_rows = [], [(end,)]
            while open_rows:
                row = open_rows.pop()
                rows.append(row)
                open_rows += [(k, *row) for k in range(len(own)) if follows(k, row[0])]
            most = max(map(covered, rows))
            top = [r for r in rows if covered(r) == most]
            if len(top) > 1:
                return None
            best.append((most, top[0]))
        used = set()
        for most, row in sorted(best, key=lambda b: (-b[0], b[1][-1])):
            if row[-1] in used:
                continue
            free = list(itertools.takewhile(lambda k: k not in used, reversed(row)))
            used |= set(free)
            rest = row[: len(row) - len(free)]
            out.append((template, own[free[-1]][0], own[free[0]][0] + own[free[0]][1] - 1, most - (covered(rest) if rest else 0)))
    return out


def plain_license_scan(text, templates, phrases, least, gap, coverage):
    """base labels, labels, score and spans of one text, every chain held against every other."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
    own, sizes = split(text), [len(split(t)) for t in templates.values()]
    chains = plain_chains(plain_matches(own, [split(t) for t in templates.values()], least), gap)
    if chains is None:
        return None
    stay = []
    for c in sorted((c for c in chains if c[3] >= coverage * sizes[c[0]]), key=lambda c: (-c[3], -c[3] / sizes[c[0]], c[0], c[1])):
        if all(2 * len(set(range(c[1], c[2] + 1)) & set(range(o[1], o[2] + 1))) <= c[2] - c[1] + 1 for o in stay):
            stay.append(c)
    base = {label for phrase, label in phrases.items() for i in range(len(own)) if own[i : i + len(split(phrase))] == split(phrase)}
    names = list(templates)
    spans = sorted((a, k, names[k], b, n / sizes[k]) for k, a, b, n in stay)
    score = max([0.5 if base else 0.0, *(min(1.0, s[4]) for s in spans)])
    return ",".join(sorted(base)), ",".join(sorted(base | {s[2] for s in spans})), score, [(s[2], s[0], s[3], s[4]) for s in spans]


def hold_license_scan(spark, texts, **how):
    templates, phrases = how.pop("templates", license_scan.TEMPLATES), how.pop("phrases", license_scan.PHRASES)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    law = {"least": 6, "gap": 8, "coverage": 0.25} | how
    compared = found = 0
    for r in license_scan.scan(frame, templates=templates, phrases=phrases, **how).collect():
        plain = plain_license_scan(texts[r.doc_id], templates, phrases, **law)
        if plain is not None:
            got = [(s.label, s.first_word, s.last_word, s.coverage) for s in r.spans]
            assert (r.base_labels, r.labels, r.score, got) == plain, (r, plain)
            compared, found = compared + 1, found + len(got)
    return compared, found


def test_license_chains_labels_and_scores_by_all_chains(spark):
    """Small alphabets, so that matches cross, overlap and repeat."""
    rng = random.Random(91)
    for alphabet in (5, 9, 30):
        draw = lambda n: [f"t{rng.randrange(alphabet)}" for _ in range(n)]
        bodies = [draw(rng.randrange(8, 26)) for _ in range(4)]
        bodies[1] += bodies[0][2:12]
        bodies[3] = bodies[2][:6] + draw(5) + bodies[2][6:]
        templates = {label: " ".join(b) for label, b in zip("abcd", bodies)}
        texts = [None, "", "t0", *templates.values()]
        for _ in range(120):
            made = []
            for _ in range(rng.randrange(1, 4)):
                b = rng.choice(bodies)
                lo = rng.randrange(len(b) - 4)
                piece = b[lo : lo + rng.randrange(4, 30)]
                for _ in range(rng.randrange(3)):
                    at = rng.randrange(len(piece))
                    piece = rng.choice([piece[:at] + draw(rng.randrange(1, 5)) + piece[at:], piece[:at] + piece[at + 1 :], piece]) or piece
                made += draw(rng.randrange(4)) + piece
            texts.append(" ".join(made))
        phrases = {"t1 t2": "x", "t0": "y"}
        compared, found = hold_license_scan(spark, texts, templates=templates, phrases=phrases, least=3, gap=3, coverage=0.3)
        assert compared > 40 and found > 40, (alphabet, compared, found)


def test_license_query_parameters_by_all_chains(spark):
    """The query's own templates, whole, cut, mixed and with words put in, out and exchanged."""
    rng = random.Random(92)
    texts = [None, ""]
    for text in license_scan.TEMPLATES.values():
        for _ in range(4):
            w = text.split()
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(w))
                w = rng.choice([[*w[:at], *words(rng, rng.randrange(1, 12)), *w[at:]], w[:at] + w[at + 3 :], w[: at + 20], [*w[:at], "changed", *w[at + 1 :]]])
            other = rng.choice(list(license_scan.TEMPLATES.values())).split()
            lo = rng.randrange(len(other))
            texts.append(" ".join([*words(rng, rng.randrange(5)), *w, *rng.choice([[], ["under", "the", "MIT", "License"]]), *other[lo : lo + 30]]))
    compared, found = hold_license_scan(spark, texts)
    assert compared > 100 and found > 100, (compared, found)


def test_license_templates_are_found(spark, docs, empty):
    body = license_scan.TEMPLATES["bsd"].replace("binary", "object", 1)
    rows = [(0, "intro words here " + body + " and more"), (1, "nothing of that kind"), (2, license_scan.TEMPLATES["mit"] + " " + license_scan.TEMPLATES["mpl"])]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].labels == "bsd" and got[0].base_labels == "" and got[0].score > 0.8 and got[0].spans[0].first_word == 3
    assert got[1].labels == "" and got[1].score == 0 and set(got[2].labels.split(",")) >= {"mit", "mpl"}
    assert license_scan.scan(docs, keep=tuple(docs.columns)).count() == docs.count() and license_scan.scan(empty).count() == 0
