"""Operators 6 and 7: scores recomputed by plain loops, pairs that no single term
shows, labels without sense, samples, awkward ids."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from quern.llm import factorization, quality_classifier, toxicity
from quern.llm.bytesnp import BYTE_CODE, prefix_hash, span_hash


def name(raw: bytes) -> int:
    codes = BYTE_CODE[np.frombuffer(raw, np.uint8)]
    return int(span_hash(prefix_hash(codes), np.array([0]), np.array([len(raw)]))[0])


def lowered(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_terms(text: str, settings) -> dict[int, float]:
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))]
    found: Counter = Counter()
    for kind, size in enumerate((None, *settings.stems)):
        for w in words:
            if size is None or len(w) > size:
                found[((name(w[:size]) + kind) % 2**64 >> 8) % settings.buckets] += 1
    return {b: math.log2(1 + n) if settings.counted else 1 / math.sqrt(len(found)) for b, n in found.items()}


def plain_structure(text: str) -> list[int]:
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    n, raw = max(len(words), 1), text.encode()
    upper, lower = (len(re.findall(p, text)) for p in ("[A-Z]", "[a-z]"))
    stats = {
        "n_words": len(words), "n_chars": len(text), "word_length": sum(len(w.encode()) for w in words) / n,
        "symbols_per_word": len(re.findall(r"[#*$%&|<>]", text)) / n, "exclamations_per_word": text.count("!") / n,
        "capitals": upper / max(upper + lower, 1), "digits": len(re.findall("[0-9]", text)) / max(len(raw), 1),
        "words_like_previous": sum(a == b for a, b in zip(words, words[1:])) / n, "distinct_words": len(set(words)) / n,
        "words_per_line": len(words) / (text.count("\n") + 1), "bars_per_word": text.count("|") / n, "punctuation_per_word": len(re.findall(r"[.,;:?]", text)) / n,
    }
    out, at = [], 0
    for key, edges in factorization._EDGES.items():
        out.append(at + sum(e <= stats[key] for e in edges))
        at += len(edges) + 1
    return out


def plain_score(text: str | None, model) -> float:
    text = text or ""
    terms = plain_terms(text, model.settings)
    if model.structure:
        terms = {k: 1.0 for k in plain_structure(text)} | {b + factorization.N_STRUCTURE: v for b, v in terms.items()}
    length = math.sqrt(sum(v * v for v in terms.values())) or 1
    logit = model.bias + sum(model.weights[i] * v for i, v in terms.items())
    logit += sum(float(model.factors[i] @ model.factors[j]) * a * b / length**2 for (i, a), (j, b) in itertools.combinations(terms.items(), 2))
    return 1 / (1 + math.exp(-min(30, max(-30, logit))))


def test_scores_by_plain_loops(spark):
    rng = random.Random(41)
    pool = ["Über", "the", "vile", "FOLK", "a!", "b|c", "12", "x\ny", "émeute", "***", "<p>", "repeat repeat", "langeswort", "😀"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(120)] + [None, "", " \n ", "the " * 3000]
    rows = [(k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int("FOLK" in (t or "")), int("vile" in (t or ""))) for k, t in rows], "doc_id long, quality int, toxic int")
    for module in (quality_classifier, toxicity):
        model = module.train(docs, labels)
        assert np.abs(model.factors).max() > 0
        for r in module.classify(docs, model).collect():
            assert abs(r.score - plain_score(r.text, model)) < 1e-5, (module.__name__, r.text)


def balanced(n: int, seed: int):
    """Texts with one word of each of two pairs; the label is 1 where they go together:
    no single word says anything about it."""
    rng = random.Random(seed)
    texts, marks = [], []
    for _ in range(n):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(15, 60))]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w.insert(rng.randrange(len(w)), "vile" if a else "kind")
        w.insert(rng.randrange(len(w)), "folk" if b else "tree")
        texts.append(" ".join(w))
        marks.append(int(a == b))
    return texts, marks


def test_pairs_that_no_single_term_shows(spark):
    texts, marks = balanced(3600, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    fresh, truth = balanced(1000, 2)
    right = lambda model: (np.round(model.scores(pa.array(fresh))) == truth).mean()
    assert right(toxicity.train(docs, labels)) >= 0.95
    assert right(toxicity.train(docs, labels, toxicity.SETTINGS._replace(factors=0))) <= 0.6  # an additive model


def test_labels_without_sense(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(40)))) for k in range(400)] + [(400, None), (401, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for marks in (lambda: rng.randrange(2), lambda: 1, lambda: 0):
        labels = spark.createDataFrame([(k, marks(), marks()) for k, _ in rows], "doc_id long, quality int, toxic int")
        for module in (quality_classifier, toxicity):
            assert all(0 <= r.score <= 1 for r in module.classify(docs, module.train(docs, labels)).collect())


def test_the_sample_is_bounded_and_the_same_however_rows_lie(spark):
    rng = random.Random(6)
    rows = [(f"id{k % 150}", " ".join(f"w{rng.randrange(50)}" for _ in range(30))) for k in range(300)] + [("id7", "twice the same text")] * 40
    marks = [(f"id{k}", k % 2) for k in range(150)]
    labels = spark.createDataFrame(marks, "doc_id string, toxic int")
    whole = toxicity.SETTINGS._replace(sample=60)
    models = [toxicity.train(spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id string, text string").repartition(n), labels, whole) for n in (1, 5)]
    assert models[0].bias == models[1].bias and (models[0].weights == models[1].weights).all() and (models[0].factors == models[1].factors).all()
    few = toxicity.train(spark.createDataFrame(rows, "doc_id string, text string"), labels, whole._replace(sample_bytes=1))
    assert not few.weights.any()  # one row, hence one class
