"""Rules against plain Python, at their edges and on Korean text."""

from __future__ import annotations

import gc
import hashlib
import random
import re
import time
import unicodedata
import weakref
from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern import schemas
from quern.functions import instruct as I
from quern.functions import numbers as N
from quern.functions import text as T
from quern.functions.extract import generic_text, instruction_fields, text_by_source
from quern.operators import bpe, dedup, instructions, metrics, order, tokens
from quern.plans import pipelines
from quern.sources import readers, recipes, sinks, specs
from quern.streaming import clean as streaming


def column(spark, values, *makers):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    rows = frame.select("k", *[m(F.col("t")).alias(f"c{i}") for i, m in enumerate(makers)]).orderBy("k").collect()
    out = [[r[f"c{i}"] for r in rows] for i in range(len(makers))]
    return out[0] if len(makers) == 1 else out


TEXTS = ["", "   ", "　  a\x1cb  c ", "é combining", "😀😀 emoji", "٣٤ digits 12", "가나 다라 마바", "Hello, World. Again! And? ok", "a_b-c", "x" * 30, "no.split here", "tab\tnew\nline"]


def test_scalar_rules(spark):
    got = column(
        spark, TEXTS, lambda t: F.length(t), T.strip, lambda t: F.size(T.words(t)), lambda t: F.size(T.sentences(t)), T.text_hash,
        lambda t: F.round(T.digit_ratio(t), 9), lambda t: F.round(T.special_char_ratio(t), 9), lambda t: F.round(T.lexical_diversity(t), 9), T.repeated_word_run,
    )
    for k, t in enumerate(TEXTS):
        import hashlib

        w = t.split()
        hashed = hashlib.md5(re.sub(r"\s+", " ", t.lower().strip()).encode()).hexdigest()
        n = len(t) or 1
        expected = [len(t), t.strip(), len(w), len(re.split(r"[.!?]\s+", t)), hashed, round(len(re.findall(r"\d", t)) / n, 9), None, round(len(set(w)) / len(w), 9) if w else 1.0, False]
        for i, e in enumerate(expected):
            if e is not None:
                assert got[i][k] == e, (t, i)
        if "\x1c" not in t:
            assert got[6][k] == round(len(re.findall(r"[^\w\s가-힣]", t)) / n, 9), t


def test_language_boundary(spark):
    assert column(spark, ["가" + "a" * 4, "가" + "a" * 5, "   ", "", "가 나 ab"], T.detect_language) == ["ko", "en", "en", "en", "ko"]


def test_repeated_sentence_of_long_texts(spark, monkeypatch):
    """Equal to plain searches, and linear in the length: each sentence was looked for in all of the text before."""
    from quern.functions import repeats

    rng = random.Random(4)
    for most in (0, repeats._PLAIN):
        monkeypatch.setattr(repeats, "_PLAIN", most)
        for _ in range(500):
            w = [rng.choice(["ab", "가나", "the ferry", "b c", "12"]) for _ in range(rng.choice([2, 4, 8]))]
            t = "".join(rng.choice(w) + rng.choice([" ", " ", ". ", "! ", "", "b."]) for _ in range(rng.choice([5, 20, 60, 200])))
            parts = re.split(r"[.!?]\s+", t)
            assert repeats.repeats(t.encode()) == (len(parts) >= 3 and any(len(s) > 10 and t.count(s) >= 3 for s in parts)), t
    long = [f"sentence of its own, number {rng.random()}, in a row of them" for _ in range(24_000)]
    began = time.time()
    assert column(spark, [". ".join(long), ". ".join([*long, "x" + long[7] + "y", long[7] + "z", "end"]), None], T.repeated_sentence) == [False, True, None]
    assert time.time() - began < 15


def test_word_minimum(spark):
    rows = [("가 나 다 라", "ko"), ("가 나 다 라 마", "ko"), ("a b c d e f g", "en"), ("a b c d e f g h", "fr")]
    frame = spark.createDataFrame(rows, "t string, l string")
    assert [r[0] for r in frame.select(T.enough_words(F.col("t"), F.col("l"))).collect()] == [False, True, False, True]


def test_repetition(spark):
    ten, eleven = "abcdefghij", "abcdefghijk"
    texts = [f"{eleven}. {eleven}. {eleven}. ", f"{ten}. {ten}. {ten}. ", f"{eleven}. {eleven}. other one", "a a a a", "a a a a a", "x aa aa aa aa aab", "q q  q\tq\nq z"]
    got = column(spark, texts, T.repeated_sentence, T.repeated_word_run)

    def one(t):
        s = re.split(r"[.!?]\s+", t)
        return len(s) >= 3 and any(len(x) > 10 and t.count(x) >= 3 for x in s)

    def two(t):
        w = t.split()
        return any(len(set(w[i : i + 5])) == 1 for i in range(len(w) - 4))

    assert got[0] == [one(t) for t in texts] and got[1] == [two(t) for t in texts]


def test_document_failure_edges(spark):
    w = "abcdefghi "
    texts = ["a" * 49, (w * 5)[:50], w * 500, w * 500 + "x", "http://a.b " * 3 + w * 8, "http://a.b " * 4 + w * 8]
    texts = ["a b c d e f g h " + "z" * 34, "a b c d e f g h " + "z" * 33, " ".join(f"word{k}" for k in range(20)) + " http://a.b" * 3, " ".join(f"word{k}" for k in range(20)) + "".join(f" http://a.b/{k}" for k in range(4)), " ".join("123x" for _ in range(3)) + " " + " ".join(f"w{k}345678" for k in range(9))]
    got = column(spark, texts, lambda t: T.document_failure(t, F.lit("en")))
    assert got == [None, "length", None, "urls", "digits"]


def test_instruction_edges(spark):
    good = "this answer has enough words to pass"
    outputs = [good, "short one", "one two", "ends like this...", "네 그리고 이것은 답 등", "sorry I cannot do that for you now", "sorry I cannot do that for you now my friend", "I'm not sure of that", "a a a a a a a a a b"]
    frame = spark.createDataFrame([(k, o) for k, o in enumerate(outputs)], "k int, o string")
    got = [r[1] for r in frame.select("k", T.instruction_failure(F.lit("a proper question"), F.col("o"))).orderBy("k").collect()]
    assert got == [None, "output_length", "output_length", "output_truncated", "output_truncated", "output_refusal", None, "output_refusal", "output_pattern"]
    long = column(spark, ["x y " * 124 + "xyz", "x y " * 125 + "z"], lambda t: T.instruction_failure(t, F.lit(good)))
    assert long[1] == "instruction_length"


def test_tasks(spark):
    texts = ["Show me", "요약해 줘", "번역 부탁", "무엇을 요약", "classify it", "create a poem", "let us talk", "계산", "a program", "explain", "nothing"]
    assert column(spark, texts, I.classify_task) == ["qa", "summarization", "translation", "qa", "classification", "generation", "conversation", "math", "coding", "reasoning", "general"]


def test_variants(spark):
    frame = spark.createDataFrame([(0, "설명하세요 이것", "ko"), (1, "Please Explain it, Please ", "en"), (2, "can you", "en"), (3, "해주세요", "ko"), (4, "해줘", "ko"), (5, "zzz", "en")], "k int, t string, l string")
    rows = frame.select("k", I.paraphrase(F.col("t"), F.col("l")).alias("p"), I.change_formality(F.col("t"), F.col("l")).alias("f"), I.with_context(F.col("t"), F.col("l"), F.col("k").cast("string")).alias("c"), I.with_examples(F.col("t"), F.col("l"), F.col("k").cast("string")).alias("e")).orderBy("k").collect()
    assert [r.p for r in rows] == ["설명해주세요 이것", "Explain it, ", None, None, None, None]
    assert [r.f for r in rows] == [None, None, "could you", "해줘", "해주세요", None]
    assert all(any(r.c == p + t for p in I.PREFIXES[x]) and any(r.e == f"{t}. {p}" for p in I.EXAMPLES[x]) for r, (t, x) in zip(rows, [(r.t, r.l) for r in frame.orderBy("k").collect()]))


def test_text_by_source(spark):
    rows = [
        ("wiki_ko", "a", "b", None, None, None, None, "a"), ("bbc_news", "", " c ", None, None, None, None, "c"), ("petitions", None, "body", "head", None, None, None, "head\nbody"),
        ("petitions", None, "", "head", None, None, None, "head"), ("chat", None, None, None, None, None, "ctx", "ctx"), ("reddit", "t", None, None, "b", None, None, "b"),
        ("reddit", "t", None, None, "", None, None, "t"), ("other", "", None, None, None, "art", None, "art"), ("c4", None, "x", None, None, None, None, None), ("wiki", "  ", None, None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "source string, text string, content string, title string, body string, article string, context string, expected string")
    assert all(r.got == r.expected for r in frame.withColumn("got", text_by_source(frame)).collect())
    other = spark.createDataFrame([(None, "short", "a text of more than twenty characters"), ("d", "x", "y")], "document string, a string, b string")
    assert [r[0] for r in other.select(generic_text(other)).collect()] == ["a text of more than twenty characters", "d"]


def test_instruction_fields(spark):
    rows = [
        {"source": "alpaca_ko", "instruction": " i ", "input": " g", "output": "o "}, {"source": "evol", "conversations": [{"value": "q"}, {"value": "a"}, {"value": "z"}]}, {"source": "evol", "conversations": [{"value": "q"}]},
        {"source": "chatgpt", "instruction": "i", "output": "o"}, {"source": "ultrachat", "messages": [{"content": "q"}, {"content": "a"}]}, {"source": "sharegpt", "conversations": [{"value": "q"}, {"value": "a"}]},
        {"source": "dolly", "instruction": "i", "context": "c", "response": "r"}, {"source": "oasst", "role": "assistant", "text": "a", "parent_text": "p"}, {"source": "oasst", "text": "q", "response": "r"},
        {"source": "other", "question": "q", "answer": "a", "context": "c"}, {"source": "other", "question": "q"},
    ]
    frame = spark.createDataFrame(rows, f"source string, {schemas.RAW_INSTRUCTION}")
    got = [tuple(r.f) if r.f else None for r in frame.select(instruction_fields(frame).alias("f")).collect()]
    assert got == [("i", "g", "o"), ("q", "", "a"), None, ("i", "", "o"), ("q", "", "a"), ("q", "", "a"), ("i", "c", "r"), ("p", "", "a"), ("q", "", "r"), ("q", "c", "a"), None]


def test_dedup_and_unsupported_language(spark):
    text = "one two three four five six seven eight nine ten words are enough here"
    rows = [(0, text, "fr", "a"), (1, text, "en", "b"), (2, text + " more", "en", "a"), (3, "short", "en", "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, language string, source string")
    assert [r.doc_id for r in pipelines.clean(frame, ["source", "doc_id"], detect=False).collect()] == [2]
    c = pipelines.counters(frame, ["source", "doc_id"], detect=False).first()
    assert (c.total_processed, c.filtered_out, c.duplicates_removed, c.korean_texts, c.english_texts) == (4, 1, 1, 0, 1)


def test_mixing_short_languages(spark):
    rows = [(k, "ko" if k < 30 else "en") for k in range(100)]
    frame = spark.createDataFrame(rows, "k long, language string")
    count = lambda d: {r.language: r["count"] for r in d.groupBy("language").count().collect()}
    assert count(order.mix_by_ratio(frame, "k")) == {"ko": 30, "en": 30}
    assert count(order.mix_by_ratio(frame, "k", target=10)) == {"ko": 7, "en": 3}
    assert count(order.mix_by_ratio(frame, "k", target=1000)) == {"ko": 30, "en": 70}
    assert count(order.mix_prefix(frame, "k")) == {"ko": 21, "en": 21}
    with pytest.raises(ValueError):
        order.mix_by_ratio(frame, "k", 0.5, 0.4)
    w = spark.createDataFrame([(0.5,), (1.0,), (2.7,)], "w double")
    assert sorted(r.w for r in order.replicate(w, "w").collect()) == [1.0, 2.7, 2.7]


def test_augmentation_gives_what_it_can(spark):
    rows = spark.createDataFrame([(0, "Explain how it works", "", "an answer", "en", "s"), (1, "can you help me", "", "an answer", "en", "s")], "conv_id long, instruction string, input string, output string, language string, source string")
    every = instructions.augment(rows, F.lit(100)).collect()
    assert len(every) == 6 and all(r.source.startswith("s_") for r in every) and instructions.augment(rows, F.lit(2)).count() == 2
    raw = spark.createDataFrame([(k, "alpaca", f"Please write number {k} of the list", f"the answer number {k} of the list is this") for k in range(12)], "key long, source string, instruction string, output string").withColumn("language", F.lit("en"))
    out = pipelines.instructions(raw, "key", pipelines.InstructionConfig(target=50))
    assert out.count() == 20 and set(out.columns) == {"key", "instruction", "input", "output", "language", "source", "task_category"}


def test_chunks_and_padding(spark):
    frame = spark.createDataFrame([(n, list(range(1, n + 1))) for n in (7, 8, 11, 12, 16)], "n int, ids array<long>")
    got = {}
    for r in tokens.chunks(frame, "ids", 8, 4).collect():
        got.setdefault(r.n, []).append(r.chunk)
    assert got == {n: [list(range(i + 1, i + 9)) for i in range(0, n - 7, 4)] for n in (8, 11, 12, 16)}
    p = frame.select(tokens.pad(F.col("ids"), 10).alias("p"), tokens.mask(F.col("ids"), 10).alias("m")).first()
    assert p.p == [1, 2, 3, 4, 5, 6, 7, 0, 0, 0] and p.m == [1] * 7 + [0] * 3
    assert spark.range(1).select(tokens.labels(F.array(F.lit(5), F.lit(0)))).first()[0] == [5, -100]


def test_morphemes(spark):
    texts = ["나는 학교에서 공부합니다.", "Hello world 123!", "이", "집으로부터까지", "한다고 했습니다", ""]

    def python(text):
        out = []
        for w in re.findall(tokens.PUNCTUATION + r"|\d+|[a-zA-Z]+|(?:(?!" + tokens.PUNCTUATION + r")\S)+", text):
            if re.fullmatch("[a-zA-Z]+", w):
                out.append(w.lower())
                continue
            for parts in (tokens.PARTICLES, tokens.ENDINGS):
                tail = next((p for p in sorted(parts, key=len, reverse=True) if w.endswith(p) and len(w) > len(p)), None)
                if tail:
                    out += [w[: -len(tail)], tail]
                    break
            else:
                out.append(w)
        return out

    assert column(spark, texts, tokens.morphemes) == [python(t) for t in texts]
    assert column(spark, ["나는 집에서 살아요."], lambda t: tokens.morpheme_join(tokens.morphemes(t))) == ["나는 집에서 살아요."]


def test_morphemes_joined_at_random(spark):
    """A tail is taken by the token before it unless that one is a taken tail itself."""
    rng = random.Random(7)
    pool = ["이", "에서", "습니다", "집", "hello", ".", ",", "(", "12", "가나"]
    rows = [[rng.choice(pool) for _ in range(rng.randrange(14))] for _ in range(400)] + [["word"] * 50_000 + ["이"]]
    tails = {*tokens.PARTICLES, *tokens.ENDINGS}

    def plain(row):
        taken = [False] * len(row)
        for i in range(1, len(row)):
            taken[i] = row[i] in tails and not taken[i - 1]
        out = ""
        for i, t in enumerate(row):
            heads = i + 1 < len(row) and taken[i + 1]
            glued = taken[i] or (not heads and re.match(tokens.PUNCTUATION, t))
            out += t if glued or not i else " " + t
        return out

    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, r array<string>")
    got = {r.k: r.x for r in frame.select("k", tokens.morpheme_join(F.col("r")).alias("x")).collect()}
    assert got == {k: plain(r) for k, r in enumerate(rows)}


def test_pieces_are_the_same_in_both_places(spark):
    """The encoder's split is that of the native pre_tokens, over normalized texts."""
    rng = random.Random(9)
    parts = ["a", "Bc", "é", "한국", " ", "12345", "!?", "'s", "'LL", "_", "😀", "\u0301", "\u3000", "\xa0", "\n", "ⅷ", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(800)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    letters = sorted({c for t in texts for c in unicodedata.normalize("NFD", t)})
    vocab = {c: k + 4 for k, c in enumerate(letters)}
    got = frame.select("k", tokens.pre_tokens(tokens.nfd(F.col("t"))).alias("p"), bpe.bpe_encode(F.col("t"), vocab, []).alias("x")).collect()
    assert all(r.x == [2, *(vocab[c] for p in r.p for c in p), 3] for r in got)


def test_piece_counts_are_those_of_all_texts(spark, monkeypatch):
    """Words are counted before they are split: first words, numbers, marks, empty and null texts; several counts a task."""
    monkeypatch.setattr(bpe, "_MOST_WORDS", 40)
    rng = random.Random(10)
    parts = ["a", "Bc", "é", "한국", " ", " ", "12345", "!?", "'s", "_", "😀", "\u0301", "\u3000", "\xa0", "\x1c", "\r\n", "ⅷ", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(900)] + ["", None, " \n", "7", " 7"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    want = tokens.word_counts(frame, tokens.pre_tokens(tokens.nfd(F.col("t"))))
    assert sorted(bpe.piece_counts(frame, F.col("t")).collect()) == sorted(want.collect())
    assert bpe.piece_counts(frame.where("false"), F.col("t")).collect() == []


def test_a_task_merges_a_piece_once():
    """Also where it stands in several words, or in a later batch; the ids are those of the words alone."""
    plain, seen = bpe.Encoder({"a": 4, "b": 5, "ab": 6, " ": 7, " ab": 8, ",": 9, "1": 10}, [("a", "b"), (" ", "ab")]), []

    def encoder(pieces):
        seen.extend(pieces)
        return plain(pieces)

    cache, got = bpe._Cache(encoder, tokens.GPT_SPLIT), []
    for batch in (["\nab,", "ab", "ab,", "11"], ["ab1", "\n11", "\n,ab", "ab,,"]):
        for w in batch:
            cache.number[w]
        cache.extend()
    for ids in np.split(cache.ids, np.cumsum(cache.size)[:-1]):
        got.append(ids.tolist())
    assert got == [[6, 9], [8], [8, 9], [10, 10], [8, 10], [10, 10], [9, 6], [8, 9, 9]]
    assert len(seen) == len(set(seen))


def test_a_dropped_cache_is_freed_at_once():
    """Also with the collector of cycles off: a task drops many, each of some 200,000 words."""
    class Word(str):
        pass

    cache, word = bpe._Cache(bpe.Encoder({"a": 4}, []), tokens.GPT_SPLIT), Word("\naa")
    seen = weakref.ref(word)
    gc.disable()
    try:
        assert cache.number[word] == 0 and cache.number["b"] == 1 and cache.piece["c"] == len(bpe._BLANK)
        cache.extend()
        del cache, word
        assert seen() is None
    finally:
        gc.enable()


def test_training_rows_are_small(spark):
    """Readers and Arrow take thousands of rows at once, so no row holds a block of words, or all its pairs."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(9_000)] + ["k" * 5_000]
    counts = spark.createDataFrame([(w, 1 + k % 7) for k, w in enumerate(dict.fromkeys(words))], "token string, freq long").repartition(2)
    table = bpe._Blocks(counts, list("abcdefghijk"))
    for merges in ([], [(0, 1, 11), (2, 3, 12)]):
        if merges:
            table.merge(merges)
        rows = table.table.read().select(F.octet_length("symbols"), F.octet_length("freq"), F.size("pair")).collect()
        assert len(rows) > 20 and all((r[0] or 0) <= 4 * (bpe._PAGE + 5_001) and (r[1] or 0) <= 8 * bpe._PAGE and (r[2] or 0) <= bpe._PAGE for r in rows)
        # one row has the longest word
        assert sum((r[0] or 0) > 4 * (bpe._PAGE + 10) for r in rows) == 1


def test_bpe_coded(spark, monkeypatch):
    """The same as both columns, in small parts: long, empty and null texts."""
    monkeypatch.setattr(bpe, "_SOME", 7)
    monkeypatch.setattr(bpe, "_SOME_BYTES", 300)
    rng = random.Random(12)
    texts = ["".join(rng.choice(["ab", "b", " ", "한", "é", "7", "\n", "?"]) for _ in range(rng.choice([0, 3, 20, 400]))) for _ in range(120)] + [None, "", " "]
    parts = list(bpe._some(pa.array(texts, pa.string()).slice(1)))
    assert [x for p in parts for x in p.to_pylist()] == texts[1:]
    assert all(len(p) == 1 or len(p) <= 7 and sum(len((x or "").encode()) for x in p.to_pylist()) <= 300 for p in parts)
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").repartition(2)
    vocab = {**tokens.BPE_SPECIALS, "a": 4, "b": 5, "ab": 6, " ": 7, "7": 8, "\u1112": 9, "\u1161\u11ab": 10, "\u1161": 11, "\u11ab": 12}
    merges = [("a", "b"), ("\u1161", "\u11ab")]
    ids = bpe.bpe_encode(F.col("text"), vocab, merges)
    want = frame.select("k", ids.alias("ids")).withColumn("decoded", bpe.bpe_decode(F.col("ids"), vocab))
    got = bpe.bpe_coded(frame, ["k"], F.col("text"), vocab, merges)
    assert got.columns == ["k", "ids", "decoded"] and sorted(got.collect()) == sorted(want.collect())
    assert bpe.bpe_coded(frame.where("false"), ["k"], F.col("text"), vocab, merges).collect() == []


def test_bpe_decode_of_any_ids(spark):
    """Specials, unknown, null and negative ids give nothing; null and empty lists; scripts are spaced; one string a row."""
    vocab = {**tokens.BPE_SPECIALS, "ab": 4, "한": 6, " c": 7}
    rows = [[2, 4, 6, 4, 3], [], None, [5, 8, 99, -1, None, 4], [7, 1, 0, 7], [6, 6]]
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, ids array<int>").repartition(1)
    got = {r.k: r.x for r in frame.select("k", bpe.bpe_decode(F.col("ids"), vocab).alias("x")).collect()}
    assert got == {0: "ab 한 ab", 1: "", 2: None, 3: "ab", 4: " c c", 5: "한한"}
    encoded = frame.select(bpe.bpe_encode(F.lit("ab"), vocab, [("a", "b")]).alias("x"))
    plan = encoded.select(F.size("x"), bpe.bpe_decode(F.col("x"), vocab))._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.count("encode(") for line in plan.splitlines() if "EvalPython" in line) == 1


def test_bpe(spark):
    frame = spark.createDataFrame([("low low low low low",), ("lower lower newest newest newest",), ("widest 한국어 abc",)], "text string")
    counts = tokens.word_counts(frame, tokens.pre_tokens(tokens.nfd(F.col("text"))))
    vocab, merges = bpe.train_bpe(counts, 60)
    assert ("o", "w") in merges and len(vocab) <= 60 and vocab["<eos>"] == 3
    back = frame.select(bpe.bpe_decode(bpe.bpe_encode(F.col("text"), vocab, merges), vocab)).first()[0]
    assert back == "low low low low low"
    assert bpe.merge(list("aaa"), {("a", "a"): 0}) == ["aa", "a"]
    assert column(spark, ["한 é  x "], tokens.nfd) == [unicodedata.normalize("NFD", "한 é x")]


def brute_bpe(freqs, size):
    spelled = {w: list(w) for w in freqs}
    vocab = dict(tokens.BPE_SPECIALS)
    for c in sorted({c for w in freqs for c in w}):
        vocab.setdefault(c, len(vocab))
    merges = []
    while len(vocab) < size:
        pairs = Counter()
        for w, x in spelled.items():
            for p in zip(x, x[1:]):
                pairs[p] += freqs[w]
        if not pairs:
            break
        merges.append(max(pairs, key=lambda p: (pairs[p], p)))
        vocab.setdefault("".join(merges[-1]), len(vocab))
        spelled = {w: bpe.merge(x, {merges[-1]: 0}) for w, x in spelled.items()}
    return vocab, merges


#: On the driver; in rounds; with all pairs of a count beyond the bound; with segments beyond theirs.
BOUNDS = [(10**9, 20_000, 2_000_000), (0, 20_000, 2_000_000), (0, 2, 2_000_000), (0, 20_000, 60), (0, 12, 700)]


@pytest.mark.parametrize("bounds", BOUNDS)
def test_bpe_trains_on_all_words(spark, bounds):
    rng = random.Random(31)
    freqs = {"".join(rng.choice("aaabcdé😀") for _ in range(rng.randrange(1, 12))): rng.randrange(1, 9) for _ in range(200)}
    counts = spark.createDataFrame(list(freqs.items()) + [("", 5)], "token string, freq long").repartition(3)
    assert bpe.train_bpe(counts, 40, *bounds) == brute_bpe(freqs, 40)
    assert bpe.train_bpe(counts.where("false"), 40, *bounds) == (tokens.BPE_SPECIALS, [])


def test_bpe_trains_to_the_end(spark):
    """Until no word has a pair, over several blocks; symbols made in two ways end a round."""
    rng = random.Random(5)
    freqs = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))): rng.choice([1, 1, 2, 40]) for _ in range(90)}
    counts = spark.createDataFrame(list(freqs.items()), "token string, freq long").repartition(6)
    assert bpe.train_bpe(counts, 10**6, driver_chars=0) == brute_bpe(freqs, 10**6)


def test_encoder_merges_as_the_plain_loop():
    """Trained merges and any others, short pieces and long ones."""
    rng = random.Random(6)
    for turn in range(40):
        letters = "abcé"[: rng.randrange(1, 5)]
        made = [*letters]
        merges = []
        for _ in range(rng.randrange(0, 14)):
            merges.append((rng.choice(made), rng.choice(made)))
            made.append("".join(merges[-1]))
        if turn % 3 == 0:
            rng.shuffle(merges)
        vocab = {s: k + 4 for k, s in enumerate(dict.fromkeys(made[: rng.randrange(1, len(made) + 1)]))}
        pieces = ["".join(rng.choice(letters + "xx"[: turn % 3]) for _ in range(rng.choice([0, 1, 2, 5, 9, 64, 65, 300]))) for _ in range(60)]
        ids, size = bpe.Encoder(vocab, merges)(pieces)
        ranks = {p: k for k, p in enumerate(merges)}
        want = [[vocab.get(s, 1) for s in bpe.merge(list(p), ranks)] for p in pieces]
        assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == want


def test_long_pieces_are_encoded_in_time():
    import time

    merges = [("a", "b"), ("ab", "ab"), ("abab", "abab"), ("b", "a")]
    began = time.perf_counter()
    ids, size = bpe.Encoder({}, merges)(["ab" * 100_000, "a" * 200_000, "ba" * 100_000])
    assert size.tolist() == [25_000, 200_000, 25_003]
    assert time.perf_counter() - began < 20


def test_bpe_counts_pairs_of_rare_words(spark):
    often = spark.range(50_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("token"), F.lit(2).cast("long").alias("freq"))
    rare = spark.range(150_000).select(F.concat(F.lit("zy"), F.col("id").cast("string")).alias("token"), F.lit(1).cast("long").alias("freq"))
    assert bpe.train_bpe(often.unionByName(rare), 18)[1][0] == ("z", "y")



def test_morphemes_against_plain_loop(spark):
    """Words that end in no Hangul skip the tails' patterns, words that begin as no known one the search of the map."""

    def plain(t):
        out = []
        for w in re.findall(rf"{tokens.PUNCTUATION}|\d+|[a-zA-Z]+|(?:(?!{tokens.PUNCTUATION})\S)+", t):
            if re.fullmatch("[a-zA-Z]+", w):
                out.append(w.lower())
                continue
            tail = next((m[1] for p in (tokens.PARTICLES, tokens.ENDINGS) if (m := re.fullmatch(f"(?s).+?({tokens._suffix(p)})", w))), "")
            out += [w[: len(w) - len(tail)], tail] if tail else [w]
        return out

    texts = ["학교에서 공부를 했습니다. Hello세계 세계Hello 12개를 <pad> a를 를 때문에 가격이다! É École 가É", "사과를을 먹습니까 <s>한테 x입니다 한다 ABC를", "", "Zz9를 9Zz을"]
    expected = [plain(t) for t in texts]
    vocab = {**tokens.morpheme_vocabulary(), "hello": 900, "<": 901}
    known, all_ids = column(spark, texts, tokens.morphemes, lambda t: tokens.morpheme_encode(t, vocab))
    assert known == expected
    hashed = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64536 + 1000
    assert all_ids == [[1, *(vocab.get(w, hashed(w)) for w in x), 2] for x in expected]


def test_subwords_of_texts(spark):
    """Whole texts give what arrays of words give, each word once; the query runs one UDF over them (two before)."""
    from quern.plans import catalog

    vocab = {"한국어", "한국", "pre", "fix", "es", "the", "Straße"}
    texts = [*TEXTS, "한국어말 한국인 prefixes zz 한국어", "prefixes, the.prefixes\x1cthe\u2003(한국인)! prefixes", " . ", None]
    whole, arrays = column(spark, texts, lambda t: tokens.subword_text(t, vocab), lambda t: F.array_join(tokens.subwords(tokens.punctuation_tokens(t), vocab), " "))
    assert whole == arrays and whole[-1] is None
    plan = catalog.subword_fallback(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1


def test_subwords(spark):
    vocab = {"한국어", "한국", "pre", "fix", "p"}
    assert column(spark, ["한국어말 한국인 prefixes zz 한국어"], lambda t: tokens.subwords(tokens.punctuation_tokens(t), vocab)) == [["한국어", "말", "한국", "인", "pre", "fix", "e", "s", "zz", "한국어"]]


def test_numbers(spark):
    n = spark.createDataFrame([(999, 1.5), (1500, 75.5), (2_500_000, 3725.5), (3_100_000_000, 0.25)], "n long, s double")
    assert [r[0] for r in n.select(N.format_number(F.col("n"))).collect()] == ["999", "1.5K", "2.5M", "3.1B"]
    assert [r[0] for r in n.select(N.format_time(F.col("s"))).collect()][:3] == ["1.5초", "1분 15.5초", "1시간 2분 5.5초"]


def test_bigrams_across_texts(spark):
    texts = ["a b c", "", "d", "a b", "   ", "c d"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    w = " ".join(texts).split()
    pairs = list(zip(w, w[1:]))
    got = metrics.distinct_bigrams(frame, "text", "k").first()
    assert (got.n_bigrams, got.n_distinct) == (len(pairs), len(set(pairs)))


def test_sources(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "korean_raw_wiki.jsonl").write_text('{"text": "하나"}\n{"text": "broken\n\n[1]\n{"content": "no text"}\n')
    (tmp_path / "raw" / "instruction_raw_alpaca.jsonl").write_text('{"instruction": "i", "output": "o"}\n')
    raw = readers.json_lines(spark, f"{tmp_path}/raw")
    assert {(r.source, r.text) for r in raw.collect()} >= {("korean_raw_wiki", "하나"), ("korean_raw_wiki", None), ("instruction_raw_alpaca", None)}
    assert readers.corrupt_lines(spark, f"{tmp_path}/raw").count() == 2
    assert [r.source for r in readers.instruction_lines(spark, f"{tmp_path}/raw").collect()] == ["alpaca"]
    assert readers.training_lines(spark, str(tmp_path)).count() == 1000
    (tmp_path / "list.json").write_text('["a", "b"]')
    assert sorted(r.text for r in readers.json_array(spark, f"{tmp_path}/list.json").collect()) == ["a", "b"]
    (tmp_path / "chat.json").write_text('{"session_start": "x", "chat_history": [{"role": "user", "content": "hi"}, {"role": "bot", "content": "yo"}]}')
    assert [(r.turn, r.text) for r in readers.chat_history(spark, f"{tmp_path}/chat.json").orderBy("turn").collect()] == [(0, "hi"), (1, "yo")]
    entry = {"name": "one", "split": "train", "description": "", "text_field": "text", "limits": {"small": 1, "full": None}, "min_text_length": 1, "path": f"{tmp_path}/raw/korean_raw_wiki.jsonl"}
    one = specs.SourceSpec.from_json(entry)
    gone = specs.SourceSpec("gone", path=f"{tmp_path}/missing", priority=1)
    assert [s.name for s in specs.active([one, gone, specs.SourceSpec("off", enabled=False)])] == ["gone", "one"]
    assert readers.read_sources(spark, [one, gone]).count() == 1
    with pytest.raises(KeyError):
        specs.SourceSpec.from_json({"name": "x"})
    mixed = pipelines.corpus(spark, [one])
    assert {"text", "source", "language"} <= set(mixed.columns)
    assert readers.sample_instructions(spark).count() == 6 and readers.tokenizer_sample(None, None, "k", spark).count() == 6


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("a b", "en", "s"), ("c", "ko", "s")], "text string, language string, source string")
    at = f"{tmp_path}/out"
    assert sinks.write_corpus(frame, at) and not sinks.write_corpus(frame, at) and sinks.write_corpus(frame, at, force=True)
    assert spark.read.parquet(at).count() == 2
    files = sinks.manifest(spark, at, "*.parquet")
    assert sinks.disk_usage(files).first().files == 2
    assert sinks.unique_name("x", datetime(2024, 1, 2, 3, 4, 5)) == "x_20240102_030405"
    sinks.write_vocabulary(spark, {"a": 4}, [("a", "b")], f"{tmp_path}/v")
    assert sinks.read_vocabulary(spark, f"{tmp_path}/v") == ({"a": 4}, [("a", "b")])
    names = spark.createDataFrame([(f"/x/checkpoint-{k}/{n}",) for k in (1, 2, 10) for n in ("config.json", "model.bin")] + [("/x/checkpoint-9/config.json",)], "file string")
    assert sinks.latest_checkpoint(names).first().checkpoint == "checkpoint-2"
    done = spark.createDataFrame([("i", "", "o", "en", "s", "qa")], schemas.INSTRUCTION)
    assert sinks.write_instructions(done, f"{tmp_path}/i") and sinks.write_statistics(metrics.distribution(done, "task_category"), f"{tmp_path}/s") and sinks.write_texts(frame, f"{tmp_path}/t", as_lines=True)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, f"text number {k % 7} of a stream that has enough words to pass the rules") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/in")
    stream = streaming.read_stream(spark, f"{tmp_path}/in", "doc_id long, text string", files_per_trigger=1)
    out = streaming.run_available(streaming.clean_stream(stream).select("language", "hash"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert out.count() == 7


def test_rows_in_order_however_positions_lie(spark):
    """Quantile buckets: one far-off position doesn't put all others into one bucket."""
    rng = random.Random(8)
    positions = rng.sample(range(5000), 900) + [10**15, -(10**12)]
    rows = [(p, "ab"[p % 2], f"v{p}") for p in positions]
    frame = spark.createDataFrame(rows, "p long, g string, v string").repartition(5)
    bucket = order.position_bucket(frame, "p", 64)
    sizes = [r["count"] for r in frame.groupBy(bucket.alias("b")).count().collect()]
    assert max(sizes) < 60
    want = {(p, g): k for g in "ab" for k, p in enumerate(sorted(x for x, y, _ in rows if y == g), 1)}
    got = order.ranked(frame, ["g"], [F.col("p")], order.position_bucket(frame, "p"), overall="all").collect()
    assert {(r.p, r.g): r["rank"] for r in got} == want and {r["all"] for r in got} == {902}
    after = dict(zip(sorted(positions), [*(f"v{p}" for p in sorted(positions)[1:]), None]))
    assert {r.p: r.next for r in order.following(frame, "p", "v").collect()} == after
    assert {(r.p, r.g) for r in order.head_per_source(frame, "g", "p", 9).collect()} == {k for k, n in want.items() if n <= 9}


def test_limits_take_rows_as_they_stand_in_the_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for part in range(3):
        (tmp_path / "src" / f"part-{part}.json").write_text("".join(f'{{"text": "row {part} {k:04}"}}\n' for k in range(500)))
    one = specs.SourceSpec("one", path=f"{tmp_path}/src", limits={"small": 600})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("2k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r.text for r in readers.read_source(spark, one, "small").collect()}
            assert got == {f"row 0 {k:04}" for k in range(500)} | {f"row 1 {k:04}" for k in range(100)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_failed_sources_are_named(spark, tmp_path):
    gone = specs.SourceSpec("gone", path=f"{tmp_path}/missing")
    failed = {}
    assert readers.read_sources(spark, [gone], failed=failed).count() == 0 and list(failed) == ["gone"]
    with pytest.raises(Exception, match="missing"):
        readers.read_sources(spark, [gone], strict=True)


def test_chats_saved_and_loaded(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "a\nb")], "conv_id long, turn long, role string, text string")
    assert sinks.write_chats(turns, f"{tmp_path}/chats")
    back = spark.read.schema("chat_history array<struct<role:string,content:string>>").json(f"{tmp_path}/chats").select(F.posexplode("chat_history").alias("turn", "m")).select("turn", "m.role", "m.content")
    assert sorted(map(tuple, back.collect())) == [(0, "user", "a\nb"), (0, "user", "hi"), (1, "bot", "yo")]


def test_stream_takes_some_rows(spark, tmp_path):
    rows = [(k, f"text {k}") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/in")
    stream = streaming.take(streaming.read_stream(spark, f"{tmp_path}/in", "doc_id long, text string", files_per_trigger=1), 13)
    assert streaming.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/cp").count() == 13
    source = specs.SourceSpec("s", path=f"{tmp_path}/in", format="parquet", min_text_length=7, streaming=True)
    made = readers.stream_source(spark, source, "doc_id long, text string")
    assert streaming.run_available(made, f"{tmp_path}/out2", f"{tmp_path}/cp2").count() == 30


def test_keep_first(spark):
    frame = spark.createDataFrame([(2, "a", None), (1, "a", "x"), (3, "b", "y")], "k int, h string, v string")
    got = {(r.k, r.copies) for r in dedup.keep_first(frame, [F.col("h")], ["k"], "copies").collect()}
    assert got == {(1, 2), (3, 1)}


def test_encoders_with_specials(spark, tmp_path):
    row = spark.createDataFrame([("나는 x <unk> y",)], "t string")
    ids = row.select(tokens.hash_encode(F.col("t")).alias("i")).first().i
    assert ids[0] == 1 and ids[3] == 3 and ids[-1] == 2 and len(ids) == 6
    shown = row.select(tokens.hash_decode(tokens.hash_encode(F.col("t")), {ids[1]: "나는"}, {ids[2]: "guess"}).alias("s")).first().s
    assert shown == f"나는 guess* [UNK] [{ids[4]}]"
    vocab = tokens.morpheme_vocabulary(("나",))
    got = row.select(tokens.morpheme_encode(F.lit("나의 zz"), vocab, 3).alias("i")).first().i
    assert got == [1, vocab["나"], vocab["의"]]
    assert tokens.choose("pretrained", "/missing")[0] == "korean" and tokens.choose("what")[0] == "korean" and tokens.choose("improved_korean")[0] == "improved_korean"
    import public_tokenizers

    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        kind, encode = tokens.choose("pretrained", public_tokenizers.path(name))
        assert kind == "pretrained" and len(row.select(encode(F.lit("hello world")).alias("i")).first().i) >= 2


def test_recipes_ingest_and_config(spark, tmp_path):
    text = '{"korean_component": {"target_size_gb": 3, "datasets": [{"name": "a/b", "priority": 2, "license": "mit"}]}, "english_component": {"target_size_gb": 1, "datasets": [{"name": "c"}]}}'
    shares, found = recipes.load_recipe(text)
    assert shares == {"ko": 0.75, "en": 0.25} and [s.name for s in found] == ["a/b", "c"]
    spark.createDataFrame([("some text",), (None,)], "text string").write.json(f"{tmp_path}/in")
    spec = specs.SourceSpec("a/b", path=f"{tmp_path}/in", language="en")
    first, again = (recipes.ingest(spark, [spec], f"{tmp_path}/out").first() for _ in range(2))
    assert first.written and not again.written and first.bytes > 0 and spark.read.json(first.path).first().language == "en"
    config = recipes.ModelConfig.from_json(recipes.ModelConfig(n_heads=7).to_json())
    assert config.n_heads == 7 and recipes.config_errors({"vocab_size": 0, "d_model": 8, "n_heads": 3}) == [
        "missing: n_layers", "missing: max_seq_len", "missing: learning_rate", "missing: batch_size", "must be positive: vocab_size", "d_model must be a multiple of n_heads",
    ]
    whole = {"vocab_size": 8, "d_model": 12, "n_heads": 4, "n_layers": 1, "max_seq_len": 8, "learning_rate": 0.1, "batch_size": 2}
    cases = [whole, whole | {"n_heads": 5}, whole | {"n_heads": 0}, whole | {"learning_rate": 0.0, "vocab_size": -1}, whole | {"batch_size": None, "d_model": None}]
    table = spark.createDataFrame([(k, *c.values()) for k, c in enumerate(cases)], "k int, vocab_size int, d_model int, n_heads int, n_layers int, max_seq_len int, learning_rate double, batch_size int")
    told = {r.k: r.errors for r in table.select("k", recipes.config_errors_of(table).alias("errors")).collect()}
    assert told == {k: "; ".join(recipes.config_errors({n: v for n, v in c.items() if v is not None})) for k, c in enumerate(cases)} and told[0] == ""
    few = table.select("k", "d_model")
    assert few.select(recipes.config_errors_of(few).alias("e")).first().e.startswith("missing: vocab_size; missing: n_heads")


@pytest.mark.parametrize("most", [5, 10**6])
def test_first_rows_of_groups_by_radix(spark, most):
    """Against sorting: groups of any size (null too), keys that many rows share, rows that are alike."""
    rng = random.Random(19)
    rows = [(rng.choice([*range(300), None, 7, 7, 7]), rng.choice(["ko", "en", None, "x"]), rng.randrange(3), k % 5) for k in range(1500)] + [(7, "ko", 1, 1)] * 400 + [(9, "one", 0, 0)]
    frame = spark.createDataFrame(rows, "id long, language string, rank int, total int").repartition(4)
    for share in (0.001, 0.3, 1.0):
        marked = order.first_rows(frame, ["language"], order.shuffle_key(1, F.col("id")), 32, lambda total, every: F.floor(total * share), "__flag", most)
        got = marked.collect()
        assert Counter(tuple(r)[:4] for r in got) == Counter(rows)
        for g in ("ko", "en", None, "x", "one"):
            mine = [(hashlib.md5(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "0" * 32, r[4]) for r in got if r[1] == g]
            want = min(len(mine), int(len(mine) * share))
            assert sum(f for _, f in mine) == want
            assert max((k for k, f in mine if f), default="") <= min((k for k, f in mine if not f), default="g")


def test_order_keeps_columns_of_any_name(spark):
    names = ["rank", "total", "copy", "flag", "__flag", "__key", "__g0", "__g0_", "__last", "every", "need", "prefix", "n", "w", "__bucket", "__weight", "__copy", "last"]
    rows = [(k, "ko" if k % 3 else "en", *[k * 10 + j for j in range(len(names))]) for k in range(60)]
    frame = spark.createDataFrame(rows, "id long, language string, " + ", ".join(f"{c} long" for c in names))
    whole = {r[0]: r for r in rows}

    def same(out, more=()):
        assert out.columns == ["id", "language", *names, *more]
        got = out.collect()
        assert all(tuple(r)[: 2 + len(names)] == whole[r["id"]] for r in got)
        return len(got)

    assert same(order.mix_by_ratio(frame, "id", target=20)) == 14 + 6
    assert same(order.sample_exact(frame, ["language"], "id", F.when(F.col("language") == "ko", 5).otherwise(3))) == 8
    assert same(order.mix_prefix(frame, "id")) == 28 + 6
    assert same(order.mix_prefix(frame.withColumn("id", F.col("id").cast("double")), "id").withColumn("id", F.col("id").cast("long"))) == 28 + 6
    assert same(order.train_val_split(frame, "id"), ["split"]) == 60
    assert same(order.rank_shards(frame, "id", 8), ["shard"]) == 60
    assert same(order.batches(frame, "id", 25), ["batch"]) == 50
    assert same(order.head_per_source(frame, "language", "id", 4)) == 8
    merged = recipes.merge_weighted({"a": (frame, 2.5), "b": (frame, 0.5)})
    assert merged.columns == ["id", "language", *names, "source"] and merged.count() == 120
    after = order.following(frame, "id", "copy")
    assert after.columns == ["id", "language", *names, "next"] and after.where("next IS NULL").count() == 1


def test_ranks_of_a_key_that_many_rows_share(spark):
    frame = spark.range(500).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")).repartition(3)
    got = order.shuffled_rank(frame, "k", 3, "r", "t", most=10).collect()
    assert sorted(r["r"] for r in got) == list(range(1, 501)) and {r["t"] for r in got} == {500}
    keys = [hashlib.md5(f"3:{r['k']}".encode()).hexdigest() for r in sorted(got, key=lambda r: r["r"])]
    assert keys == sorted(keys)


def test_limits_read_leading_files_only(spark, tmp_path):
    """Of Parquet: a filter on the scan of the leading files, no sort and no exchange."""
    at = f"{tmp_path}/many"
    for part in range(6):
        spark.range(part * 100, part * 100 + 100, 1, 1).selectExpr("id AS `_rank`", "concat('row ', id) AS text").coalesce(1).write.parquet(f"{at}/p={part}")
    for limit in (0, 1, 100, 250, 600, 900):
        spec = specs.SourceSpec("s", path=at, format="parquet", limits={"full": limit})
        out = readers.read_source(spark, spec)
        assert {r.text for r in out.collect()} == {f"row {k}" for k in range(min(limit, 600))}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "TakeOrdered" not in plan and "Sort" not in plan
    assert len(readers.head_in_files(spark, "parquet", at, "text", 150).inputFiles()) == 2
    by_position = readers.read_source(spark, specs.SourceSpec("s", path=at, format="parquet", limits={"full": 7}), position="_rank")
    assert {r.text for r in by_position.collect()} == {f"row {k}" for k in range(7)}
    assert order.head(spark.range(9).selectExpr("cast(id AS string) AS p"), "p", 4).count() == 4


def test_deliveries_of_several_files(spark, tmp_path, monkeypatch):
    """One task wrote each delivery before, and a batch was one file."""
    from functools import partial

    from quern.plans import catalog

    data, made = "/root/testdata/sf0.001", catalog._deliveries
    before = [Counter(map(tuple, q(spark, data).collect())) for q in (catalog.stream_sessions, catalog.stream_restarted)]
    at, files = made(spark, data, 3, 20)
    assert files > 4
    rows = spark.read.parquet(at).select("event_id", "user_id", F.date_trunc("hour", "ts").alias("hour"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).collect()
    assert len({r.file for r in rows}) == 3 * files and len(rows) == spark.read.parquet(f"{data}/events.parquet").count()
    assert len({(r.event_id % 3, r.user_id, r.hour, r.file) for r in rows}) == len({(r.event_id % 3, r.user_id, r.hour) for r in rows})
    rows.sort(key=lambda r: (r.file, r.row))
    assert all(a.file != b.file or a.event_id < b.event_id for a, b in zip(rows, rows[1:]))
    monkeypatch.setattr(catalog, "_deliveries", partial(made, rows_a_file=50))
    assert [Counter(map(tuple, q(spark, data).collect())) for q in (catalog.stream_sessions, catalog.stream_restarted)] == before
    # buckets without a row: one file a delivery
    spark.range(40).selectExpr("id AS event_id", "timestamp'2024-01-01' AS ts", "1L AS user_id", "'a' AS event_type", "1D AS value").write.parquet(f"{tmp_path}/events.parquet")
    assert made(spark, str(tmp_path), 2, 5)[1] == 1


def test_delivered_documents_in_several_files(spark, tmp_path, monkeypatch):
    from quern.plans import catalog

    monkeypatch.setattr(catalog, "_new_folder", lambda s: f"{tmp_path}/in")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = catalog.source_stream_head(spark, "/root/testdata/sf0.001")
        docs = sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect(), key=lambda r: (r.doc_id % 4, r.doc_id))
        assert Counter(r.text for r in got.collect()) == Counter(t for r in docs[:120] if len(t := r.text.strip()) >= 100)
        assert len(list((tmp_path / "in").glob("part-*"))) > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_stream_stops_at_the_limit_and_goes_on(spark, tmp_path):
    for part in range(5):
        spark.range(part * 10, part * 10 + 10, 1, 1).selectExpr("concat('row ', id) AS text").write.mode("append").parquet(f"{tmp_path}/in")
    spec = specs.SourceSpec("s", path=f"{tmp_path}/in", format="parquet", limits={"full": 25, "small": None})
    out = readers.stream_head(spark, spec, "text string", f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(r.text for r in out.collect()) == sorted(f"row {k}" for k in range(25))
    assert len(list((tmp_path / "out" / "rows").glob("batch=*"))) == 3
    again = readers.stream_head(spark, spec, "text string", f"{tmp_path}/out", f"{tmp_path}/cp")
    assert again.count() == 25
    assert readers.stream_head(spark, spec, "text string", f"{tmp_path}/out2", f"{tmp_path}/cp2", mode="small").count() == 50


def test_a_failed_write_leaves_the_old_output(spark, tmp_path):
    at = f"{tmp_path}/out"
    assert sinks.write(spark.range(5), at) and not sinks.write(spark.range(7), at)
    fails = spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.write(fails, at, force=True)
    assert spark.read.parquet(at).count() == 5
    # an output may be made of what it replaces
    assert sinks.write(spark.read.parquet(at).unionByName(spark.range(3)), at, force=True)
    assert spark.read.parquet(at).count() == 8 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_json_array_is_read_in_splits(spark, tmp_path):
    """One task read a whole array before; arrays in any other layout still give the same rows."""
    import json

    at, schema = f"{tmp_path}/all.json", "k long, t string"
    rows = [(k, None if k % 5 == 0 else f'"q",\n[{k}] ]é 한') for k in range(20_000)]
    sinks.write_json_array(spark.createDataFrame(rows, schema).repartition(7), at, position="k")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        back = readers.json_array(spark, at, schema)
        assert back.rdd.getNumPartitions() > 4 and Counter(map(tuple, back.collect())) == Counter(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    some = [{"k": k, "t": t} for k, t in rows[:9]]
    for text in (json.dumps(some), json.dumps(some, indent=2), "[\n" + ",\n".join(map(json.dumps, some)) + "\n]", "[\n" + json.dumps(some)[1:-1] + "\n]\n", '[\n{"k": 0, "t":\nnull}\n' + "".join("," + json.dumps(x) + "\n" for x in some[1:]) + "]", "[]", "[\n]"):
        (tmp_path / "one.json").write_text(text)
        assert Counter(map(tuple, readers.json_array(spark, f"{tmp_path}/one.json", schema).collect())) == Counter(rows[:9] if len(text) > 5 else []), text
    for text in ('["a", "b,"]', '[\n"a",\n"b,"\n]', '[\n"a"\n,"b,"\n]'):
        (tmp_path / "one.json").write_text(text)
        assert sorted(r.text for r in readers.json_array(spark, f"{tmp_path}/one.json").collect()) == ["a", "b,"]


def test_json_array_is_one_valid_file_in_order(spark, tmp_path):
    import json

    at = f"{tmp_path}/all.json"
    rows = [(k, None if k % 5 == 0 else f'"q",\n[{k}] é 한') for k in range(200)]
    frame = spark.createDataFrame(rows, "k long, t string").repartition(7)
    assert sinks.write_json_array(frame, at, position="k") and not sinks.write_json_array(frame, at)
    text = (tmp_path / "all.json").read_text(encoding="utf-8")
    assert [(r["k"], r["t"]) for r in json.loads(text)] == rows
    assert Counter(map(tuple, readers.json_array(spark, at, "k long, t string").collect())) == Counter(rows)
    assert sinks.write_json_array(frame.where("false"), at, force=True) and json.loads((tmp_path / "all.json").read_text()) == []
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["all.json"]
