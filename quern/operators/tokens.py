"""Tokenizers and sequences of ids."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import HANGUL, strip, words

#: Fixed values.
GPT_SPLIT = r"'(?:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
PARTICLES = ("이", "가", "을", "를", "에", "에서", "으로", "로", "와", "과", "의", "도", "만", "부터", "까지", "처럼", "같이", "보다", "마다", "에게", "한테", "께", "께서", "라서", "니까", "때문에", "위해", "대해")
ENDINGS = ("습니다", "습니까", "세요", "십시오", "합니다", "했습니다", "하겠습니다", "입니다", "였습니다", "이었습니다", "해요", "해서", "하고", "하면", "하지만", "하거나", "하든지", "한다", "했다", "하자", "하라")
PUNCTUATION = r"[.!?,:;\"'()\[\]{}~\-_+=<>/@#$%^&*`|\\]"
SPLIT_PUNCTUATION = r"[.!?,:;\"'()\[\]{}]"
CHAR_PUNCTUATION = " .,!?:;-_()[]{}\"'"
BPE_SPECIALS = {"<pad>": 0, "<unk>": 1, "<bos>": 2, "<eos>": 3}
PAD, LABEL_IGNORED = 0, -100

# ---------------------------------------------------------------------- native


def punctuation_tokens(t: Column) -> Column:
    """Whitespace tokens; sentence punctuation stands alone."""
    return words(F.regexp_replace(t, f"({SPLIT_PUNCTUATION})", " $1 "))


def stable_id(token: Column, modulus: int = 65535, first: int = 1) -> Column:
    """An id for any token, the same on every machine."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % modulus + first


def hash_ids(t: Column, modulus: int = 65535, first: int = 1) -> Column:
    return F.transform(words(t), lambda w: stable_id(w, modulus, first))


def pad(ids: Column, length: int, value: int = PAD) -> Column:
    """Cut or filled up to length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(value).cast("long"), length)), 1, length)


def mask(ids: Column, length: int) -> Column:
    """1 for each id, 0 for the filling."""
    n = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), length - n))


def labels(ids: Column, pad_id: int = PAD) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad_id, LABEL_IGNORED).otherwise(x))


def chunks(df: DataFrame, ids: str, size: int, stride: int) -> DataFrame:
    """start and chunk: windows of just that size; shorter rows and tails give none."""
    enough = df.where(F.size(ids) >= size)
    starts = F.explode(F.sequence(F.lit(0), F.size(ids) - size, F.lit(stride)))
    return enough.withColumn("start", starts).withColumn("chunk", F.slice(ids, F.col("start") + 1, size))


def batch_pad(df: DataFrame, ids: str, batch: str, cap: int) -> DataFrame:
    """Filled up to the longest of its batch, at most cap; with the mask."""
    longest = df.groupBy(batch).agg(F.least(F.max(F.size(ids)), F.lit(cap)).alias("__to"))
    joined = df.join(longest, batch)
    n = F.least(F.size(ids), F.col("__to"))
    full = F.concat(F.slice(F.col(ids), 1, n), F.array_repeat(F.lit(PAD).cast("long"), F.col("__to") - n))
    return joined.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.col("__to") - n))).withColumn(ids, full).drop("__to")


def char_ids(t: Column) -> Column:
    """Ids of a fixed character vocabulary: 4 specials (pad 0, unknown 1), the Hangul
    syllables, a-z, A-Z, 0-9 and some punctuation, by rule instead of a table."""
    hangul, latin = 4, 4 + 11172
    code = lambda c: F.ascii(c)
    marks = F.lit(CHAR_PUNCTUATION)
    one = lambda c: (
        F.when(code(c).between(0xAC00, 0xD7A3), code(c) - 0xAC00 + hangul)
        .when(code(c).between(97, 122), code(c) - 97 + latin)
        .when(code(c).between(65, 90), code(c) - 65 + latin + 26)
        .when(code(c).between(48, 57), code(c) - 48 + latin + 52)
        .when(F.instr(marks, c) > 0, F.instr(marks, c) - 1 + latin + 62)
        .otherwise(1)
    )
    return F.transform(F.array_remove(F.split(t, ""), ""), one)


def decode_spacing(t: Column) -> Column:
    """A space where Latin letters and Hangul meet."""
    return F.regexp_replace(F.regexp_replace(t, f"([a-zA-Z])({HANGUL})", "$1 $2"), f"({HANGUL})([a-zA-Z])", "$1 $2")


def pre_tokens(t: Column) -> Column:
    """The pieces that byte-pair merges stay within; blank ones left out."""
    return F.filter(F.regexp_extract_all(t, F.lit(GPT_SPLIT), F.lit(0)), lambda x: F.length(strip(x)) > 0)


def _suffix(parts: tuple[str, ...]) -> str:
    return "|".join(sorted(parts, key=lambda p: (-len(p), p)))


def morphemes(t: Column) -> Column:
    """Punctuation marks, numbers, lower-cased Latin runs, and other words with one
    particle, or else one ending, split off."""
    other = r"[^\s" + PUNCTUATION[1:-1] + "]+"
    raw = F.regexp_extract_all(t, F.lit(f"{PUNCTUATION}|(?U)\\d+|[a-zA-Z]+|{other}"), F.lit(0))

    def split(w: Column) -> Column:
        particle = F.regexp_extract(w, f"^.+?({_suffix(PARTICLES)})$", 1)
        ending = F.regexp_extract(w, f"^.+?({_suffix(ENDINGS)})$", 1)
        tail = F.when(particle != "", particle).otherwise(ending)
        first = F.ascii(w)  # only a Latin run begins in a Latin letter
        latin, hangul = first.between(65, 90) | first.between(97, 122), F.right(w, F.lit(1)).between("가", "힣")
        # all tails end in Hangul; the patterns are for such words alone
        return F.when(latin, F.array(F.lower(w))).when(~hangul, F.array(w)).when(tail == "", F.array(w)).otherwise(F.array(F.substring(w, F.lit(1), F.length(w) - F.length(tail)), tail))

    return F.flatten(F.transform(raw, split))


# ---------------------------------------------------------------------- counts


def word_counts(df: DataFrame, tokens: Column) -> DataFrame:
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))


def vocabulary(counts: DataFrame, size: int, first_id: int, reserve: int = 100) -> DataFrame:
    """token, id: most frequent first, ties by token, up to size - reserve ids.  The
    cut is a bounded top-k, so only that many rows meet in one task."""
    from pyspark.sql import Window

    top = counts.where(F.length(strip(F.col("token"))) > 0).orderBy(F.desc("freq"), "token").limit(size - reserve - first_id)
    return top.select("token", "freq", (F.row_number().over(Window.orderBy(F.desc("freq"), "token")) - 1 + first_id).alias("id"))


def pair_counts(counts: DataFrame) -> DataFrame:
    """a, b, freq of neighbouring characters, weighted by the words' frequency."""
    spelled = counts.select("freq", F.split("token", "").alias("c")).select("freq", F.filter("c", lambda x: x != "").alias("c")).where(F.size("c") > 1)
    pairs = F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b")))
    return spelled.select("freq", pairs.alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("freq").alias("freq"))


def alphabet(counts: DataFrame) -> DataFrame:
    return counts.select(F.explode(F.split("token", "")).alias("char")).where("char != ''").distinct()


def coverage(df: DataFrame, tokens: Column, vocab: DataFrame) -> DataFrame:
    """total, covered and ratio of the token occurrences that the vocabulary has."""
    counts = word_counts(df, tokens)
    known = counts.join(vocab.select("token", F.lit(True).alias("known")), "token", "left")
    total, covered = F.coalesce(F.sum("freq"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("known"), F.col("freq"))), F.lit(0))
    return known.agg(total.alias("total"), covered.alias("covered"), F.round(F.coalesce(F.try_divide(covered, total), F.lit(0.0)), 6).alias("ratio"))


def uncovered(df: DataFrame, tokens: Column, vocab: DataFrame) -> DataFrame:
    """token, freq of the tokens that the vocabulary doesn't have."""
    return word_counts(df, tokens).join(vocab.select("token"), "token", "left_anti")


def most_frequent_pair(pairs: DataFrame) -> DataFrame:
    """The pair that is merged next: the most frequent, of equals the last by name."""
    return pairs.agg(F.max(F.struct("freq", "a", "b")).alias("p")).select("p.a", "p.b", "p.freq")


# ------------------------------------------------------------------ Arrow UDFs


@F.pandas_udf(StringType())
def nfd(texts):
    """Decomposed characters, space runs as one, none at the ends."""
    return texts.map(lambda t: None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFD", t)).strip())


def morpheme_join(tokens: Column) -> Column:
    """Particles and endings glued to the word before, punctuation to what precedes.

    Tokens hold no white space, so all of them are one string with line breaks between;
    a tab then opens a word that has taken its tail, and such a word starts anew even if
    it is a mark."""
    joined = F.array_join(tokens, "\n")
    tailed = F.regexp_replace(joined, rf"(?<![^\n])([^\n]+)\n({_suffix((*PARTICLES, *ENDINGS))})(?![^\n])", "\t$1$2")
    marked = F.regexp_replace(tailed, rf"\n(?={PUNCTUATION})", "")
    return F.translate(F.regexp_replace(marked, r"\t", ""), "\n", " ")


class _Parts(dict):
    """word -> its parts, each word split once; of a bounded size."""

    starts = re.compile(HANGUL)

    def __init__(self, vocab: frozenset[str], made):
        super().__init__()
        self.vocab, self.made = vocab, made

    def __missing__(self, word: str):
        if len(self) > 200_000:
            self.clear()
        self[word] = out = self.made(self.split(word))
        return out

    def split(self, word: str) -> list[str]:
        vocab = self.vocab
        if word in vocab or len(word) <= 2:
            return [word]
        sizes = (3, 2) if self.starts.match(word) else range(6, 0, -1)
        out, i = [], 0
        while i < len(word):
            size = next((n for n in sizes if i + n <= len(word) and word[i : i + n] in vocab), 1)
            out.append(word[i : i + size])
            i += size
        return out


#: Rows that a UDF holds at once as Python objects.
_ROWS = 250


def subwords(tokens: Column, vocab: set[str]) -> Column:
    """Tokens outside of the vocabulary in parts: two characters or fewer stay; words
    that begin in Hangul by known runs of 3 or 2 syllables, else single ones; other
    words by their longest known prefixes of up to 6 characters."""
    shared = SparkSession.active().sparkContext.broadcast(frozenset(vocab))  # a vocabulary has a size set by its maker
    kept: dict = {}

    @F.arrow_udf("array<string>")
    def split(rows: pa.Array) -> pa.Array:
        parts = kept.setdefault("parts", _Parts(shared.value, tuple))
        some = ([None if row is None else [p for w in row for p in parts[w]] for row in rows.slice(k, _ROWS).to_pylist()] for k in range(0, max(1, len(rows)), _ROWS))
        return pa.concat_arrays([pa.array(x, pa.list_(pa.string())) for x in some])

    return split(tokens)


def subword_text(t: Column, vocab: set[str]) -> Column:
    """The parts of all punctuation tokens of a text as one line, a blank between two: as subwords() has them, but
    texts alone go to Python and back, not arrays of words."""
    shared = SparkSession.active().sparkContext.broadcast(frozenset(vocab))
    kept: dict = {}

    @F.arrow_udf("string")
    def split(texts: pa.Array) -> pa.Array:
        parts = kept.setdefault("parts", _Parts(shared.value, " ".join))
        some = ([None if x is None else " ".join([parts[w] for w in x.split()]) for x in texts.slice(k, _ROWS).to_pylist()] for k in range(0, max(1, len(texts)), _ROWS))
        return pa.concat_arrays([pa.array(x, pa.string()) for x in some])

    return split(F.regexp_replace(t, f"({SPLIT_PUNCTUATION})", " $1 "))


# ------------------------------------------------- encoders with specials, choice

#: Ids of the specials of the word-level encoders.
SPECIAL_IDS = {"<pad>": 0, "<s>": 1, "</s>": 2, "<unk>": 3}


def _framed(ids: Column, max_length: int | None) -> Column:
    """Begin and end marks around; a cut may take the end mark."""
    out = F.concat(F.array(F.lit(1).cast("long")), ids, F.array(F.lit(2).cast("long")))
    return F.slice(out, 1, max_length) if max_length else out


def hash_encode(t: Column, max_length: int | None = None) -> Column:
    """Whitespace tokens by their stable ids; specials in the text keep theirs."""
    special = F.create_map(*[F.lit(x) for k, v in SPECIAL_IDS.items() for x in (k, v)])
    one = lambda w: F.coalesce(F.try_element_at(special, w).cast("long"), stable_id(w))
    return _framed(F.transform(words(t), one), max_length)


def hash_decode(ids: Column, known: dict[int, str] | None = None, guessed: dict[int, str] | None = None) -> Column:
    """Known words (guessed ones marked *), other ids as [id]; specials left out but
    [UNK].  An id is not unique to a word, so this is for reading only."""
    table = {**{k: f"{v}*" for k, v in (guessed or {}).items()}, **(known or {}), 0: "", 1: "", 2: "", 3: "[UNK]"}
    names = F.create_map(*[x for k, v in table.items() for x in (F.lit(k).cast("long"), F.lit(v))])
    shown = F.transform(ids, lambda x: F.coalesce(F.try_element_at(names, x.cast("long")), F.concat(F.lit("["), x.cast("string"), F.lit("]"))))
    return F.array_join(F.filter(shown, lambda w: w != ""), " ")


def vocabulary_map(vocab: dict[str, int]) -> Column:
    """A vocabulary of a bounded size as a constant map."""
    return F.create_map(*[x for k, v in vocab.items() for x in (F.lit(k), F.lit(v).cast("long"))])


def morpheme_vocabulary(extra: tuple[str, ...] = ()) -> dict[str, int]:
    """Specials, the words given, particles and endings, numbered in that order."""
    return {**SPECIAL_IDS, **{w: k + 4 for k, w in enumerate(dict.fromkeys((*extra, *PARTICLES, *ENDINGS)))}}


def morpheme_encode(t: Column, vocab: dict[str, int] | None = None, max_length: int | None = None, size: int = 65536) -> Column:
    """Morphemes by vocabulary id, others by a stable id from 1,000 on."""
    vocab = vocab or morpheme_vocabulary()
    known, firsts = vocabulary_map(vocab), sorted({k[:1] for k in vocab})
    # a map is searched entry by entry, so only for words that begin as one of its own
    found = lambda w: F.when(F.left(w, F.lit(1)).isin(firsts), F.try_element_at(known, w))
    one = lambda w: F.coalesce(found(w), stable_id(w, size - 1000, 1000))
    return _framed(F.transform(morphemes(t), one), max_length)


def pretrained_encode(t: Column, path: str) -> Column:
    """Ids by a vocabulary file of the tokenizers or sentencepiece library; a file is
    opened once in each Python worker."""

    @F.pandas_udf("array<int>")
    def encode(texts):
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            return texts.map(lambda x: None if x is None else model.encode(x, num_threads=1))
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        return texts.map(lambda x: None if x is None else model.encode(x, add_special_tokens=False).ids)

    return encode(t)


def choose(kind: str, path: str | None = None):
    """(the kind used, text column -> ids column): korean, improved_korean or
    pretrained; an unknown kind, or a pretrained one without a readable file, falls
    back to korean."""
    import os

    if kind == "pretrained" and path and os.path.exists(path):
        return kind, lambda t: pretrained_encode(t, path)
    if kind == "improved_korean":
        return kind, lambda t: _framed(F.transform(punctuation_tokens(t), lambda w: stable_id(w)), None)
    return "korean", morpheme_encode
