"""Factorization machines over hashed words and structure statistics.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if u_i)^2 - sum_i v_if^2 u_i^2]),
u = x / |x|, so all pairwise interactions cost time in proportion to the features
present, and a text of many terms has no larger sum of pairs than a short one.

Words, and where asked the first bytes of words (stems), are hashed into buckets; a
bucket's value is 1 / sqrt(buckets present), or log2(1 + its count) where single
terms matter.  Structure statistics are counts and ratios of the whole text, cut into
fixed intervals, one feature each.  Every feature of the training rows has a weight
and factors; none is chosen beforehand.  Weights are learned with an L1 penalty
(follow the regularised leader), factors by AdaGrad with decay.

Training labels come from a bounded sample of labelled rows (`sample` rows and
`sample_bytes` of text, parameters); every row is scored, whole text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesnp import ALNUM_FOLDED, SPACE_FOLDED, U64, flat, pieces, stems, words


class Settings(NamedTuple):
    buckets: int = 1 << 15  # of hashed words
    factors: int = 4
    counted: bool = False  # value log2(1 + count) for each bucket present, else 1 / sqrt(present)
    stems: tuple[int, ...] = ()  # bytes of the stems that are terms besides the words
    sample: int = 8_000  # labelled rows to learn from, at most
    sample_bytes: int = 64 << 20  # of their texts, at most (the first row is taken anyway)
    epochs: int = 10
    least_steps: int = 400  # few rows get more epochs, up to 60
    batch: int = 256
    sparse: float = 0.1  # L1 penalty in deviations of a sum over all rows under the share of label 1
    rate: float = 0.3  # of the weights
    factor_rate: float = 0.5
    factor_decay: float = 0.05
    seed: int = 7


# ------------------------------------------------------------------ features

#: Interval bounds of each structure statistic; a statistic of k bounds has k + 1 features.
_EDGES = {
    "n_words": [5, 10, 20, 50, 100, 300, 1000, 3000],
    "n_chars": [30, 60, 120, 400, 1500, 6000, 20000],
    "word_length": [2.5, 3.5, 4.5, 5.5, 6.5, 8, 12],
    "symbols_per_word": [0.005, 0.02, 0.1, 0.3, 0.8, 1.5],
    "exclamations_per_word": [0.01, 0.05, 0.2, 0.6, 1.2],
    "capitals": [0.01, 0.03, 0.06, 0.12, 0.25, 0.5],
    "digits": [0.005, 0.02, 0.08, 0.2],
    "words_like_previous": [0.005, 0.02, 0.1, 0.3, 0.6],
    "distinct_words": [0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95],
    "words_per_line": [2, 4, 8, 16, 40, 120],
    "bars_per_word": [0.01, 0.1, 0.3, 0.6],
    "punctuation_per_word": [0.02, 0.06, 0.1, 0.15, 0.3, 1.0],
}
_OFFSETS = dict(zip(_EDGES, np.concatenate([[0], np.cumsum([len(e) + 1 for e in _EDGES.values()])])))
N_STRUCTURE = sum(len(e) + 1 for e in _EDGES.values())


#: Kinds of bytes, none in two of them; "tail" are the bytes that continue a character.
_KINDS = {
    "symbol": b"#*$%&<>", "bar": b"|", "bang": b"!", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)),
    "digit": b"0123456789", "line": b"\n", "stop": b".,;:?", "tail": bytes(range(0x80, 0xC0)),
}
_KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate(_KINDS.values(), 1):
    _KIND[list(_chars)] = _k


def _kinds(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """How many bytes of each kind each document has."""
    n, width = len(offsets) - 1, len(_KINDS) + 1
    row = np.repeat(np.arange(n) * width, np.diff(offsets))
    counts = np.bincount(row + _KIND[raw], minlength=n * width).reshape(n, width)
    return dict(zip(_KINDS, counts[:, 1:].T))


def features(texts: pa.Array, settings: Settings, structure: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row offsets, feature index, value) of all texts: structure features first,
    then word buckets."""
    raw, offsets = flat(texts)
    n = len(offsets) - 1
    w = words(raw, offsets, ALNUM_FOLDED)
    terms = [(w.doc, w.hash), *stems(raw, w, ALNUM_FOLDED, settings.stems)]
    keys = [d.astype(U64) * U64(settings.buckets) + ((h + U64(k)) >> U64(8)) % U64(settings.buckets) for k, (d, h) in enumerate(terms)]
    key, times = np.unique(np.concatenate(keys), return_counts=True)
    doc, bucket = (key // U64(settings.buckets)).astype(np.int64), (key % U64(settings.buckets)).astype(np.int64)
    present = np.bincount(doc, minlength=n)
    value = np.log2(1 + times).astype(np.float32) if settings.counted else (1 / np.sqrt(np.maximum(present, 1)))[doc].astype(np.float32)
    if not structure:
        return np.concatenate([[0], np.cumsum(present)]), bucket, value

    sums = _kinds(raw, offsets)
    s = words(raw, offsets, SPACE_FOLDED)
    n_words = np.diff(s.first).astype(float)
    like = np.zeros(len(s.hash), np.int64)
    if len(like):
        like[1:] = (s.hash[1:] == s.hash[:-1]) & (s.doc[1:] == s.doc[:-1])
    one = np.maximum(n_words, 1)
    distinct = np.bincount(np.unique(s.doc.astype(U64) << U64(40) | s.hash >> U64(24)).astype(U64).__rshift__(U64(40)).astype(np.int64), minlength=n)
    stats = {
        "n_words": n_words,
        "n_chars": np.diff(offsets) - sums["tail"],
        "word_length": _per_doc_words(s.end - s.start, s.first) / one,
        "symbols_per_word": (sums["symbol"] + sums["bar"]) / one,
        "exclamations_per_word": sums["bang"] / one,
        "capitals": sums["upper"] / np.maximum(sums["upper"] + sums["lower"], 1),
        "digits": sums["digit"] / np.maximum(np.diff(offsets), 1),
        "words_like_previous": _per_doc_words(like, s.first) / one,
        "distinct_words": distinct / one,
        "words_per_line": n_words / (sums["line"] + 1),
        "bars_per_word": sums["bar"] / one,
        "punctuation_per_word": sums["stop"] / one,
    }
    which = np.stack([_OFFSETS[k] + np.searchsorted(_EDGES[k], v, "right") for k, v in stats.items()], axis=1)
    k = which.shape[1]
    start = np.concatenate([[0], np.cumsum(present + k)])
    index, out = np.empty(start[-1], np.int64), np.empty(start[-1], np.float32)
    at = (start[:-1, None] + np.arange(k)).ravel()
    index[at], out[at] = which.ravel(), 1.0
    rest = np.arange(len(doc)) + (doc + 1) * k
    index[rest], out[rest] = bucket + N_STRUCTURE, value
    return start, index, out


def _per_doc_words(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(value)])
    return (total[first[1:]] - total[first[:-1]]).astype(float)


# --------------------------------------------------------------------- model


class Model(NamedTuple):
    bias: float
    weights: np.ndarray  # of each feature
    factors: np.ndarray  # features x factors
    settings: Settings
    structure: bool

    def logits(self, start: np.ndarray, index: np.ndarray, value: np.ndarray, paired: np.ndarray | None = None) -> np.ndarray:
        """paired: the values that the pairs take, where they are others."""

        def by_row(x):
            total = np.zeros((len(x) + 1, *x.shape[1:]))
            np.cumsum(x, axis=0, out=total[1:])
            return total[start[1:]] - total[start[:-1]]

        vu = self.factors[index] * (value if paired is None else paired)[:, None]
        pairs = (by_row(vu) ** 2 - by_row(vu * vu)).sum(axis=1) / 2
        return self.bias + by_row(self.weights[index] * value) + pairs

    def scores(self, texts: pa.Array) -> np.ndarray:
        start, index, value = features(texts, self.settings, self.structure)
        return 1 / (1 + np.exp(-np.clip(self.logits(start, index, value, _unit(start, value)), -30, 30)))


def _unit(start: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Values over the length of their row."""
    total = np.concatenate([[0.0], np.cumsum(value.astype(float) ** 2)])
    length = np.sqrt(np.maximum(total[start[1:]] - total[start[:-1]], 1e-12))
    return value / np.repeat(length, np.diff(start))


def fit(start: np.ndarray, index: np.ndarray, value: np.ndarray, label: np.ndarray, settings: Settings, structure: bool) -> Model:
    """Logistic loss in small batches.  Without rows or with one class only, the model
    is the (smoothed) share of label 1; features of no training row have no effect."""
    size, n, k = settings.buckets + (N_STRUCTURE if structure else 0), len(label), settings.factors
    share = (label.sum() + 1) / (n + 2)
    bias = float(np.log(share / (1 - share)))
    seen, index = np.unique(index, return_inverse=True)
    unit = _unit(start, value)
    rng = np.random.default_rng(settings.seed)
    w, lead, power = (np.zeros(len(seen)) for _ in range(3))
    v, v_power = rng.normal(0, 0.05, (k, len(seen))), np.zeros((k, len(seen)))
    penalty = settings.sparse * np.sqrt(n * share * (1 - share))
    epochs = max(settings.epochs, min(60, settings.least_steps * settings.batch // max(n, 1)))
    for epoch in range(epochs if 0 < label.sum() < n else 0):
        order = rng.permutation(n)
        rate = settings.factor_rate * (1 - epoch / epochs)
        for rows in (order[a : a + settings.batch] for a in range(0, n, settings.batch)):
            lengths = start[rows + 1] - start[rows]
            at = np.repeat(start[rows] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            of, i = np.repeat(np.arange(len(rows)), lengths), index[at]
            vu = v[:, i] * unit[at]
            sums = np.array([np.bincount(of, x, len(rows)) for x in vu]).reshape(k, len(rows))
            squares = np.bincount(of, (vu * vu).sum(axis=0), len(rows))
            logit = bias + np.bincount(of, w[i] * value[at], len(rows)) + ((sums**2).sum(axis=0) - squares) / 2
            error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label[rows]
            g = np.bincount(i, error[of] * value[at], len(seen))
            lead += g - (np.sqrt(power + g * g) - np.sqrt(power)) / settings.rate * w
            power += g * g
            w = np.where(np.abs(lead) <= penalty, 0, (np.sign(lead) * penalty - lead) * settings.rate / (1 + np.sqrt(power)))
            scaled = error[of] * unit[at]
            for f in range(k):
                slope = np.bincount(i, scaled * (sums[f, of] - vu[f]), len(seen))
                slope += settings.factor_decay * v[f] * (slope != 0)
                v_power[f] += slope * slope
                v[f] -= rate * slope / (1 + np.sqrt(v_power[f]))
            bias -= 0.05 * float(error.mean())
    weights, factors = np.zeros(size, np.float32), np.zeros((size, k), np.float32)
    if 0 < label.sum() < n:
        weights[seen], factors[seen] = w, v.T
    return Model(bias, weights, factors, settings, structure)


# --------------------------------------------------------------------- Spark


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the doc_id as text is divisible by 5 teach nothing; nor
    do rows without a doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _whole_keys(keys: list, sizes: list[int], settings: Settings) -> int:
    """How many of the ordered rows are within the bounds, cut between different keys."""
    end, total = 0, 0
    for k, size in enumerate(sizes):
        if k and (total + size > settings.sample_bytes or k >= settings.sample):
            return end or k
        total += size
        if k + 1 == len(keys) or keys[k + 1] != keys[k]:
            end = k + 1
    return end


def learn(docs: DataFrame, labels: DataFrame, label: str, settings: Settings, *, structure: bool, text: str = "text", doc_id: str = "doc_id") -> Model:
    """Fits on labelled rows that are not held out, drawn by a hash of their id, as
    many as the settings' bounds allow; the same rows however docs is partitioned.

    Rows without label or id teach nothing, nor do labels without a row; several
    labels of one id count by their mean; several rows of one id all count, in order of
    a hash of their text, and rows of one id and text count all or not at all (unless they
    alone exceed the bounds); null and empty texts
    have no words.  Without usable rows, or with a single class, the model is a
    constant.  Ids may have any type that joins; other columns are not read."""
    usable = labels.where(F.col(label).isNotNull() & ~held_out(F.col(doc_id)))
    place = F.xxhash64("id", F.lit(settings.seed))
    drawn = (
        usable.groupBy(F.col(doc_id).alias("id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
        .orderBy(place, "id").limit(settings.sample).select("id", "label", place.alias("place"))
    )
    # at most settings.sample rows of three numbers: a proven size
    marked = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(drawn), "id").select("place", F.xxhash64("text").alias("which"), "label", "text")

    # three numbers a row: which rows come first until a bound is reached
    ordered = marked.select("place", "which", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy("place", "which", "size").limit(settings.sample + 1).collect()
    taken = _whole_keys([(r["place"], r["which"]) for r in ordered], [r["size"] for r in ordered], settings)
    if not taken:
        return fit(np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0), settings, structure)
    last = ordered[taken - 1]

    def rows(batches):
        for batch in pieces(batches, "text"):
            start, index, value = features(batch.column("text"), settings, structure)
            lists = [pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(x)) for x in (index.astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("place", "which", "label")], *lists], names=["place", "which", "label", "index", "value"])

    inside = marked.where((F.col("place") < last["place"]) | ((F.col("place") == last["place"]) & (F.col("which") <= last["which"])))
    found = inside.mapInArrow(rows, "place long, which long, label int, index array<int>, value array<float>")
    table = found.limit(taken).toArrow().sort_by([("place", "ascending"), ("which", "ascending")]).combine_chunks()
    columns = {c: table.column(c).combine_chunks() for c in ("index", "value")}
    start = np.asarray(columns["index"].offsets).astype(np.int64)
    flat_index, flat_value = (np.asarray(columns[c].values)[start[0] : start[-1]] for c in ("index", "value"))
    return fit(start - start[0], flat_index, flat_value, np.asarray(table.column("label")).astype(float), settings, structure)


def scored(docs: DataFrame, model: Model, *, text: str = "text", into: str = "score") -> DataFrame:
    """Every row of docs with its score in 0 to 1; null text scores as empty.  The
    model (a few megabytes, set by its settings) goes to each executor once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    schema = f"row {source.schema['row'].dataType.simpleString()}, {into} double"

    def rows(batches):
        for batch in pieces(batches, "text"):
            found = shared.value.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found)], names=["row", into])

    return source.mapInArrow(rows, schema).select(*[F.col("row")[c].alias(c) for c in docs.columns if c != into], into)
