"""Benchmark decontamination by spaced-seed hashing.

Masks pick some tokens of a window and ignore the others, so a window still hits
when ignored tokens were substituted.  An item gets a family of masks of which at
least one fits every overlap that the law accepts, so no lawful overlap is missed.
The masked windows of all benchmark items form a table of seeds; documents look up
theirs.  Around each hit the item is laid over the document at that offset; chance
hits go by the number of equal tokens there, and a hit counts if any stretch there meets the
law: enough tokens, at least four fifths equal.  Reported is the best-scoring stretch
(a match +1, a substitution -2) or, where that one falls short, the lawful one with the
most matches.

Hits on one diagonal are one: only those whose windows before differ on the two
sides are listed, so a word that fills a document and an item gives a hit for each
diagonal, not for each pair of places.  Diagonals of a pair behind a full match of the
item can't be better and are left out.

The benchmark side, each different text once, is processed in blocks of bounded size,
one block after the other, each sent to the executors once; a benchmark of any size
takes more passes, never more memory.  Documents are not shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesnp import ALNUM_FOLDED, U64, Words, flat, mix, pieces, words
from .common import Table, text_names, text_or_empty

#: No mask has more tokens that count; so many hits or tokens are held at a
#: time.
HEAVIEST, AT_ONCE = 5, 1 << 20


def _misses(family: tuple[str, ...], longest: int, need: int, part: Fraction) -> bool:
    """Is there a lawful stretch of up to `longest` tokens that no mask of the family fits?

    Of the stretches that none fits so far only the most matches for each way to end are kept."""
    tail = max(map(len, family)) - 1
    most = {"": 0}
    for size in range(1, longest + 1):
        following: dict[str, int] = {}
        for end, matches in most.items():
            for token in "01":
                seen = end + token
                if any(len(seen) >= len(m) and all(t >= c for t, c in zip(seen[-len(m) :], m)) for m in family):
                    continue
                kept = seen[max(0, len(seen) - tail) :]
                following[kept] = max(following.get(kept, 0), matches + int(token))
        most = following
        if max(most.values(), default=-1) >= max(need, part * size):
            return True
    return False


@lru_cache(1 << 10)
def _family(longest: int, need: int, part: Fraction) -> tuple[str, ...]:
    for weight in range(HEAVIEST, 1, -1):
        family = tuple("1" * k + "0" + "1" * (weight - k) for k in range(1, weight))
        if not _misses(family, longest, need, part):
            for mask in family:
                fewer = tuple(m for m in family if m != mask)
                if fewer and not _misses(fewer, longest, need, part):
                    family = fewer
            return family
    # stretches of one or two tokens have no place to ignore
    return ("11",) if not _misses(("11",), longest, need, part) else ("1",)


@lru_cache(1 << 14)
def masks(tokens: int, least_tokens: int = 13, share: float = 0.8, least_item: int = 5) -> tuple[str, ...]:
    """Masks (1: the token counts, 0: it is ignored) of which one fits every lawful stretch
    of an item: the heaviest family that does, of masks with an ignored place inside.

    A lawful stretch of twice the length that the least matches need, or more, can be cut in
    two such that one part is lawful, so only shorter ones are looked at."""
    if tokens < max(1, least_item):
        return ()
    part = Fraction(str(share)).limit_denominator(10_000)
    need = max(1, math.ceil(part * min(least_tokens, tokens)))
    return _family(min(tokens, 2 * math.ceil(need / part)), need, part)


def _masked(hashes: np.ndarray, doc: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, seeds) of all windows under one mask that lie in one document."""
    size = len(hashes) - len(mask) + 1
    if size <= 0:
        return np.empty(0, np.int64), np.empty(0, U64)
    factor = mix(np.arange(len(mask), dtype=U64) * U64(64) + U64(number + 1)) | U64(1)
    seed = np.full(size, U64(number))
    for k, used in enumerate(mask):
        if used == "1":
            seed += hashes[k : k + size] * factor[k]
    whole = doc[:size] == doc[len(mask) - 1 :]
    return np.flatnonzero(whole), mix(seed[whole])


class _Seeds:
    """The seeds of one block of items: sorted by seed and the seed one place before,
    with a bit table in front."""

    def __init__(self, texts: list[str], least_tokens: int = 13, share: float = 0.8, least_item: int = 5, names: tuple = ((), ())):
        raw, offsets = flat(pa.array(texts, pa.string()))
        w = words(raw, offsets, ALNUM_FOLDED)
        self.hash, self.first, self.size, self.names = w.hash, w.first, np.diff(w.first), [np.array(n, np.int64) for n in names]
        self.least = share * np.minimum(least_tokens, self.size)
        own = [masks(n, least_tokens, share, least_item) for n in self.size.tolist()]
        self.masks = sorted({m for ms in own for m in ms})
        found = [(np.empty(0, U64), np.empty(0, U64), np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.int64))]
        for number, mask in enumerate(self.masks):
            at, seed = _masked(w.hash, w.doc, mask, number)
            mine = np.array([mask in ms for ms in own])[w.doc[at]]
            at, seed = at[mine], seed[mine]
            has, before = _before(at, seed, w.doc[at])
            found.append((seed, before, has, w.doc[at], at - w.first[w.doc[at]]))
        seed, before, has, self.item, self.place = (np.concatenate(x) for x in zip(*found))
        self.known, rank = np.unique(seed, return_inverse=True)
        # 0: no window before in the item
        pair = rank * (len(self.known) + 1) + np.where(has, np.searchsorted(self.known, before) + 1, 0)
        order = np.argsort(pair, kind="stable")
        self.pair, self.item, self.place = pair[order], self.item[order], self.place[order]
        self.bounds = np.searchsorted(rank[order], np.arange(len(self.known) + 1))
        self.bits = max(16, (16 * max(1, len(self.known)) - 1).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(self.known >> U64(64 - self.bits)).astype(np.int64)] = True

    def _rank(self, seed: np.ndarray) -> np.ndarray:
        """The number of each seed among the known ones, or -1."""
        at = np.minimum(np.searchsorted(self.known, seed), len(self.known) - 1)
        return np.where(self.known[at] == seed, at, -1)

    def hits(self, w: Words, mask: str, number: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pair, diagonal) of equal seeds, some at a time, in order of their place; of
        equal seeds one behind the other on a diagonal the first.  A pair's number is
        its document times the items plus its item."""
        at, seed = _masked(w.hash, w.doc, mask, number)
        has, before = _before(at, seed, w.doc[at])
        near = np.flatnonzero(self.table[(seed >> U64(64 - self.bits)).astype(np.int64)])
        if not len(near) or not len(self.known):
            return
        rank = self._rank(seed[near])
        near, rank = near[rank >= 0], rank[rank >= 0]
        low, high = self.bounds[rank], self.bounds[rank + 1]
        earlier = np.where(has[near], self._rank(before[near]), -1)
        pair = rank * (len(self.known) + 1) + earlier + 1
        follows = earlier >= 0
        skip = np.where(follows, np.searchsorted(self.pair, pair, "left"), low)
        skip_to = np.where(follows, np.searchsorted(self.pair, pair, "right"), low)
        at, doc = at[near], w.doc[at[near]]
        for part in _slices(skip - low + high - skip_to):
            which = np.concatenate([_ranges(low[part], skip[part]), _ranges(skip_to[part], high[part])])
            of = np.concatenate([np.repeat(np.arange(part.start, part.stop), n) for n in (skip[part] - low[part], high[part] - skip_to[part])])
            yield doc[of] * len(self.size) + self.item[which], at[of] - self.place[which]

    def stretches(self, w: Words, pair: np.ndarray, diagonal: np.ndarray, share: float) -> Iterator[np.ndarray]:
        """(document, item, matches, - first word, first word, first token of the item,
        tokens) of the pairs and diagonals with a lawful stretch."""
        doc, item = pair // len(self.size), pair % len(self.size)
        low, high = np.maximum(diagonal, w.first[doc]), np.minimum(diagonal + self.size[item], w.first[doc + 1])
        for part in _slices(high - low):
            size, at = high[part] - low[part], _ranges(low[part], high[part])
            equal = w.hash[at] == self.hash[at + np.repeat(self.first[item[part]] - diagonal[part], size)]
            enough = np.add.reduceat(equal.astype(np.int64), np.cumsum(size) - size) >= self.least[item[part]]
            equal, size, rows = equal[np.repeat(enough, size)], size[enough], np.flatnonzero(enough) + part.start
            if not len(rows):
                continue
            least = self.least[item[rows]]
            first, end, matched = best_stretches(equal, size)
            other = matched < np.maximum(least, share * (end - first))
            if other.any():
                first[other], end[other], matched[other] = lawful_stretches(equal[np.repeat(other, size)], size[other], share)
            good = matched >= least
            rows, first, end, matched = rows[good], first[good], end[good], matched[good]
            place = low[rows] + first - w.first[doc[rows]]
            yield np.stack([doc[rows], item[rows], matched, -place, place, low[rows] + first - diagonal[rows], end - first], axis=1)


def _before(at: np.ndarray, seed: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is there one, the seed) of the window one place before, in the same text."""
    has, before = np.zeros(len(at), bool), np.zeros(len(at), U64)
    has[1:] = (at[1:] == at[:-1] + 1) & (doc[1:] == doc[:-1])
    before[1:] = seed[:-1]
    return has, before


def _slices(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of the rows with some AT_ONCE in all, or one row."""
    to, at = np.cumsum(sizes), 0
    while at < len(to):
        end = max(at + 1, int(np.searchsorted(to, (to[at - 1] if at else 0) + AT_ONCE, "right")))
        yield slice(at, end)
        at = end


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from low to before high, row after row."""
    n = high - low
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


class _Segments:
    """Rows of tokens, one behind the other, with the boundaries between tokens: size + 1
    of each row, numbered through."""

    def __init__(self, equal: np.ndarray, size: np.ndarray):
        self.start = np.cumsum(size + 1) - (size + 1)
        self.row = np.repeat(np.arange(len(size)), size + 1)
        self.token = np.ones(len(self.row), bool)  # boundaries that end a token
        self.token[self.start] = False
        self.equal, self.longest = equal, int(size.max(initial=0)) + 1
        self.count = self.sums(equal.astype(np.int64))

    def sums(self, of_token: np.ndarray) -> np.ndarray:
        """The sum over the row's tokens before each boundary."""
        step = np.zeros(len(self.row), np.int64)
        step[self.token] = of_token
        total = np.cumsum(step)
        return total - total[self.start][self.row]

    def falling(self, sums: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(the sums, lower in each next row than in all before; their running minimum)."""
        apart = sums - (2 * most * self.longest + 1) * self.row
        return apart, np.minimum.accumulate(apart)

    def first_largest(self, value: np.ndarray) -> np.ndarray:
        """The first boundary of each row with its largest value."""
        at = np.flatnonzero(value == np.maximum.reduceat(value, self.start)[self.row])
        return at[np.unique(self.row[at], return_index=True)[1]]


def best_stretches(equal: np.ndarray, size: np.ndarray, penalty: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, matches) of the stretch with the largest matches - penalty *
    substitutions, for each row of so many tokens; the first of equals."""
    s = _Segments(equal, size)
    gain, least = s.falling(s.sums(np.where(equal, 1, -penalty)), penalty)
    end = s.first_largest(gain - least)
    first = np.maximum.accumulate(np.where(gain == least, np.arange(len(gain)), 0))[end]
    return first - s.start, end - s.start, s.count[end] - s.count[first]


def lawful_stretches(equal: np.ndarray, size: np.ndarray, share: float = 0.8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, matches) of the stretch with the most matches of all whose tokens
    match by at least share, for each row of so many tokens; it begins and ends on a
    match, and is the first of equals."""
    part = Fraction(str(share)).limit_denominator(10_000)
    s = _Segments(equal, size)
    # excess over the share, in whole numbers: a stretch is lawful where it doesn't fall
    excess, least = s.falling(s.sums(np.where(equal, part.denominator - part.numerator, -part.numerator)), part.denominator)
    # the earliest start not above each end: where the running minimum first gets there
    start = np.searchsorted(-least, -excess, "left")
    end = s.first_largest(s.count - s.count[start])
    first, matched = start[end], s.count[end] - s.count[start[end]]
    # trimmed to the first and the last match, in boundaries
    match_end = np.flatnonzero(s.token)[equal]
    to_first = np.minimum(np.searchsorted(match_end, first, "right"), max(len(match_end) - 1, 0))
    to_last = np.maximum(np.searchsorted(match_end, end, "right") - 1, 0)
    some = matched > 0
    begin, stop = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    begin[some], stop[some] = match_end[to_first[some]] - 1 - s.start[some], match_end[to_last[some]] - s.start[some]
    return begin, stop, matched


def best_stretch(equal: np.ndarray, penalty: int = 2) -> tuple[int, int, int]:
    return tuple(int(x[0]) for x in best_stretches(equal, np.array([len(equal)]), penalty))


def lawful_stretch(equal: np.ndarray, share: float = 0.8) -> tuple[int, int, int]:
    return tuple(int(x[0]) for x in lawful_stretches(equal, np.array([len(equal)]), share))


_OVERLAP = "i1 long, i2 long, doc_first long, item_first int, n_tokens int, n_matched int"


def overlaps(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", least_tokens: int = 13, share: float = 0.8, least_item: int = 5, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document row and benchmark item that overlap: doc_id, item_id,
    doc_first (word of the document), item_first, n_tokens and n_matched of the
    stretch reported.

    A stretch counts if at least `share` of its tokens match, and matches are at
    least that share of least_tokens (of the item's tokens where it has fewer).
    Items of fewer than least_item tokens can't be told from chance and match nothing;
    with least_item=1 they match where all their tokens stand in a row (so seeds of one
    or two tokens ignore no place).  Null
    and empty texts overlap nothing; repeated rows and items are reported each; an
    empty table on either side gives no rows.  block_bytes bounds the benchmark
    text held at a time (one item at least)."""
    source = docs.select(F.struct(F.col(doc_id).alias("doc_id")).alias("kept"), F.col(text).alias("text"))
    kept = source.schema["kept"].dataType.simpleString()
    found = docs.sparkSession.createDataFrame([], f"kept {kept}, {_OVERLAP}")
    for seeds, last in _blocks(benchmark, item_text, block_bytes, least_tokens, share, least_item):
        part = source.mapInArrow(_finder(seeds, share), f"kept {kept}, {_OVERLAP}")
        if not last:
            part = Table(part).read()
            seeds.destroy()
        found = found.unionByName(part)
    i1, i2 = text_names(item_text)
    items = benchmark.select(F.col(item_id).alias("item_id"), i1.alias("i1"), i2.alias("i2"))
    return found.join(items, ["i1", "i2"]).select("kept.doc_id", "item_id", "doc_first", "item_first", "n_tokens", "n_matched")


def _blocks(benchmark: DataFrame, item_text: str, block_bytes: int, least_tokens: int, share: float, least_item: int):
    """(broadcast seeds, is it the last block) of the different benchmark texts, some
    block_bytes at a time."""
    i1, i2 = text_names(item_text)
    texts = Table(benchmark.select(i1.alias("i1"), i2.alias("i2"), text_or_empty(item_text).alias("text")).dropDuplicates(["i1", "i2"]))
    blocks = math.ceil((texts.read().agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes)
    for block in range(blocks):
        own = texts.read().where(F.pmod("i1", F.lit(blocks)) == block).toArrow().sort_by([("i1", "ascending"), ("i2", "ascending")])
        names = (own.column("i1").to_pylist(), own.column("i2").to_pylist())
        yield benchmark.sparkSession.sparkContext.broadcast(_Seeds(own.column("text").to_pylist(), least_tokens, share, least_item, names)), block == blocks - 1
    texts.drop()


def _best(raw: np.ndarray, offsets: np.ndarray, seeds: _Seeds, share: float) -> dict[tuple[int, int], tuple]:
    """(document, item) -> (matches, -position, first word, first in item, tokens)."""
    w = words(raw, offsets, ALNUM_FOLDED)
    best: dict[tuple[int, int], tuple] = {}
    n_items, width = len(seeds.size), len(w.hash) + int(seeds.size.max(initial=0)) + 1
    full: dict[int, int] = {}  # pair -> diagonal of a full match: those behind it can't be better
    for number, mask in enumerate(seeds.masks):
        for pair, diagonal in seeds.hits(w, mask, number):
            if full:
                known = np.array(sorted(full))
                at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
                ahead = (known[at] != pair) | (diagonal < np.array([full[p] for p in known.tolist()])[at])
                pair, diagonal = pair[ahead], diagonal[ahead]
            once = np.unique(pair * width + diagonal + seeds.size.max())
            for rows in seeds.stretches(w, once // width, once % width - seeds.size.max(), share):
                for doc, item, *row in rows.tolist():
                    best[doc, item] = max(tuple(row), best.get((doc, item), tuple(row)))
                    if row[0] == seeds.size[item]:
                        diagonal = int(row[2] + w.first[doc])
                        full[doc * n_items + item] = min(diagonal, full.get(doc * n_items + item, diagonal))
    return best


def _finder(shared, share: float):
    def rows(batches):
        for batch in pieces(batches, "text"):
            best = _best(*flat(batch.column("text")), shared.value, share)
            of, items = [d for d, _ in best], [i for _, i in best]
            columns = [*[names[items] for names in shared.value.names], *[[r[k] for r in best.values()] for k in (2, 3, 4, 0)]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column("kept").take(pa.array(of, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["kept", *[x.split()[0] for x in _OVERLAP.split(", ")]])

    return rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_text: str = "text", least_tokens: int = 13, share: float = 0.8, least_item: int = 5, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs, all columns, that overlap no benchmark item, by the rules
    of overlaps(); rows without words stay.  Nothing is shuffled; of a benchmark of
    several blocks each works on what the one before it left, as a written table."""
    left, columns, written = docs, docs.columns, None
    for seeds, last in _blocks(benchmark, item_text, block_bytes, least_tokens, share, least_item):
        source = left.select(F.struct("*").alias("row"), F.col(text).alias("text"))

        def rows(batches, shared=seeds):
            for batch in pieces(batches, "text"):
                best = _best(*flat(batch.column("text")), shared.value, share)
                clean = np.ones(batch.num_rows, bool)
                clean[[d for d, _ in best]] = False
                yield batch.filter(pa.array(clean))

        kept = source.mapInArrow(rows, f"row {source.schema['row'].dataType.simpleString()}, text string")
        left = kept.select(*[F.col("row")[c].alias(c) for c in columns])
        if not last:
            table = Table(left)
            if written:
                written.drop()
            left, written = table.read(), table
            seeds.destroy()
    return left


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), least_item=1)


_TOKENS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every item laid over every document at every offset with enough equal tokens.
SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_TOKENS} AS w FROM documents),
dt AS MATERIALIZED (SELECT r, unnest(range(len(w))) AS p, unnest(w) AS x FROM doc),
item AS (SELECT row_number() OVER () AS i, item_id, {_TOKENS} AS w FROM benchmark),
it AS MATERIALIZED (SELECT i, len(w) AS size, unnest(range(len(w))) AS q, unnest(w) AS x FROM item),
offsets AS MATERIALIZED (SELECT r, i, p - q AS diag FROM dt JOIN it USING (x) GROUP BY r, i, p - q, size HAVING 5 * count(*) >= 4 * least(13, size)),
cells AS (SELECT o.r, o.i, o.diag, it.q, it.size, (dt.x = it.x)::INT AS eq FROM offsets o JOIN it ON it.i = o.i JOIN dt ON dt.r = o.r AND dt.p = o.diag + it.q),
sums AS (
  SELECT *, sum(3 * eq - 2) OVER d AS gain, sum(3 * eq - 2) OVER d - (3 * eq - 2) AS gain_before,
    sum(5 * eq - 4) OVER d AS excess, sum(5 * eq - 4) OVER d - (5 * eq - 4) AS excess_before, sum(eq) OVER d AS hits, sum(eq) OVER d - eq AS hits_before
  FROM cells WINDOW d AS (PARTITION BY r, i, diag ORDER BY q)
),
low AS MATERIALIZED (SELECT *, min(gain_before) OVER (PARTITION BY r, i, diag ORDER BY q) AS least_before FROM sums),
ends AS (SELECT r, i, diag, q AS last, least_before, hits FROM low QUALIFY row_number() OVER (PARTITION BY r, i, diag ORDER BY gain - least_before DESC, q) = 1),
best AS (
  SELECT r, i, diag, max(size) AS size, max(low.q) AS first, max(last) AS last, max(ends.hits) - arg_max(low.hits_before, low.q) AS matched
  FROM ends JOIN low USING (r, i, diag) WHERE low.q <= last AND low.gain_before = ends.least_before GROUP BY r, i, diag
),
lawful AS (
  SELECT r, i, diag, z.q AS last, min(s.q) AS first, max(z.hits) - arg_min(s.hits_before, s.q) AS matched
  FROM low z JOIN low s USING (r, i, diag) WHERE s.q <= z.q AND s.excess_before <= z.excess GROUP BY r, i, diag, z.q
),
longest AS (SELECT * FROM lawful QUALIFY row_number() OVER (PARTITION BY r, i, diag ORDER BY matched DESC, last) = 1),
other AS (
  SELECT r, i, diag, min(low.q) AS first, max(low.q) AS last, max(matched) AS matched
  FROM longest JOIN low USING (r, i, diag) WHERE low.q BETWEEN first AND last AND eq = 1 GROUP BY r, i, diag
),
picked AS (
  SELECT r, i, diag, size, CASE WHEN ok THEN b.first ELSE o.first END AS first, CASE WHEN ok THEN b.last ELSE o.last END AS last, CASE WHEN ok THEN b.matched ELSE o.matched END AS matched
  FROM (SELECT *, 5 * matched >= 4 * greatest(least(13, size), last + 1 - first) AS ok FROM best) b LEFT JOIN other o USING (r, i, diag)
)
SELECT doc_id, item_id, (diag + first)::BIGINT AS doc_first, first::INT AS item_first, (last + 1 - first)::INT AS n_tokens, matched::INT AS n_matched
FROM (SELECT * FROM picked WHERE 5 * matched >= 4 * least(13, size) QUALIFY row_number() OVER (PARTITION BY r, i ORDER BY matched DESC, diag + first, first DESC, last - first DESC) = 1)
JOIN doc USING (r) JOIN item USING (i)
"""
