"""Byte-pair encoding: training over all words, and encoding.

Training.  The merges are those of the plain loop: the most frequent pair of neighbouring
symbols, of equals the last by name, again and again.  Where the distinct words have few
characters the driver runs that loop over them.  Else the words stay on the executors, in
blocks, and the counts of pairs are a table that each round's changes are added to.

A round takes the pairs A that are more frequent than a threshold t (a third of the best count, or
as far down as the bounds allow).  Words are cut wherever two neighbours aren't in A;
what is left are segments, which Spark aggregates.  No pair outside of A can get above t, and
a pair made of a cut's two sides is no more frequent than the pair at the cut was.  So all
merges with a count above t happen inside of segments, with exact counts, and the driver runs the
plain loop over the distinct segments until no pair is above t.  The merges then go to the
blocks.  Counts fall by a third or more each round, so rounds are few.  (A round ends
early if a merge makes a symbol that there is already, since such a symbol may stand on either
side of a cut.)

Encoding.  Each task merges each different piece once, all new pieces of a batch together in
arrays; pieces of more than 64 symbols by a heap over linked symbols.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections import Counter, defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import HANGUL
from ..shared import Table, fresh
from .tokens import BPE_SPECIALS, GPT_SPLIT, alphabet, decode_spacing

#: Symbols, or pairs, of a row of the tables of training; such rows of a block.
_PAGE, _BLOCK_PAGES = 1_000, 500
_LONG = 64
_MOST_WORDS = 200_000
#: Texts, and bytes of texts, that are worked on at a time.
_SOME, _SOME_BYTES = 250, 1 << 20

# --------------------------------------------------------------------- training


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """All merges in order of rank; each pass replaces every place of one pair."""
    while len(symbols) > 1:
        known = [ranks[p] for p in zip(symbols, symbols[1:]) if p in ranks]
        if not known:
            break
        best, out, i = min(known), [], 0
        while i < len(symbols):
            if i + 1 < len(symbols) and ranks.get((symbols[i], symbols[i + 1])) == best:
                out.append(symbols[i] + symbols[i + 1])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


class Spelled:
    """A block of words as one array of symbol numbers.  Word k has the places from
    start[k] to before start[k + 1], filled with -1 behind its symbols.  With an index a
    merge reads only the words that had the pair at some time."""

    def __init__(self, symbols: np.ndarray, start: np.ndarray, freq: np.ndarray):
        self.symbols, self.start, self.freq = symbols, start, freq
        self.index: dict[int, list[tuple[np.ndarray, np.ndarray]]] | None = None

    @classmethod
    def of(cls, batch: pa.RecordBatch, codes: np.ndarray) -> Spelled:
        """From token and freq; codes: the sorted code points that have the symbols 0, 1, ..."""
        text = batch.column("token").to_pylist()
        size = np.array([len(t) for t in text], np.int64)
        start = np.concatenate([[0], np.cumsum(size + 1)])
        symbols = np.full(start[-1], -1, np.int32)
        symbols[np.arange(size.sum()) + np.repeat(np.arange(len(text)), size)] = np.searchsorted(codes, np.frombuffer("".join(text).encode("utf-32-le"), np.uint32))
        return cls(symbols, start, batch.column("freq").to_numpy(zero_copy_only=False).astype(np.int64))

    def pairs(self) -> dict[int, int]:
        return _pairs(self.symbols, np.repeat(self.freq, np.diff(self.start)))

    def merge(self, a: int, b: int, new: int) -> dict[int, int]:
        """Replaces the pair wherever it stands, from the left; how the counts change."""
        at = self._places(a, b)
        if a == b and len(at):
            opens = np.concatenate([[True], np.diff(at) > 1])
            at = at[(at - at[np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))]) % 2 == 0]
        if not len(at):
            return {}
        word, of = np.unique(np.searchsorted(self.start, at, "right") - 1, return_inverse=True)
        low, size = self.start[word], self.start[word + 1] - self.start[word]
        first = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(word)), size)
        place = np.arange(size.sum()) + (low - first)[owner]
        symbols, weight = self.symbols[place], self.freq[word][owner]
        change = {p: -n for p, n in _pairs(symbols, weight).items()}
        here = at - low[of] + first[of]
        symbols[here] = new
        keep = np.ones(len(symbols), bool)
        keep[here + 1] = False
        rank = np.cumsum(keep) - keep
        out = np.full(len(symbols), -1, np.int32)
        out[(first[owner] + rank - rank[first][owner])[keep]] = symbols[keep]
        self.symbols[place] = out
        if self.index is not None:
            self._note(new, out, word[owner], (out[:-1] == new) | (out[1:] == new))
        return _add(change, _pairs(out, weight))

    def compact(self) -> Spelled:
        """Without the words that are one symbol, which have no pair any more."""
        size = np.add.reduceat(self.symbols >= 0, self.start[:-1]) if len(self.freq) else np.empty(0, np.int64)
        keep = size > 1
        inside = (self.symbols >= 0) & np.repeat(keep, np.diff(self.start))
        return Spelled._of_symbols(self.symbols[inside], size[keep], self.freq[keep])

    @classmethod
    def _of_symbols(cls, symbols: np.ndarray, size: np.ndarray, freq: np.ndarray) -> Spelled:
        start = np.concatenate([[0], np.cumsum(size + 1)])
        out = np.full(start[-1], -1, np.int32)
        out[np.arange(len(symbols)) + np.repeat(np.arange(len(size)), size)] = symbols
        return cls(out, start, freq)

    @classmethod
    def of_segments(cls, segments: pa.Array, freq: pa.Array) -> Spelled:
        raw, offsets = _binary(segments)
        return cls._of_symbols(np.frombuffer(raw, np.int32), np.diff(offsets) // 4, np.asarray(freq))

    def pages(self) -> tuple[pa.Array, pa.Array]:
        """The words in rows of some _PAGE symbols (or one longer word): symbols, each word's
        ending with -1, and frequencies, as bytes."""
        end = np.append(np.flatnonzero(np.diff(self.start[:-1] // _PAGE)) + 1, len(self.freq)) if len(self.freq) else np.empty(0, np.int64)
        end = np.concatenate([[0], end])
        return _bytes(self.symbols, self.start[end]), _bytes(self.freq, end)

    @classmethod
    def of_pages(cls, symbols: pa.Array, freq: pa.Array) -> Spelled:
        symbols = np.frombuffer(_binary(symbols)[0], np.int32).copy()
        start = np.concatenate([[0], np.flatnonzero(symbols < 0) + 1])
        return cls(symbols, start, np.frombuffer(_binary(freq)[0], np.int64))

    def segments(self, pairs: np.ndarray) -> pa.RecordBatch:
        """segment, freq: the longest runs of symbols of which any two neighbours are one
        of the pairs (sorted), with their words' frequencies summed."""
        key = self.symbols[:-1].astype(np.int64) << 32 | self.symbols[1:]
        near = (self.symbols[:-1] >= 0) & (self.symbols[1:] >= 0)
        near[near] = pairs[np.minimum(np.searchsorted(pairs, key[near]), len(pairs) - 1)] == key[near]
        edge = np.diff(near.astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        size = last - first + 1
        take = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
        spelled = _bytes(self.symbols[take], np.concatenate([[0], np.cumsum(size)]))
        weight = self.freq[np.searchsorted(self.start, first, "right") - 1]
        found = pa.table([spelled, pa.array(weight)], names=["segment", "freq"]).group_by("segment").aggregate([("freq", "sum")]).combine_chunks()
        return pa.RecordBatch.from_arrays([found.column("segment").combine_chunks(), found.column("freq_sum").combine_chunks()], names=["segment", "freq"])

    def merge_all(self, merges: list[tuple[int, int, int]]) -> dict[int, int]:
        """The merges one after the other, over all words together: each turn every word merges
        its first pair in order of the merges.  A pair that a merge makes comes after it, so
        that is the same.  Words without a pair left are dropped; how the counts change."""
        keys = np.array([a << 32 | b for a, b, _ in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        inside = self.symbols >= 0
        owner = np.repeat(np.arange(len(self.freq)), np.diff(self.start))[inside]
        symbols = self.symbols[inside].astype(np.int64)
        # words that have any of the pairs
        near = np.flatnonzero(owner[:-1] == owner[1:])
        found = _known(symbols[near] << 32 | symbols[near + 1], keys[order])[1]
        touched = np.zeros(len(self.freq), bool)
        touched[owner[near[found]]] = True
        old, still = touched[owner], ~touched[owner]
        change = {p: -n for p, n in _pairs_of(symbols[old], owner[old], self.freq).items()}
        done = _merge_by_rank(symbols[old], owner[old], keys[order], order, np.array([m[2] for m in merges], np.int64)[order])
        owners, parts = (np.concatenate([x[k] for x in done] or [np.empty(0, np.int64)]) for k in (0, 1))
        by = np.argsort(owners, kind="stable")
        owners, parts = owners[by], parts[by]
        _add(change, _pairs_of(parts, owners, self.freq))
        owners, parts = np.concatenate([owner[still], owners]), np.concatenate([symbols[still], parts])
        by = np.argsort(owners, kind="stable")
        size = np.bincount(owners, minlength=len(self.freq))
        keep = size > 1
        whole = Spelled._of_symbols(parts[by][np.repeat(keep, size)], size[keep], self.freq[keep])
        self.symbols, self.start, self.freq = whole.symbols, whole.start, whole.freq
        return {p: n for p, n in change.items() if n}

    def indexed(self) -> Spelled:
        self.index = {}
        self._note(-1, self.symbols, np.repeat(np.arange(len(self.freq)), np.diff(self.start)), True)
        return self

    def _note(self, made: int, symbols: np.ndarray, word: np.ndarray, where) -> None:
        """Which words have which pairs, for the neighbours at these places: two arrays
        for each merge, kept by the symbol that it made (-1: at the beginning)."""
        at = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0) & where)
        key = symbols[at].astype(np.int64) << 32 | symbols[at + 1]
        order = np.argsort(key, kind="stable")
        self.index.setdefault(made, []).append((key[order], word[at[order]].astype(np.int32)))

    def _places(self, a: int, b: int) -> np.ndarray:
        if self.index is None:
            return np.flatnonzero((self.symbols[:-1] == a) & (self.symbols[1:] == b))
        # a pair came up when the later of its symbols was made, or was there from the beginning
        pair, had = a << 32 | b, [np.empty(0, np.int32)]
        for key, words in (chunk for made in {-1, a, b} for chunk in self.index.get(made, ())):
            low, high = np.searchsorted(key, [pair, pair + 1])
            had.append(words[low:high])
        words = np.unique(np.concatenate(had))
        low, size = self.start[words], self.start[words + 1] - self.start[words]
        place = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        here = self.symbols[place]
        return place[np.flatnonzero((here[:-1] == a) & (here[1:] == b))]


def _pairs(symbols: np.ndarray, weight: np.ndarray) -> dict[int, int]:
    """The summed weights of neighbours, by first symbol << 32 | second."""
    inside = (symbols[:-1] >= 0) & (symbols[1:] >= 0)
    key, of = np.unique(symbols[:-1][inside].astype(np.int64) << 32 | symbols[1:][inside], return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, of, weight[:-1][inside])
    return dict(zip(key.tolist(), total.tolist()))


def _pairs_of(symbols: np.ndarray, owner: np.ndarray, freq: np.ndarray) -> dict[int, int]:
    """The same of symbols with the numbers of their words."""
    near = owner[:-1] == owner[1:]
    key, of = np.unique((symbols[:-1] << 32 | symbols[1:])[near], return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, of, freq[owner[:-1][near]])
    return dict(zip(key.tolist(), total.tolist()))


def _known(key: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted keys, whether it is there)."""
    if not len(keys):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return at, keys[at] == key


def _merge_by_rank(symbols: np.ndarray, owner: np.ndarray, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(owner, symbol) of words of any number together (owners ascending): each turn merges every
    word's pair of lowest rank, from the left; words without any are done.  keys: the pairs, sorted,
    with their ranks and what they make."""
    out, none = [], int(ranks.max(initial=-1)) + 1
    rank, at = np.full(len(symbols), none, np.int64), np.zeros(len(symbols), np.int64)
    near = np.flatnonzero(owner[:-1] == owner[1:])
    while len(symbols):
        # the pairs that came up in the last turn; the others' ranks are known
        at[near], there = _known(symbols[near] << 32 | symbols[near + 1], keys)
        known = near[there]
        rank[known] = ranks[at[known]]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        best = np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(owner)))
        live = best < none
        if not live.all():
            out.append((owner[~live], symbols[~live]))
            owner, symbols, rank, at, best = owner[live], symbols[live], rank[live], at[live], best[live]
        hit = np.flatnonzero(rank == best)
        # of places that overlap (a pair of equals) every second from the left
        opens = np.diff(hit, prepend=-2) > 1
        start = hit[np.maximum.accumulate(np.where(opens, np.arange(len(hit)), 0))] if len(hit) else hit
        hit = hit[(hit - start) % 2 == 0]
        symbols[hit] = made[at[hit]]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        owner, symbols, rank, at = owner[keep], symbols[keep], rank[keep], at[keep]
        here = hit - np.arange(len(hit))
        near = np.concatenate([here, here[here > 0] - 1])
        rank[near] = none
        near = near[near + 1 < len(owner)]
        near = near[owner[near] == owner[near + 1]]
    return out


def _add(to: dict[int, int], more: dict[int, int]) -> dict[int, int]:
    for p, n in more.items():
        to[p] = to.get(p, 0) + n
    return to


def _bytes(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array of the stretches of values between the offsets."""
    offsets = (values.itemsize * offsets).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _binary(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a binary array, and its offsets."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = values.cast(pa.large_binary())
    if not len(values):
        return memoryview(b""), np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    return memoryview(data)[offsets[0] : offsets[-1]], offsets - offsets[0]


class _Name(tuple):
    """A pair's symbols; the later in order comes first."""

    def __lt__(self, other):
        return tuple.__gt__(self, other)


class _Frequent:
    """The pairs in a heap by frequency, then name.  A changed count is a new entry; old
    ones are passed over when they come up."""

    def __init__(self, freq: dict[int, int], names: list[str]):
        self.freq, self.names = freq, names
        self.heap = [self._entry(p) for p in freq]
        heapq.heapify(self.heap)

    def _entry(self, p: int) -> tuple[int, _Name, int]:
        return -self.freq[p], _Name((self.names[p >> 32], self.names[p & 0xFFFFFFFF])), p

    def changed(self, pairs) -> None:
        for p in pairs:
            if self.freq.get(p, 0) > 0:
                heapq.heappush(self.heap, self._entry(p))

    def first(self) -> list[int]:
        while self.heap and self.freq.get(self.heap[0][2], 0) != -self.heap[0][0]:
            heapq.heappop(self.heap)
        return [self.heap[0][2]] if self.heap and self.heap[0][0] < 0 else []


class _Made:
    """What training has found so far: symbols by number, vocabulary, merges."""

    def __init__(self, letters: list[str], size: int):
        self.names, self.number, self.size = list(letters), {c: k for k, c in enumerate(letters)}, size
        self.vocab = dict(BPE_SPECIALS)
        for c in letters:
            self.vocab.setdefault(c, len(self.vocab))
        self.merges: list[tuple[str, str]] = []

    def full(self) -> bool:
        return len(self.vocab) >= self.size

    def add(self, pair: int) -> tuple[int, int, int, bool]:
        """(first, second, what they make, whether that is new)."""
        a, b = pair >> 32, pair & 0xFFFFFFFF
        made = self.names[a] + self.names[b]
        self.merges.append((self.names[a], self.names[b]))
        self.vocab.setdefault(made, len(self.vocab))
        new = made not in self.number
        if new:
            self.number[made] = len(self.names)
            self.names.append(made)
        return a, b, self.number[made], new


def _plain_loop(words: Spelled, made: _Made, above: int = 0, whole: bool = True) -> list[tuple[int, int, int]]:
    """Merges while there is a pair more frequent than `above`; those done.  Of segments
    (not whole) it stops after a merge that makes a symbol known before."""
    words = words.indexed()
    freq, done = words.pairs(), []
    frequent = _Frequent(freq, made.names)
    while not made.full() and (first := frequent.first()) and freq[first[0]] > above:
        a, b, symbol, new = made.add(first[0])
        done.append((a, b, symbol))
        change = {p: n for p, n in words.merge(a, b, symbol).items() if n}
        for p, n in change.items():
            freq[p] = freq.get(p, 0) + n
            if not freq[p]:
                del freq[p]
        frequent.changed(change)
        if not (new or whole):
            break
    return done


class _Blocks:
    """All words, and how often each pair occurs, as written tables.  A row of the words' table is a page of
    words, or one of changes of counts.  Readers and Arrow take thousands of rows at once, so pages are
    small; a task joins some to a block for its work."""

    _SCHEMA = "symbols binary, freq binary, pair array<bigint>, n array<bigint>"

    def __init__(self, counts: DataFrame, letters: list[str]):
        codes, to_rows = np.array([ord(c) for c in letters], np.uint32), self._rows

        def spell(batches):
            for batch in batches:
                block = Spelled.of(batch, codes).compact()
                yield from to_rows(block, block.pairs())

        self.table = Table(counts.mapInArrow(spell, self._SCHEMA))
        self.pairs = Table(self._counted(self.table.read()))

    @staticmethod
    def _rows(block: Spelled, change: dict[int, int]):
        symbols, freq = block.pages()
        pair, n = (np.fromiter(x, np.int64, len(change)) for x in (change.keys(), change.values()))
        offsets = pa.array(np.append(np.arange(0, len(pair), _PAGE), len(pair)), pa.int32())
        pair, n = (pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pair, n))
        names = ["symbols", "freq", "pair", "n"]
        yield pa.RecordBatch.from_arrays([symbols, freq, *[pa.nulls(len(symbols), pair.type)] * 2], names=names)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(pair), pa.binary())] * 2, pair, n], names=names)

    def _each(self, work, schema: str) -> DataFrame:
        """The rows that work() makes of each block."""

        def of_blocks(batches):
            for batch in batches:
                for k in range(0, batch.num_rows, _BLOCK_PAGES):
                    yield from work(Spelled.of_pages(*batch.slice(k, _BLOCK_PAGES).columns))

        return self.table.read().where("symbols IS NOT NULL").select("symbols", "freq").mapInArrow(of_blocks, schema)

    @staticmethod
    def _counted(blocks: DataFrame, before: DataFrame | None = None) -> DataFrame:
        each = blocks.where("pair IS NOT NULL").select(F.explode(F.arrays_zip("pair", "n")).alias("x")).select("x.pair", "x.n")
        both = each if before is None else each.unionAll(before)
        return both.groupBy("pair").agg(F.sum("n").alias("n")).where("n > 0")

    def levels(self) -> list[tuple[int, int]]:
        """(count rounded down to its first five bits, how many pairs have at least that),
        the highest first; some sixteen for each doubling."""
        shift = F.greatest(F.length(F.bin("n")) - 5, F.lit(0))
        level = F.call_function("shiftleft", F.call_function("shiftright", F.col("n"), shift), shift)
        rows = self.pairs.read().groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).collect()
        levels = sorted(((r["level"], r["pairs"]) for r in rows), reverse=True)
        return list(zip([x for x, _ in levels], np.cumsum([n for _, n in levels]).tolist()))

    def segments(self, least: int, most: int) -> Spelled | None:
        """The distinct segments of the pairs with a count of at least `least`; None if they
        have more than `most` symbols in all."""
        pairs = np.sort(np.asarray(self.pairs.read().where(F.col("n") >= least).select("pair").toArrow().column(0)))

        def cut(block: Spelled):
            yield block.segments(pairs)

        table = Table(self._each(cut, "segment binary, freq long").groupBy("segment").agg(F.sum("freq").alias("freq")))
        try:
            if (table.read().agg(F.sum(F.octet_length("segment"))).first()[0] or 0) > 4 * most:
                return None
            found = table.read().toArrow()
            return Spelled.of_segments(found.column("segment"), found.column("freq"))
        finally:
            table.drop()

    def best(self, names: list[str], most: int) -> list[tuple[int, tuple[str, str], int]]:
        """(count, names, pair) of the most frequent pairs, ties by name."""
        symbols = self.pairs.spark.createDataFrame(list(enumerate(names)), "symbol long, name string")
        named = lambda side: F.broadcast(symbols.select(F.col("symbol").alias(side), F.col("name").alias(f"{side}_name")))  # noqa: E731  as many as the vocabulary has
        a, b = F.shiftright("pair", 32), F.col("pair").bitwiseAND(0xFFFFFFFF)
        rows = self.pairs.read().withColumns({"a": a, "b": b}).join(named("a"), "a").join(named("b"), "b").orderBy(F.desc("n"), F.desc("a_name"), F.desc("b_name")).limit(most).collect()
        return [(r["n"], (r["a_name"], r["b_name"]), r["pair"]) for r in rows]

    def merge(self, merges: list[tuple[int, int, int]]) -> None:
        to_rows = self._rows

        def step(block: Spelled):
            change = block.merge_all(merges)
            yield from to_rows(block, change)

        old = self.table, self.pairs
        self.table = Table(self._each(step, self._SCHEMA))
        self.pairs = Table(self._counted(self.table.read(), old[1].read()))
        for table in old:
            table.drop()


def _independent(ranked: list[tuple[int, tuple[str, str], int]], whole: bool, known: dict[str, int]) -> list[int]:
    """Of the most frequent pairs (all of them, if whole) those that are merged next whatever the first of
    them change: no two share a symbol, and all with the last one's count are known."""
    out, used, made = [], set(), set()
    for n, name, p in ranked:
        ties = [x for x in ranked if x[0] == n]
        known_ties = whole or ties[-1] is not ranked[-1]
        if out and (not known_ties or any({x[2] >> 32, x[2] & 0xFFFFFFFF} & used for x in ties)):
            break
        out.append(p)
        used |= {p >> 32, p & 0xFFFFFFFF}
        if "".join(name) in known or "".join(name) in made:
            break
        made.add("".join(name))
    return out


def _by_rounds(words: _Blocks, made: _Made, most_pairs: int, most_symbols: int) -> None:
    while not made.full() and (levels := words.levels()):
        best, k = levels[0][0], 0
        # the lowest level that keeps to the bounds, not below a third of the best
        while k + 1 < len(levels) and levels[k + 1][1] <= most_pairs and 3 * levels[k + 1][0] >= best:
            k += 1
        segments = None
        while segments is None and k >= 0 and levels[k][1] <= most_pairs:
            segments = words.segments(levels[k][0], most_symbols)
            k = k if segments is not None else k // 2 if k else -1
        if segments is not None:
            merges = _plain_loop(segments, made, levels[k][0] - 1, whole=False)
        else:  # too many pairs of one count
            ranked = words.best(made.names, 256)
            merges = []
            for pair in _independent(ranked, len(ranked) < 256, made.number):
                if not made.full():
                    merges.append(made.add(pair)[:3])
        words.merge(merges)


def train_bpe(counts: DataFrame, vocab_size: int, driver_chars: int = 4_000_000, most_pairs: int = 20_000, most_symbols: int = 2_000_000) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """(vocabulary, merges) from the counts (token, freq) of all words, as the plain loop has them.

    The driver has the words where their characters are driver_chars at most, else at most
    most_pairs pairs and segments of most_symbols symbols at a time."""
    counts = counts.where("token != ''").select("token", "freq").persist(StorageLevel.DISK_ONLY)
    # the alphabet: at most all of Unicode
    letters = sorted(r["char"] for r in alphabet(counts).collect())
    total = counts.agg(F.sum(F.length("token"))).first()[0] or 0
    made = _Made(letters, vocab_size)
    if total <= driver_chars:
        all_words = counts.toArrow().combine_chunks().to_batches()
        if all_words:
            _plain_loop(Spelled.of(all_words[0], np.array([ord(c) for c in letters], np.uint32)), made)
        counts.unpersist()
    else:
        words = _Blocks(counts, letters)
        counts.unpersist()
        _by_rounds(words, made, most_pairs, most_symbols)
        words.table.drop()
        words.pairs.drop()
    return made.vocab, made.merges


# --------------------------------------------------------------------- encoding


def _heap_merge(symbols: list[int], ranks: dict[int, tuple[int, int]]) -> list[int]:
    """All merges of one long piece: places of pairs in a heap by rank, then place; symbols
    are linked.  Each pass replaces every place of the lowest rank, as merge() does."""
    after, before = [*range(1, len(symbols)), -1], [-1, *range(len(symbols) - 1)]

    def entry(i: int) -> tuple[int, int, int] | None:
        found = ranks.get(symbols[i] << 32 | symbols[after[i]]) if i >= 0 and after[i] >= 0 else None
        return found and (found[0], i, found[1])

    heap = [e for e in map(entry, range(len(symbols))) if e]
    heapq.heapify(heap)
    while heap:
        rank, new = heap[0][0], []
        while heap and heap[0][0] == rank:
            found = heapq.heappop(heap)
            i = found[1]
            if symbols[i] >= 0 and entry(i) == found:
                j = after[i]
                symbols[i], symbols[j], after[i] = found[2], -1, after[j]
                if after[j] >= 0:
                    before[after[j]] = i
                new += [before[i], i]
        for e in map(entry, new):
            if e:
                heapq.heappush(heap, e)
    return [x for x in symbols if x >= 0]


class Encoder:
    """The merges over symbol numbers: sorted keys of pairs, with rank and what they make."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        number = {s: k + 1 for k, s in enumerate(dict.fromkeys((*vocab, *(x for a, b in merges for x in (a, b, a + b)))))}
        letters = sorted((ord(s), k) for s, k in number.items() if len(s) == 1)
        self.codes, self.symbols = (np.array([x[k] for x in letters], np.int64) for k in (0, 1))
        self.ids = np.array([1, *(vocab.get(s, 1) for s in number)], np.int32)
        ranks = {number[a] << 32 | number[b]: (k, number[a + b]) for k, (a, b) in enumerate(merges)}
        self.keys = np.array(sorted(ranks), np.int64)
        self.rank, self.made = (np.array([ranks[p][k] for p in self.keys.tolist()], np.int64) for k in (0, 1))
        self.ranks = ranks

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, how many each has)."""
        size = np.array([len(p) for p in pieces], np.int64)
        codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        # letters of no pair and no id are 0
        symbols = np.where(self.codes[at] == codes, self.symbols[at], 0) if len(self.codes) else np.zeros(len(codes), np.int64)
        long = np.flatnonzero(size > _LONG)
        first = np.cumsum(size) - size
        short = np.repeat(size <= _LONG, size)
        out = _merge_by_rank(symbols[short], np.repeat(np.arange(len(pieces)), size)[short], self.keys, self.rank, self.made)
        for k in long.tolist():
            whole = np.array(_heap_merge(symbols[first[k] : first[k] + size[k]].tolist(), self.ranks), np.int64)
            out.append((np.full(len(whole), k), whole))
        owner, symbols = (np.concatenate([x[k] for x in out] or [np.empty(0, np.int64)]) for k in (0, 1))
        order = np.argsort(owner, kind="stable")
        return self.ids[symbols[order]], np.bincount(owner, minlength=len(pieces))


#: Pieces that open a word and have no ids: before a number, and before a text's first word.
_BLANK = (" ", " \n")


class _Cache:
    """What a task has encoded: words by number, and their ids one after the other; pieces likewise.  Pieces
    hold no blank but as their first character, so a text's pieces are those of its words, each with the
    blank before it; a text's first word (marked by a line break) has none."""

    def __init__(self, encoder: Encoder, pattern: str):
        import regex

        self.encoder, self.split = encoder, regex.compile(pattern).findall
        self.number, self.piece = _numbers(), _numbers(_BLANK)
        self.ids, self.size = np.empty(0, np.int32), np.empty(0, np.int64)
        self.piece_ids, self.piece_size = np.empty(0, np.int32), np.zeros(len(_BLANK), np.int64)
        self.opens = np.ones(len(_BLANK), bool)

    def extend(self) -> None:
        """Encodes the words that are numbered, but not encoded yet."""
        ids, size = [self.ids], [self.size]
        new = list(islice(self.number, len(self.size), None))
        for k in range(0, len(new), 20_000):
            # all words in one search: a piece that begins with a blank opens a word
            found = self.split(" " + " ".join(new[k : k + 20_000]))
            of = np.fromiter(map(self.piece.__getitem__, found), np.int64, len(found))
            self._extend_pieces()
            ids.append(_gather(self.piece_ids, self.piece_size, of))
            ends = np.concatenate([[0], np.cumsum(self.piece_size[of])])[np.append(np.flatnonzero(self.opens[of]), len(of))]
            size.append(np.diff(ends))
        self.ids, self.size = np.concatenate(ids), np.concatenate(size)

    def _extend_pieces(self) -> None:
        new = list(islice(self.piece, len(self.piece_size), None))
        if new:
            ids, size = self.encoder(new)
            self.piece_ids, self.piece_size = np.concatenate([self.piece_ids, ids]), np.concatenate([self.piece_size, size])
            self.opens = np.concatenate([self.opens, [p[0] == " " for p in new]])


def _numbers(first: tuple[str, ...] = ()) -> defaultdict[str, int]:
    """Gives each new key the next number.  (The count is an object of its own: with the dictionary's own length,
    it would hold itself, and be freed only when the collector of cycles happens to run.)"""
    return defaultdict(count(len(first)).__next__, {x: k for k, x in enumerate(first)})


def _words(text: str | None) -> list[str]:
    """Words of the text as tokens.nfd() normalizes it, the first marked by a line break."""
    words = unicodedata.normalize("NFD", text).split() if text else []
    if words:
        words[0] = "\n" + words[0]
    return words


def piece_counts(df: DataFrame, t: Column) -> DataFrame:
    """token, freq of all texts' pieces: tokens.word_counts() of tokens.pre_tokens() of tokens.nfd().  Each task
    counts words, some _MOST_WORDS at a time, and splits each different one (see _Cache) once."""
    pattern = GPT_SPLIT

    def counted(batches):
        import regex

        split, words = regex.compile(pattern).findall, Counter()

        def pieces() -> pa.RecordBatch:
            number = _numbers(_BLANK)
            found = split(" " + " ".join(words))
            of = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
            opens = np.array([p[0] == " " for p in number])
            freq = np.zeros(len(number), np.int64)
            np.add.at(freq, of, np.fromiter(words.values(), np.int64, len(words))[np.cumsum(opens[of]) - 1])
            return pa.RecordBatch.from_arrays([pa.array(number, pa.string()), pa.array(freq)], names=["token", "n"]).slice(len(_BLANK))

        for batch in batches:
            for texts in _some(batch.column(0)):
                for text in texts.to_pylist():
                    words.update(_words(text))
                if len(words) > _MOST_WORDS:
                    yield pieces()
                    words.clear()
        if words:
            yield pieces()

    return df.select(t.alias("text")).mapInArrow(counted, "token string, n long").groupBy("token").agg(F.sum("n").alias("freq"))


def _some(values: pa.Array):
    """Slices of at most _SOME rows and, but for a longer one, _SOME_BYTES bytes (of lists: numbers of 4 bytes)."""
    lists = pa.types.is_list(values.type)
    size = pc.list_value_length(values) if lists else pc.binary_length(values)
    total = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False), dtype=np.int64) * (4 if lists else 1)
    k = 0
    while k < len(values):
        most = (total[k - 1] if k else 0) + _SOME_BYTES
        end = max(k + 1, min(k + _SOME, int(np.searchsorted(total, most, "right"))))
        yield values.slice(k, end - k)
        k = end


def _gather(values: np.ndarray, size: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The lists numbered `of`, one after the other, of lists of these sizes in `values`."""
    n = size[of]
    return values[np.repeat((np.cumsum(size) - size)[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _encoding(vocab: dict[str, int], merges: list[tuple[str, str]]):
    """What gives texts their ids, some at a time, in a task."""
    shared = SparkSession.active().sparkContext.broadcast(Encoder(vocab, merges))  # of a size set by the vocabulary's maker
    pattern, kept = GPT_SPLIT, {}

    def encode(texts: pa.Array) -> pa.Array:
        if "cache" not in kept or len(kept["cache"].number) > _MOST_WORDS:
            kept["cache"] = _Cache(shared.value, pattern)
        cache = kept["cache"]
        number, of, per_text = cache.number, [], []
        for text in texts.to_pylist():
            words = _words(text)
            of += map(number.__getitem__, words)
            per_text.append(len(words))
        cache.extend()
        of = np.array(of, np.int64)
        flat = _gather(cache.ids, cache.size, of)
        ends = np.concatenate([[0], np.cumsum(cache.size[of])])[np.concatenate([[0], np.cumsum(per_text, dtype=np.int64)])]
        length = np.diff(ends) + 2
        offsets = np.concatenate([[0], np.cumsum(length)])
        out = np.full(offsets[-1], 2, np.int32)
        out[offsets[1:] - 1] = 3
        out[np.arange(len(flat)) + np.repeat(2 * np.arange(len(length)) + 1, length - 2)] = flat
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out), mask=texts.is_null() if texts.null_count else None)

    return encode


def _decoding(vocab: dict[str, int]):
    """What joins the pieces of ids, some lists at a time, in a task."""
    names = [""] * (max(vocab.values(), default=0) + 2)
    for token, i in vocab.items():
        names[i] = "" if token in BPE_SPECIALS else token
    shared = SparkSession.active().sparkContext.broadcast(pa.array(names, pa.string()))  # the last: ids that the vocabulary doesn't have

    def decode(ids: pa.Array) -> pa.Array:
        flat, size = ids.flatten(), pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        number = flat.fill_null(-1).to_numpy(zero_copy_only=False)
        none = len(shared.value) - 1
        taken = shared.value.take(pa.array(np.where((number >= 0) & (number < none), number, none)))
        offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(offsets, taken, mask=ids.is_null() if ids.null_count else None), "")

    return decode


def _spaced(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(HANGUL)), decode_spacing(text)).otherwise(text)


def bpe_encode(t: Column, vocab: dict[str, int], merges: list[tuple[str, str]]) -> Column:
    """bos, the ids of each piece after all merges, eos.  Texts are normalized as by tokens.nfd() and split
    by the pattern of tokens.pre_tokens(), blank pieces left out; a task merges a piece once."""
    some = _encoding(vocab, merges)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        # a few texts at a time, so that words of a whole batch are never held at once
        return pa.concat_arrays([some(x) for x in _some(texts)] or [pa.array([], pa.list_(pa.int32()))])

    return encode(t)


def bpe_decode(ids: Column, vocab: dict[str, int]) -> Column:
    """Specials and unknown ids out, pieces joined, scripts spaced."""
    some = _decoding(vocab)

    @F.arrow_udf("string")
    def joined(ids: pa.Array, _: pa.Array) -> pa.Array:
        return pa.concat_arrays([some(x) for x in _some(ids)] or [pa.array([], pa.string())])

    # by its second argument it isn't chained to bpe_encode(), which would then run once more for the ids
    return _spaced(joined(ids, F.lit(0)))


def bpe_coded(df: DataFrame, keep: list[str], t: Column, vocab: dict[str, int], merges: list[tuple[str, str]]) -> DataFrame:
    """The columns `keep` with `ids`, as bpe_encode() of t, and `decoded`, as bpe_decode() of them.  One Python worker
    a task does both and hands over a few rows at a time; the two columns need two, with all ids of a batch in each."""
    encode, decode = _encoding(vocab, merges), _decoding(vocab)
    names = [*keep, "ids", "decoded"]
    schema = df.select(*keep, F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("string").alias("decoded")).schema

    def code(batches):
        for batch in batches:
            *kept, texts = batch.columns
            k = 0
            for some in _some(texts):
                ids = encode(some)
                yield pa.RecordBatch.from_arrays([*(x.slice(k, len(some)) for x in kept), ids, decode(ids)], names=names)
                k += len(some)

    made = df.select(*keep, t.alias(fresh(df, "text")["text"])).mapInArrow(code, schema)
    return made.withColumn("decoded", _spaced(F.col("decoded")))
