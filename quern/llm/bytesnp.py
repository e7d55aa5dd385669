"""Vectorised byte and word primitives shared by the operators of this subpackage.

Texts arrive as Arrow string arrays; everything here works on one flat uint8
buffer with document offsets, so the cost per byte is a handful of numpy passes
and no Python object is made per word.  All hashes are 64-bit, seeded by fixed
constants, equal on every machine and independent of batch boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15)
        return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective); spreads every input bit over the output."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of the ordered pair (a, b)."""
    return mix(a * U64(0xD6E8FEB86659FD93) + b)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (cached, grown by doubling)."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for key, base in (("p", _BASE), ("q", _BASE_INV)):
            out = np.empty(size, U64)
            out[0] = 1
            have = 1
            while have < size:
                step = U64(pow(base, have, 1 << 64))
                out[have : 2 * have] = out[:have] * step
                have *= 2
            _powers[key] = out
    return _powers["p"][:n], _powers["q"][:n]


BYTE_CODE = _splitmix(256, 77)


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """H with H[i] = sum of codes[j] * base**j over j < i."""
    out = np.empty(len(codes) + 1, U64)
    out[0] = 0
    np.cumsum(codes * powers(len(codes))[0] if len(codes) else codes, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end], the same wherever the span lies."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(U64))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one buffer, and n + 1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about most_bytes of text: working memory stays
    in proportion to that, or to the longest single text."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64) + 16)
        at = 0
        while at < batch.num_rows:
            gone = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, gone + most_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


class Words(NamedTuple):
    hash: np.ndarray  # uint64 of the word's bytes, after folding
    doc: np.ndarray  # index of its document in the batch
    start: np.ndarray  # first byte in the flat buffer
    end: np.ndarray
    first: np.ndarray  # n_docs + 1 offsets: words of document i are first[i]:first[i + 1]


def byte_table(word: bytes | str, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, folded byte) for all 256 bytes.  word: "space" for runs
    of anything but 0x20 and 0x09-0x0D, "alnum" for runs of 0-9, A-Z, a-z and
    non-ASCII; fold lower-cases A-Z."""
    is_word = np.ones(256, bool)
    if word == "space":
        is_word[[0x20, *range(0x09, 0x0E)]] = False
    else:
        is_word[:0x80] = False
        for a, b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
            is_word[a : b + 1] = True
    low = np.arange(256, dtype=np.uint8)
    if fold:
        low[0x41:0x5B] += 32
    return is_word, low


SPACE_FOLDED, ALNUM_FOLDED, SPACE_EXACT = byte_table("space"), byte_table("alnum"), byte_table("space", False)


def words(raw: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray], hashes: bool = True) -> Words:
    """All words of all documents of a batch, in order."""
    n_docs = len(offsets) - 1
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = table[0][raw]
    opens = inside[:-1].copy()
    opens[1:] &= ~inside[:-2]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    opens[edges] = inside[edges]
    start = np.flatnonzero(opens)
    closes = inside[:-1] & ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    closes[last] = inside[last]
    end = np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    if not hashes:
        return Words(np.empty(0, U64), doc, start, end, first)
    prefix = prefix_hash(BYTE_CODE[table[1]][raw])
    return Words(span_hash(prefix, start, end), doc, start, end, first)


def stems(raw: np.ndarray, w: Words, table: tuple[np.ndarray, np.ndarray], sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, hash) of the first bytes of every longer word, for each size."""
    prefix = prefix_hash(BYTE_CODE[table[1]][raw]) if sizes else None
    for size in sizes:
        longer = np.flatnonzero(w.end - w.start > size)
        yield w.doc[longer], span_hash(prefix, w.start[longer], w.start[longer] + size)


def word_hash(word: str) -> int:
    """The hash that words() gives to this word (already folded)."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hash(prefix_hash(BYTE_CODE[raw]), np.array([0]), np.array([len(raw)]))[0])


def window_names(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, names) of all windows of n consecutive words of one document."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.int64), np.empty(0, U64)
    name = hashes[:size]
    for i in range(1, n):
        name = combine(name, hashes[i : i + size])
    whole = doc[:size] == doc[n - 1 :]
    return np.flatnonzero(whole), name[whole]
