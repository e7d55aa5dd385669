"""Sentences that stand several times in a text, in time that grows with the text's length."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

_SENTENCE = re.compile(rb"[.!?][ \t\n\x0b\f\r]+")
#: Bytes that plain searches of all sentences may read, and bytes of the shortest window.
_PLAIN, _WINDOW = 1 << 17, 8


def _characters(text: bytes) -> int:
    return len(text) if text.isascii() else sum(len(x) for x in re.findall(rb"[^\x80-\xbf]+", text))


def _frequent(text: bytes, sentences: list[bytes], times: int) -> list[bytes]:
    """The sentences of which every window of 8, 16, 32... bytes stands that often in the text.  Windows are
    counted by a hash, so a count may be too high, never too low."""
    at, start = {}, 0
    for s in _SENTENCE.split(text):
        at.setdefault(s, start := text.index(s, start))
        start += len(s)
    first, size = np.array([at[s] for s in sentences], np.int64), np.array([len(s) for s in sentences], np.int64)
    left = np.flatnonzero(size >= _WINDOW)
    short = np.flatnonzero(size < _WINDOW).tolist()
    padded = np.frombuffer(text, np.uint8)
    names = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, _WINDOW)).view("<u8").ravel()
    bits, width = min(24, len(text).bit_length() + 2), _WINDOW  # the table of counts has a bounded size
    done: list[int] = []
    with np.errstate(over="ignore"):
        while len(left):
            # the high bits of a product depend on all of its factor
            bucket = (names * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
            often = np.bincount(bucket.view(np.int64), minlength=1 << bits)[bucket.view(np.int64)] >= times
            before = np.concatenate([[0], np.cumsum(often)])
            windows = size[left] - width + 1
            left = left[before[first[left] + windows] - before[first[left]] == windows]
            done += left[size[left] < 2 * width].tolist()
            left = left[size[left] >= 2 * width]
            if len(left):
                mixed = names ^ (names >> np.uint64(29))
                names = mixed[:-width] * np.uint64(0xBF58476D1CE4E5B9) + (mixed[width:] ^ (mixed[width:] >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
                width *= 2
    return [sentences[k] for k in sorted(short + done)]


def repeats(text: bytes, parts: int = 3, times: int = 3, longer_than: int = 10) -> bool:
    """Some sentence of more than so many characters stands that often in the text, also inside of others."""
    found = _SENTENCE.split(text)
    if len(found) < parts:
        return False
    counts = Counter(found)
    sentences = [s for s in counts if len(s) > longer_than and _characters(s) > longer_than]
    if any(counts[s] >= times for s in sentences):
        return True
    if len(sentences) * len(text) > _PLAIN:
        sentences = _frequent(text, sentences, times)
    return any(text.count(s) >= times for s in sentences)


@lru_cache
def repeats_udf(parts: int, times: int, longer_than: int):
    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        out = (repeats(t, parts, times, longer_than) if t is not None else None for k in range(0, len(texts), 250) for t in texts.slice(k, 250).to_pylist())
        return pa.array(out, pa.bool_())

    return found
