"""License scan: a generalised suffix automaton over licence texts.

The automaton of all templates' tokens is built once per Python worker.  Files are
streamed through it: after each token it knows the longest suffix read so far that
stands in some template, and by its links the longest one that stands in each
(matching statistics, for every template and place).  Matches that can't grow and are
long enough are chained along their template, and the chain's share of the template
decides.  Where chains of several templates lie on the same words, the one that covers
most tokens stays, of equals the one that covers more of its template.

Only stretches of words whose windows of the least length stand in some template are
streamed; a match can't lie anywhere else.  Words and windows are compared by 64-bit
hashes; the places of phrases are compared byte by byte then.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesnp import ALNUM_FOLDED, U64, flat, pieces, window_names, word_hash, words
from .licences import TEMPLATES

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text: str) -> list[str]:
    """Words after lower-casing A-Z."""
    return _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


class SuffixAutomaton:
    """Generalised over several token sequences; each state knows one place where its
    strings stand, (sequence, end), and where asked all of them."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.place = [-1], [0], [(0, 0)]
        self._prefix = []
        for k, sequence in enumerate(sequences):
            last = 0
            for end, token in enumerate(sequence, 1):
                last = self._extend(last, token, (k, end))
                self._prefix.append((last, (k, end)))

    def _state(self, length: int, place: tuple[int, int], moves: dict[int, int] | None = None, link: int = -1) -> int:
        self.next.append(dict(moves or {}))
        self.link.append(link)
        self.length.append(length)
        self.place.append(place)
        return len(self.next) - 1

    def _split(self, parent: int, token: int, child: int) -> int:
        """The state for the longest string of parent plus token."""
        clone = self._state(self.length[parent] + 1, self.place[child], self.next[child], self.link[child])
        self.link[child] = clone
        while parent >= 0 and self.next[parent].get(token) == child:
            self.next[parent][token] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, token: int, place: tuple[int, int]) -> int:
        known = self.next[last].get(token)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, token, known)
        new, at = self._state(self.length[last] + 1, place), last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            child = self.next[at][token]
            self.link[new] = child if self.length[child] == self.length[at] + 1 else self._split(at, token, child)
        return new

    def statistics(self, stream) -> Iterator[tuple[int, int]]:
        """After each token: (length of the longest suffix that occurs, its state)."""
        at = matched = 0
        for token in stream:
            while at and token not in self.next[at]:
                at = self.link[at]
                matched = self.length[at]
            to = self.next[at].get(token)
            if to is None:
                at = matched = 0
            else:
                at, matched = to, matched + 1
            yield matched, at


    def standing(self, least: int) -> list[dict[tuple[int, int], int]]:
        """Of each state, every place (sequence, end) where a suffix of at least that
        many tokens of its longest string stands, with the length of the longest such."""
        order = sorted(range(1, len(self.next)), key=lambda s: self.length[s])
        ends = defaultdict(list)
        for state, place in self._prefix:
            ends[state].append(place)
        for state in reversed(order):
            ends[self.link[state]] += ends[state]
        out: list[dict[tuple[int, int], int]] = [{} for _ in self.next]
        for state in order:
            if self.length[state] >= least:
                out[state] = out[self.link[state]] | dict.fromkeys(ends[state], self.length[state])
        return out


def long_matches(automaton: SuffixAutomaton, standing: list[dict], stream: list[int], least: int) -> list[tuple[int, int, int, int]]:
    """(start in the stream, length, sequence, start there) of all matches of at
    least that many tokens that can't grow, with every place of every sequence."""
    found, before = [], {}
    for end, (matched, state) in enumerate([*automaton.statistics(stream), (0, 0)]):
        now = {place: min(matched, longest) for place, longest in standing[state].items() if matched >= least}
        for (sequence, to), length in before.items():
            if (sequence, to + 1) not in now:
                found.append((end - length, length, sequence, to - length))
        before = now
    return found


def chain(matches: list[tuple[int, int, int, int]], gap: int) -> list[tuple[int, int, int, int]]:
    """(sequence, first token, last token, template tokens covered) of chains: matches
    along one template, in order in both, at most `gap` tokens apart in both.  The
    chains that cover most come first; each match is in one chain."""
    out, by_sequence = [], defaultdict(list)
    for start, length, sequence, at in sorted(matches):
        by_sequence[sequence].append((start, length, at))
    for sequence, own in by_sequence.items():
        best: list[tuple[int, int | None]] = []  # covered by the best chain up to here, the match before
        near: list[int] = []
        for k, (start, length, at) in enumerate(own):
            near = [j for j in near if start - own[j][0] - own[j][1] <= gap]
            top = (length, None)
            for j in near:
                s, n, t = own[j]
                if s < start and t < at and s + n < start + length and t + n < at + length and at - t - n <= gap:
                    top = max(top, (best[j][0] + at + length - max(at, t + n), j), key=lambda x: x[0])
            best.append(top)
            near.append(k)
        used: set[int] = set()
        for k in sorted(range(len(own)), key=lambda k: -best[k][0]):
            if k in used:
                continue
            last, at, covered = k, k, best[k][0]
            used.add(k)
            while (before := best[at][1]) is not None:
                if before in used:
                    covered -= best[before][0]
                    break
                used.add(before)
                at = before
            out.append((sequence, own[at][0], own[last][0] + own[last][1] - 1, covered))
    return out


def _settled(chains: list[tuple[int, int, int, int]], sizes: list[int], coverage: float) -> list[tuple[int, int, int, int]]:
    """The chains that cover enough of their template and share no more than half of
    their words with one that covers more tokens, by their first word."""
    near = defaultdict(set)  # the chains that stay, by stretches of 256 words
    out = []
    for c in sorted((c for c in chains if c[3] >= coverage * sizes[c[0]]), key=lambda c: (-c[3], -c[3] / sizes[c[0]], c[0], c[1])):
        reach = range(c[1] >> 8, (c[2] >> 8) + 1)
        if all(2 * (min(c[2], o[2]) - max(c[1], o[1]) + 1) <= c[2] - c[1] + 1 for k in reach for o in near[k]):
            out.append(c)
            for k in reach:
                near[k].add(c)
    return sorted(out, key=lambda c: (c[1], c[0]))


@cache
def _compiled(templates: tuple[tuple[str, str], ...], phrases: tuple[str, ...], least: int):
    texts = [tokens(text) for _, text in templates]
    terms = {t: i for i, t in enumerate(dict.fromkeys(t for text in [*texts, *map(tokens, phrases)] for t in text))}
    hashes = np.array([word_hash(t) for t in terms], U64)
    order = np.argsort(hashes)
    automaton = SuffixAutomaton([[terms[t] for t in text] for text in texts])
    w = words(*flat(pa.array([text for _, text in templates], pa.string())), ALNUM_FOLDED)
    windows = np.unique(window_names(w.hash, w.doc, least)[1])
    return automaton, automaton.standing(least), [len(t) for t in texts], hashes[order], order, windows, [[t.encode() for t in tokens(p)] for p in phrases]


def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def _places(raw: np.ndarray, w, phrase: list[bytes]) -> Iterator[int]:
    """Words where the phrase's words stand one behind the other in one document."""
    size = len(w.hash) - len(phrase) + 1
    if size <= 0 or not phrase:
        return
    hit = w.doc[:size] == w.doc[len(phrase) - 1 :]
    for k, term in enumerate(phrase):
        hit &= w.hash[k : k + size] == U64(word_hash(term.decode()))
    for p in np.flatnonzero(hit).tolist():
        if all(raw[w.start[p + k] : w.end[p + k]].tobytes().lower() == term for k, term in enumerate(phrase)):
            yield p


_COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:int,last_word:int,coverage:double>>"


def scan(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, least: int = 6, gap: int = 8, coverage: float = 0.25) -> DataFrame:
    """Per row: the columns in keep, n_words, n_base (places where a phrase
    stands), first_word and last_word (their smallest and largest start),
    base_labels, labels (the method's too), score, and spans (template spans:
    label, first and last word, share of the template covered).

    A span counts where a chain of matches of `least` tokens or more, at most `gap`
    tokens apart, covers that share of its template, and most of its words lie in no
    span that covers more tokens.  score: the largest share
    covered, at least 0.5 where a phrase stands.  Null and empty texts have no
    words, no labels and score 0; repeated rows are scanned alike; columns outside
    of keep are dropped; an empty table gives an empty table."""
    template_items = tuple((templates or TEMPLATES).items())
    phrase_items = tuple((PHRASES if phrases is None else phrases).items())
    source = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"))
    schema = f"kept {source.schema['kept'].dataType.simpleString()}, {_COLUMNS}"

    def rows(batches):
        automaton, standing, sizes, hashes, order, windows, phrase_terms = _compiled(template_items, tuple(p for p, _ in phrase_items), least)
        for batch in pieces(batches, "text"):
            raw, offsets = flat(batch.column("text"))
            w = words(raw, offsets, ALNUM_FOLDED)
            n_docs, places, labels = len(offsets) - 1, defaultdict(list), defaultdict(set)
            for (_, label), phrase in zip(phrase_items, phrase_terms):
                for p in _places(raw, w, phrase):
                    places[int(w.doc[p])].append(int(p - w.first[w.doc[p]]))
                    labels[int(w.doc[p])].add(label)
            at, window = window_names(w.hash, w.doc, least)
            at = at[_among(windows, window)]
            opens = np.ones(len(at), bool)
            opens[1:] = (at[1:] != at[:-1] + 1) | (w.doc[at[1:]] != w.doc[at[:-1]])
            runs = np.flatnonzero(opens)
            spans = defaultdict(list)
            for x, y in zip(at[runs].tolist(), (at[np.append(runs[1:], len(at)) - 1] + least).tolist() if len(at) else ()):
                doc = int(w.doc[x])
                stream = order[np.searchsorted(hashes, w.hash[x:y])].tolist()
                base = int(x - w.first[doc])
                spans[doc] += [(start + base, length, sequence, t) for start, length, sequence, t in long_matches(automaton, standing, stream, least)]
            out: list[tuple] = []
            for doc in range(n_docs):
                own = sorted(places.get(doc, ()))
                mine = [{"label": template_items[k][0], "first_word": a, "last_word": b, "coverage": c / sizes[k]} for k, a, b, c in _settled(chain(spans.get(doc, []), gap), sizes, coverage)]
                base_labels = sorted(labels.get(doc, ()))
                every = sorted({*base_labels, *(s["label"] for s in mine)})
                score = max([0.5 if own else 0.0, *(min(1.0, s["coverage"]) for s in mine)])
                out.append((int(w.first[doc + 1] - w.first[doc]), len(own), own[0] if own else None, own[-1] if own else None, ",".join(base_labels), ",".join(every), score, mine))
            columns = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("coverage", pa.float64())]))]
            names = ["kept", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)

    out = source.mapInArrow(rows, schema)
    return out.select("kept.*", *[c for c in out.columns if c != "kept"])


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).drop("spans")
