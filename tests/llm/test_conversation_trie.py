"""The prefix trie of conversations against a plain trie in memory, on awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quern.llm import conversation_trie as trie


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said = (role or "", text or "")
            name = hashlib.md5(f"{len(said[0].encode())}:{said[0]}{said[1]}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, name), said))
    turns = {c: [said for _, said in sorted(x)] for c, x in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
    return {c: turns.get(c - c % 20, [])[: h[c]] + t[h[c] :] for c, t in turns.items()}


def brute_trie(rows):
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[c] for c in children[node])
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
    return sorted(
        (min(m), len(n), -1 if not n else min(members[n[:-1]]), len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, m in members.items()
    )


def awkward():
    rng = random.Random(13)
    say = lambda k: (rng.choice(["user", "assistant", None, ""]), rng.choice(["", None, "a", "b b\n", "c c c", "é  \t x", f"t {rng.randrange(k)}"]))
    rows = [(c, t, *say(4)) for c in range(200) for t in range(rng.randrange(1, 7))]  # many shared prefixes
    rows += [(1000 + c, t, "user", f"turn {t}") for c in range(90) for t in range(6 + c % 3)]  # three conversations, thirty times each
    rows += [(3000 + c, t, "user", "first" if t == 0 else f"own {c}") for c in range(700) for t in range(5)]  # one hot first turn
    rows += [(5000, t, "user", f"{t}") for t in range(400)] + [(5001, t, "user", f"{t}") for t in range(399)]  # long ones
    rows += [(7000 + c, 0, "user", "only") for c in range(30)] + [(8003, None, "u", "no turn"), (8003, None, "u", "no turn"), (8003, 2, None, None), (8003, 2, "x", None), (None, 1, "user", "nobody's")]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def found(frame):
    return sorted((*(-1 if v is None else v for v in r[:3]), *r[3:]) for r in map(tuple, frame.collect()))


@pytest.mark.parametrize(("ranges", "waiting", "run_bytes"), [(1, 256, 4 << 20), (7, 3, 2000), (60, 0, 400)])
def test_trie_equals_brute_force(spark, monkeypatch, ranges, waiting, run_bytes):
    from pyspark.sql import functions as F

    rows = awkward()
    monkeypatch.setattr(trie, "_WAITING", waiting)
    monkeypatch.setattr(trie, "_RUN_BYTES", run_bytes)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "name": F.lit("x"), "depth": F.lit(9), "words": F.lit(None)}).repartition(5)
    out = trie.prefix_trie(table, ranges=ranges)
    assert out.columns == trie._COLUMNS
    assert found(out) == brute_trie(rows)


def test_trie_of_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(empty).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 0, "a", "b")], SCHEMA)).count() == 0
    for rows in ([(1, 0, "user", "x y")], [(k, 0, None, None) for k in range(8)], [(21, 0, "a", "b"), (20, 0, "c", "d")]):
        assert found(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute_trie(rows)


def test_loser_tree_merges_and_keeps_shared_turns():
    rng = random.Random(2)
    for size in (0, 1, 2, 5, 40):
        keys = {b"".join(bytes([rng.randrange(3)]) * 16 for _ in range(rng.randrange(9))) for _ in range(size * 20)}
        runs = [[] for _ in range(size)]
        for key in keys:
            rng.choice(runs).append(key)
        sections = []
        for run in runs:
            run.sort()
            sections.append([(trie.shared_turns(a, b) if a is not None else 0, b) for a, b in zip([None, *run], run)])
        out = list(trie.merged(sections))
        assert [row[1] for _, row in out] == sorted(keys)
        assert [lcp for lcp, _ in out[1:]] == [trie.shared_turns(a[1][1], b[1][1]) for a, b in zip(out, out[1:])]
