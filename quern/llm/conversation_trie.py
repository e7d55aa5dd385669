"""Prefix trie of rebuilt conversations by an LCP-aware external mergesort.

A conversation is its turns' names (16 bytes of role and text each) in a row; equal conversations are
one row, with the members' smallest id, their number and a digest of their ids, which streams over
them in order.

Runs: tasks sort bounded stretches of rows; each row carries the number of turns that it shares
with the row before it.  Runs lie in the shared folder as a table.  Merge: rows are range-partitioned
by their whole key, so however many share a first turn they spread out, and each task
merges its sections of all runs with a loser tree.  Of two rows that share l and m turns
with the last row put out, the one that shares more comes first without a comparison; only
at equal numbers their names are compared, from there on.

Nodes: the merged rows run over a stack of open nodes, the path of the last row.  A row that shares l
turns finishes all nodes deeper than l.  Nodes on the first and on the last path of a
task may go on in the neighbouring tasks: these are partial sums.  What a task can't
know of them (whether its first path is new, whether its last row is a leaf) follows from the
neighbours' first and last keys, a row a task, and is added as corrections before the
partial sums of a node meet in an aggregation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, text_or_empty

#: Bytes of a turn's name; keys in a run; keys in a merging task; rows that wait for their parent.
_NAME, _RUN_BYTES, _RANGE_BYTES, _WAITING = 16, 4 << 20, 32 << 20, 256
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_RUNS = "run long, at long, lcp long, key binary, words binary, least long, n long, ends string"
_NODES = "kind int, name binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, words binary"
_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_RESOLVED, _UNRESOLVED, _PARTIAL, _EDGE = range(4)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def shared_turns(a: bytes, b: bytes, since: int = 0) -> int:
    """How many turns two keys have in common, known to be `since` at least."""
    most = min(len(a), len(b)) // _NAME
    while since < most and a[_NAME * since : _NAME * (since + 1)] == b[_NAME * since : _NAME * (since + 1)]:
        since += 1
    return since


# ----------------------------------------------------------------- conversations


def rebuilt(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str, group: int, most: int) -> Table:
    """conv, key, words: of each conversation the first h turns of conversation
    conv - conv % group, h = crc32(conv) % most, then its own after the first h."""
    said = text_or_empty(text)
    name = F.md5(F.concat(F.octet_length(text_or_empty(role)).cast("string"), F.lit(":"), text_or_empty(role), said).cast("binary"))
    n_words = F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+"))
    entry = F.struct(F.col(turn).isNotNull().alias("has"), F.col(turn).alias("turn"), name.alias("name"), n_words.alias("words"))
    turns = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv"), entry.alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["name"].alias("name"), t["words"].alias("words")))
    own = Table(turns.groupBy("conv").agg(ordered.alias("turns")))
    heads = own.read().select(F.col("conv").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    with_head = own.read().withColumns({"base": F.col("conv") - F.col("conv") % group, "h": h}).join(heads, "base", "left")
    first = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", F.lit(1), F.lit(0)))
    whole = with_head.select("conv", F.concat(first, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("r"))
    out = Table(whole.select("conv", F.unhex(F.array_join("r.name", "")).alias("key"), F.col("r.words").alias("words")))
    own.drop()
    return out


def _digests(batches):
    """sequence, least, n, ends of rows (sequence, conv) in order: one pass, a hash at a time."""
    now, least, n, digest = None, None, 0, None
    for batch in batches:
        ids, names = batch.column("conv").to_pylist(), np.asarray(batch.column("sequence").to_pylist(), object)
        first = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(ids)]
        out = []
        for a, b in zip(first[:-1], first[1:]):
            if a == b:
                continue
            if names[a] != now:
                if now is not None:
                    out.append((now, least, n, digest.hexdigest()))
                now, least, n, digest = names[a], ids[a], 0, hashlib.sha256()
            digest.update(("," * bool(n) + ",".join(map(str, ids[a:b]))).encode())
            n += b - a
        yield _batch(out, "sequence string, least long, n long, ends string")
    if now is not None:
        yield _batch([(now, least, n, digest.hexdigest())], "sequence string, least long, n long, ends string")


# -------------------------------------------------------------------------- sort


def _sorted_runs(batches):
    """Runs of about 4 MB of keys."""

    def run(held):
        held.sort(key=lambda row: row[0])
        keys = [row[0] for row in held]
        shared = [0, *(shared_turns(a, b) for a, b in zip(keys, keys[1:]))]
        return _batch([(task + number, at, lcp, *row) for at, (lcp, row) in enumerate(zip(shared, held))], _RUNS)

    held, size, number, task = [], 0, 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        words = [np.array(w, np.int32).tobytes() for w in batch.column("words").to_pylist()]
        held += zip(batch.column("key").to_pylist(), words, *(batch.column(c).to_pylist() for c in ("least", "n", "ends")))
        size += int(pc.sum(pc.binary_length(batch.column("key"))).as_py() or 0) + 100 * batch.num_rows
        if size >= _RUN_BYTES:
            yield run(held)
            held, size, number = [], 0, number + 1
    if held:
        yield run(held)


def merged(runs: list[list[tuple]]):
    """(lcp, row) of the rows of all runs in order of their keys; a row is (lcp, key, ...) with
    the turns that it shares with the one before it in its run.  A loser tree: node k of the
    tree has the run that lost there, and shared[run] says how many turns its row shares
    with the row that won."""
    runs = [r for r in runs if r]
    width = 1 << max(0, (len(runs) - 1).bit_length())
    runs = [*runs, *[[]] * (width - len(runs))]
    place, shared = [0] * width, [0] * width
    loser = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs."""
        if place[b] == len(runs[b]):
            return a, b
        if place[a] == len(runs[a]):
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = runs[a][place[a]][1], runs[b][place[b]][1]
        same = shared_turns(x, y, shared[a])
        win, lose = (a, b) if x[_NAME * same : _NAME * (same + 1)] <= y[_NAME * same : _NAME * (same + 1)] else (b, a)
        shared[lose] = same
        return win, lose

    def first(node: int) -> int:
        if node >= width:
            return node - width
        win, loser[node] = play(first(2 * node), first(2 * node + 1))
        return win

    win = first(1)
    while place[win] < len(runs[win]):
        yield shared[win], runs[win][place[win]]
        place[win] += 1
        if place[win] < len(runs[win]):
            shared[win] = runs[win][place[win]][0]
        node = (win + width) // 2
        while node:
            win, loser[node] = play(win, loser[node])
            node //= 2


# ------------------------------------------------------------------------- nodes


def _chain(key: bytes, names: list[bytes]) -> list[bytes]:
    """names of the prefixes of a key, longer ones put on to the given of shorter ones."""
    while len(names) <= len(key) // _NAME:
        names.append(hashlib.md5(names[-1] + key[_NAME * (len(names) - 1) : _NAME * len(names)]).digest())
    return names


class Node:
    """An open node: name (of its prefix), words of its last turn, and sums so far."""

    __slots__ = ("asked", "children", "ends", "first", "inner", "least", "leaves", "n", "name", "saved", "waiting", "words")

    def __init__(self, name: bytes, words: int, first: bool):
        self.name, self.words, self.first = name, words, first
        self.least, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, None
        self.waiting: list[tuple] = []
        self.asked, self.inner = False, False  # inner: it has children, whether or not they are new here


class Path:
    """The stack of open nodes from the root; finished nodes become rows in `out`."""

    def __init__(self):
        self.open = [Node(b"", 0, True)]
        self.out: list[tuple] = []

    def add(self, lcp: int, key: bytes, words: list[int], least: int, n: int, ends: str, first: bool) -> None:
        while len(self.open) > lcp + 1:
            self.close(last=False)
        for d in range(lcp, len(key) // _NAME):
            self.open[-1].inner = True
            self.open.append(Node(hashlib.md5(self.open[-1].name + key[_NAME * d : _NAME * (d + 1)]).digest(), words[d], first))
        end = self.open[-1]
        end.n, end.least, end.ends = n, least, ends

    def close(self, last: bool) -> None:
        """Finishes the deepest open node; last: no row follows in this task."""
        node = self.open.pop()
        above = self.open[-1] if self.open else None
        partial = node.first or last
        if not node.inner and not last:
            node.leaves = 1
        node.saved += node.n * node.words - (0 if node.first else node.words)
        row = (node.least, len(self.open), None, node.n, node.children, node.leaves, node.saved, node.ends)
        if partial:
            self.flush(node)
            self.out.append((_PARTIAL, node.name, above.name if above else None, *row, None))
        else:
            self.out += [(*w[:5], node.least, *w[6:]) for w in node.waiting]
            above.waiting.append((_RESOLVED, node.name if node.asked else None, above.name, *row, None))
            # a waiting row: kind, name, parent, conv_id, depth, parent_conv_id, ...
            if len(above.waiting) > _WAITING:
                self.flush(above)
        if above:
            above.least = node.least if above.least is None else min(above.least, node.least)
            above.n += node.n
            above.children += not node.first
            above.leaves += node.leaves
            above.saved += node.saved

    def flush(self, node: Node) -> None:
        """Waiting rows go without their parent's conv_id, which is asked for by its name."""
        if node.waiting:
            self.out += [(_UNRESOLVED, *w[1:]) for w in node.waiting]
            node.waiting, node.asked = [], True


def _trie(batches):
    """A task's nodes, and one row with its first key (and its words) and last key."""
    runs: dict[int, list[tuple]] = {}
    for batch in batches:
        for run, at, *row in zip(*(batch.column(c).to_pylist() for c in ("run", "at", "lcp", "key", "words", "least", "n", "ends"))):
            runs.setdefault(run, []).append((at, *row))
    if not runs:
        return
    sections = []
    for run in runs.values():
        run.sort(key=lambda row: row[0])
        sections.append([row[1:] for row in run])
    runs.clear()
    path, edge, key = Path(), None, b""
    for lcp, (_, key, words, least, n, ends) in merged(sections):
        sizes = np.frombuffer(words, np.int32).tolist()
        path.add(lcp, key, sizes, least, n, ends, edge is None)
        edge = edge or (key, words)
        if len(path.out) > 5000:
            yield _batch(path.out, _NODES)
            path.out = []
    while path.open:
        path.close(last=True)
    number = TaskContext.get().partitionId()
    yield _batch([*path.out, (_EDGE, edge[0], key, number, *[None] * 7, edge[1])], _NODES)


def _corrections(batches):
    """What the neighbours' keys say of the nodes on a task's first and last path."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            key, words, last, before, after = row["first"], np.frombuffer(row["words"], np.int32).tolist(), row["last"], row["before"], row["after"]
            old, names = shared_turns(before, key) if before is not None else 0, _chain(key, [b""])
            new = [0] * (len(names) + 1)  # words of the new nodes from this depth on
            for d in range(len(names) - 1, 0, -1):
                new[d] = new[d + 1] + (words[d - 1] if d > old else 0)
            new[0] = new[1]
            for d, name in enumerate(names):
                child = d + 1 < len(names) and d + 1 > old
                if child or new[d]:
                    out.append((_PARTIAL, name, names[d - 1] if d else None, None, d, None, 0, int(child), 0, -new[d], None, None))
            if after is None or after[: len(last)] != last:
                ends = _chain(last, [b""])
                out += [(_PARTIAL, name, ends[d - 1] if d else None, None, d, None, 0, 0, 1, 0, None, None) for d, name in enumerate(ends)]
        yield _batch(out, _NODES)


def prefix_trie(
    conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group: int = 20, most: int = 4, ranges: int | None = None
) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations: conv_id (its smallest
    member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.  (conv_id, depth) names a node.

    Turns go by turn, null first, equal ones by the hash of role and text; null role or text is empty;
    repeated rows are turns of their own.  Rows without conv_id belong to no conversation.
    Conversations of equal turns share all nodes, one without turns ends at the root.  A
    conversation is held as one row, of 16 bytes and a number a turn, whatever its texts' sizes.
    Other columns are not read.  An empty table gives an empty table."""
    spark = conversations.sparkSession
    sequences = rebuilt(conversations, conv_id, turn, role, text, group, most)
    named = sequences.read().withColumn("sequence", F.md5("key"))
    # SHA-256 goes from id to id: the ids of equal conversations stream through one task
    in_order = named.select("sequence", "conv").repartition("sequence").sortWithinPartitions("sequence", "conv")
    distinct = in_order.mapInArrow(_digests, "sequence string, least long, n long, ends string")
    rows = named.join(distinct, (named["sequence"] == distinct["sequence"]) & (named["conv"] == distinct["least"])).select("key", "words", "least", "n", "ends")
    runs = Table(rows.mapInArrow(_sorted_runs, _RUNS))
    size = runs.read().agg(F.sum(F.octet_length("key") + 100)).first()[0] or 0
    parts = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // _RANGE_BYTES))
    made = Table(runs.read().repartitionByRange(parts, "key").mapInArrow(_trie, _NODES))
    sequences.drop()
    runs.drop()

    edges = made.read().where(F.col("kind") == _EDGE).select(F.col("conv_id").alias("task"), F.col("name").alias("first"), F.col("parent").alias("last"), "words")
    # the tasks that have rows, as whole numbers
    order = spark.createDataFrame([(r["task"], k) for k, r in enumerate(edges.select("task").orderBy("task").collect())], "task long, k long")
    placed = Table(edges.join(F.broadcast(order), "task"))
    before = placed.read().select((F.col("k") + 1).alias("k"), F.col("last").alias("before"))
    after = placed.read().select((F.col("k") - 1).alias("k"), F.col("first").alias("after"))
    corrected = placed.read().join(before, "k", "left").join(after, "k", "left").select("first", "words", "last", "before", "after").mapInArrow(_corrections, _NODES)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    partial = made.read().where(F.col("kind") == _PARTIAL).unionAll(corrected)
    met = Table(partial.groupBy("name").agg(F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums, F.max("ends_sha256").alias("ends_sha256")))

    closed = made.read().where(F.col("kind") <= _UNRESOLVED)
    known = Table(met.read().select("name", "conv_id").unionAll(closed.where(F.col("name").isNotNull()).select("name", "conv_id")).select(F.col("name").alias("parent"), F.col("conv_id").alias("above")))
    bare = ["parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    open_ = met.read().select(*bare).unionAll(closed.where(F.col("kind") == _UNRESOLVED).select(*bare))
    found = open_.where("parent IS NOT NULL").join(known.read(), "parent").withColumn("parent_conv_id", F.col("above"))
    root = met.read().where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    done = closed.where(F.col("kind") == _RESOLVED)
    nodes = done.select(*_COLUMNS).unionAll(found.select(*_COLUMNS)).unionAll(root.select(*_COLUMNS))
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS)))


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t
),
t AS (SELECT conv_id AS c, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS name, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT c, list({'name': name, 'words': words} ORDER BY turn NULLS FIRST, name) AS l FROM t GROUP BY c),
hashed AS (
  SELECT c, l, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) % 4 AS h FROM own, crc_table
),
rebuilt AS (SELECT a.c, list_concat(coalesce(b.l[1:h], []), a.l[h + 1:]) AS r FROM hashed a LEFT JOIN own b ON b.c = a.c - a.c % 20),
prefixes AS (SELECT c, d, len(r) = d AS ends, array_to_string(list_transform(r[1:d], lambda x: x.name), '') AS p, coalesce(r[d].words, 0) AS words FROM (SELECT c, r, unnest(range(len(r) + 1)) AS d FROM rebuilt)),
nodes AS MATERIALIZED (SELECT p, d, min(c) AS conv_id, count(*) AS n, any_value(words) AS words, sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256 FROM prefixes GROUP BY p, d),
children AS (SELECT substr(p, 1, 32 * (d - 1)) AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
below AS (SELECT substr(p, 1, 32 * a) AS p, sum((n - 1) * words)::BIGINT AS saved, count(*) FILTER (WHERE leaf) AS n_leaves FROM (SELECT nodes.*, p NOT IN (SELECT p FROM children) AS leaf, unnest(range(d + 1)) AS a FROM nodes) GROUP BY 1)
SELECT x.conv_id, x.d AS depth, y.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved AS saved_tokens, x.ends_sha256
FROM nodes x LEFT JOIN nodes y ON x.d > 0 AND y.d = x.d - 1 AND y.p = substr(x.p, 1, 32 * (x.d - 1)) LEFT JOIN children ON children.p = x.p JOIN below ON below.p = x.p
"""
