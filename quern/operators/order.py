"""Exact ranks, samples, mixes, splits and batches in a reproducible order.

A global row number by a window over a whole language or corpus is one task.

Where only the first k rows of a group are wanted (samples, mixes, splits) no row is ranked:
the key of the k-th row is found by radix refinement, and the rows up to it are a filter.  Keys
are strings of hexadecimal digits; rows are counted by their first three, the bucket that
holds the k-th row by three more, until it has few rows, which alone are sorted.  Only key
columns are read for that, and whole rows aren't shuffled at all.

Where every row needs its rank, rows fall into ordered buckets of bounded size (more digits for more
rows; a key that many rows share is divided by a hash of the whole row), are numbered inside
them, and start at the rows before the bucket, from a table of bucket counts.

Tables may have columns of any names: internal ones get names that the table doesn't have.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import Table, fresh, written

#: Least number of buckets of a whole order, and rows that one may have.
BUCKETS, ROWS = 4096, 1_000_000
_DIGITS = 3


def shuffle_key(seed: int, key: Column) -> Column:
    """The sort key of a reproducible shuffle; rows without key come first."""
    return F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), F.lit("0" * 32))


def _row_digits(df: DataFrame) -> Column:
    """Sixteen digits of a hash of the whole row: an order of rows that share a key."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.lpad(F.lower(F.hex(F.xxhash64(*plain))), 16, "0")


def _buckets(rows: int) -> int:
    return max(BUCKETS, -(-rows // ROWS))


def hash_bucket(key: Column, rows: int = 0) -> Column:
    """The bucket of a key of digits: so many of its first that buckets are small."""
    digits = _DIGITS
    while 16**digits < _buckets(rows):
        digits += 1
    return F.substring(key, 1, digits)


def position_bucket(df: DataFrame, position: str, buckets: int | None = None) -> Column:
    """Intervals between quantiles of the positions, so that each holds about as many rows
    however they lie; a driver's table of a number for each bucket, 4,096 or one for a
    million rows."""
    buckets = buckets or _buckets(df.count())
    shares = [k / buckets for k in range(1, buckets)]
    found = df.agg(F.percentile_approx(position, shares, 4 * buckets).alias("q")).first()["q"]
    bounds = sorted(set(found or ()))
    if not bounds:
        return F.lit(0)
    kind, n = df.schema[position].dataType.simpleString(), len(bounds)
    # one literal where JSON has the type, which Spark folds to a constant
    table = F.from_json(F.lit(json.dumps(bounds)), f"array<{kind}>") if kind in ("int", "bigint") else F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    # how many bounds are at or below the position, by binary search
    below = lambda at, step: (at + step <= n) & (F.get(table, at + step - 1) <= F.col(position))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(below(at, step), at + step).otherwise(at))


# ------------------------------------------------------------------ first k rows


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """The columns are equal, null to null."""
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[c])
    return out


def _kth(keys: DataFrame, groups: list[str], wanted, digits: int, most: int) -> DataFrame:
    """groups, last, ties, tied of each group that has more rows than wanted(total, every):
    the key of its last wanted row, how many of the rows with that key are wanted, and how many
    there are.  keys: the groups' columns and key, strings of that many digits."""
    whole, size = Window.partitionBy(*groups), _DIGITS
    every = keys.count()
    if every <= most:  # few rows: sorted at once
        same = keys.groupBy(*groups, "key").agg(F.count("*").alias("tied"))
        need = wanted(F.col("total"), F.lit(every)).cast("long")
        before = F.coalesce(F.sum("tied").over(whole.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = same.withColumns({"total": F.sum("tied").over(whole), "before": before}).withColumn("need", need).where("need < total")
        found = placed.where("need > before AND need <= before + tied OR need <= 0 AND before = 0")
        some = F.col("need") > 0
        none = F.lit(0).cast("long")
        return written(found.select(*groups, F.when(some, F.col("key")).otherwise("").alias("last"), F.when(some, F.col("need") - F.col("before")).otherwise(none).alias("ties"), F.when(some, F.col("tied")).otherwise(none).alias("tied")))
    counts = Table(keys.groupBy(*groups, F.substring("key", 1, size).alias("prefix")).agg(F.count("*").alias("n")))
    start = counts.read().withColumn("total", F.sum("n").over(whole))
    start = start.withColumn("need", wanted(F.col("total"), F.lit(every)).cast("long")).where("need < total")

    def holding(counted: DataFrame) -> Table:
        """The bucket of each group that has its last wanted row; need: which row of it."""
        before = F.coalesce(F.sum("n").over(whole.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return Table(counted.withColumn("before", before).where("need > before AND need <= before + n OR need <= 0 AND before = 0").select(*groups, "prefix", (F.col("need") - F.col("before")).alias("need"), "n"))

    # a window over at most 4,096 counts a group
    found = holding(start)
    counts.drop()
    while size < digits and (found.read().where("need > 0").agg(F.max("n")).first()[0] or 0) > most:
        size += _DIGITS
        at = found.read()
        rows = keys.join(at.drop("n"), _same(keys, at, groups) & (F.substring(keys["key"], 1, size - _DIGITS) == at["prefix"]) & (at["need"] > 0))
        deeper = rows.groupBy(*[keys[c] for c in groups], F.substring(keys["key"], 1, size).alias("prefix")).agg(F.max("need").alias("need"), F.count("*").alias("n"))
        next_ = holding(deeper.unionByName(at.where("need <= 0").select(*groups, "prefix", "need", "n")))
        found.drop()
        found = next_
    at = found.read()
    rows = keys.join(at.drop("n"), _same(keys, at, groups) & (F.substring(keys["key"], 1, size) == at["prefix"]) & (at["need"] > 0)).select(*[keys[c] for c in groups], "key", "need")
    same = rows.groupBy(*groups, "key").agg(F.max("need").alias("need"), F.count("*").alias("tied"))
    before = F.coalesce(F.sum("tied").over(whole.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = same.withColumn("before", before).where("need > before AND need <= before + tied").select(*groups, F.col("key").alias("last"), (F.col("need") - F.col("before")).alias("ties"), "tied")
    none = at.where("need <= 0").select(*groups, F.lit("").alias("last"), F.lit(0).cast("long").alias("ties"), F.lit(0).cast("long").alias("tied"))
    return written(last.unionByName(none))


def first_rows(df: DataFrame, groups: list[str], key: Column, digits: int, wanted, flag: str, most: int = ROWS) -> DataFrame:
    """df with a boolean column `flag`: the row is one of the first wanted(total, every) of its
    group, in order of key (so many digits), then of a hash of the row; total counts the
    group's rows, every all.  Of rows that are alike in all columns any may be taken.  df is read
    three times: it should be a scan or a written table."""
    names = fresh(df, "key", "last", "ties", "tied", "at", *[f"g{k}" for k in range(len(groups) or 1)])
    full, by = names["key"], [names[f"g{k}"] for k in range(len(groups) or 1)]
    rows = df.withColumns({full: F.concat(key, _row_digits(df)), **dict(zip(by, [F.col(g) for g in groups] or [F.lit(0)]))})
    renamed = {by[k]: (groups[k] if groups else "every") for k in range(len(by))}
    # the rule may speak of the groups by their own names
    keys = rows.select(*[F.col(b).alias(renamed[b]) for b in by], F.col(full).alias("key"))
    last = _kth(keys, list(renamed.values()), wanted, digits + 16, most)
    n, uneven = last.agg(F.count("*"), F.count_if(F.expr("tied > ties"))).first()
    last = last.select(*[F.col(renamed[b]).alias(names[f"g{k}"] + "_") for k, b in enumerate(by)], *[F.col(c).alias(names[c]) for c in ("last", "ties")])
    meets = F.lit(True)
    for b in by:
        meets = meets & F.col(b).eqNullSafe(F.col(b + "_"))
    joined = rows.join(F.broadcast(last) if n <= 100_000 else last, meets, "left")
    inside = F.coalesce(F.col(full) <= F.col(names["last"]), F.lit(True))
    if not uneven:
        return joined.withColumn(flag, inside).select(*[f"`{c}`" for c in df.columns], flag)
    at_last = F.coalesce(F.col(full) == F.col(names["last"]), F.lit(False))
    number = F.row_number().over(Window.partitionBy(*by).orderBy(full))
    alike = joined.where(at_last).withColumn(names["at"], number).withColumn(flag, F.col(names["at"]) <= F.col(names["ties"]))
    columns = [*[f"`{c}`" for c in df.columns], flag]
    return joined.where(~at_last).withColumn(flag, inside).select(*columns).unionByName(alike.select(*columns))


def _first_shuffled(df: DataFrame, groups: list[str], key: str, seed: int, wanted, flag: str) -> DataFrame:
    return first_rows(df, groups, shuffle_key(seed, F.col(key)), 32, wanted, flag)


def _kept(marked: DataFrame, flag: str) -> DataFrame:
    return marked.where(F.col(flag)).drop(flag)


def position_digits(df: DataFrame, position: str) -> tuple[Column, int] | None:
    """Positions that are whole numbers as digits, null first, and how many; else None."""
    if df.schema[position].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return None
    low, high = (x or 0 for x in df.agg(F.min(position), F.max(position)).first())
    if high - low >= (1 << 63) - 1:
        return None
    width = len(f"{high - low + 1:x}")
    above = F.lpad(F.lower(F.hex(F.col(position).cast("long") - F.lit(low) + 1)), width, "0")
    return F.coalesce(above, F.lit("0" * width)), width


def head(df: DataFrame, position: str, limit: int) -> DataFrame:
    """The first `limit` rows by position.  Whole numbers: a filter, once the position of
    the last row is found; others are sorted."""
    if digits := position_digits(df, position):
        flag = fresh(df, "flag")["flag"]
        return _kept(first_rows(df, [], *digits, lambda total, every: F.lit(limit), flag), flag)
    return df.orderBy(position).limit(limit)


# -------------------------------------------------------------- ranks of all rows


def ranked(df: DataFrame, groups: list[str], order: list[Column], bucket: Column, rank: str = "rank", total: str = "total", overall: str | None = None) -> DataFrame:
    """df with each row's rank (from 1) in its group, the group's total, and if asked the
    total of all groups.  df is computed twice: it should be a scan or a written table."""
    x = fresh(df, "bucket", "n", "before", "inside")
    marked = df.withColumn(x["bucket"], bucket)
    counts = marked.groupBy(*groups, x["bucket"]).agg(F.count("*").alias(x["n"]))
    running = Window.partitionBy(*groups).orderBy(x["bucket"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # windows over the table of counts, a row for each bucket
    totals = [F.sum(x["n"]).over(Window.partitionBy(*groups)).alias(total)] + ([F.sum(x["n"]).over(Window.partitionBy(F.lit(0))).alias(overall)] if overall else [])
    before = counts.select(*groups, x["bucket"], (F.sum(x["n"]).over(running) - F.col(x["n"])).alias(x["before"]), *totals)
    inside = F.row_number().over(Window.partitionBy(*groups, x["bucket"]).orderBy(*order))
    numbered = marked.withColumn(x["inside"], inside)
    # the numbering has dealt the rows by just these columns: no further shuffle
    joined = numbered.join(before, [*groups, x["bucket"]])
    return joined.withColumn(rank, F.col(x["before"]) + F.col(x["inside"])).select(*[f"`{c}`" for c in df.columns], rank, total, *([overall] if overall else []))


def shuffled_rank(df: DataFrame, key: str, seed: int, rank: str, total: str, most: int = ROWS) -> DataFrame:
    """df with each row's place in the shuffled order, and the number of rows."""
    x = fresh(df.withColumns({rank: F.lit(0), total: F.lit(0)}), "every", "key")
    rows = df.withColumns({x["every"]: F.lit(0), x["key"]: F.concat(shuffle_key(seed, F.col(key)), _row_digits(df))})
    bucket = hash_bucket(F.col(x["key"]), df.count())
    # a key that so many rows share that its bucket is overfull: a bucket for each of its hashes
    full = [r[0] for r in rows.groupBy(bucket).count().where(F.col("count") > 4 * most).collect()]
    if full:
        bucket = F.when(bucket.isin(full), F.substring(x["key"], 1, 36)).otherwise(bucket)
    return ranked(rows, [x["every"]], [F.col(x["key"])], bucket, rank, total).drop(x["every"], x["key"])


# -------------------------------------------------------------------- operators


def sample_exact(df: DataFrame, groups: list[str], key: str, wanted: Column, seed: int = 42) -> DataFrame:
    """`wanted` rows of each group (a number, by the groups' columns), without
    replacement; all if there are fewer."""
    flag = fresh(df, "flag")["flag"]
    return _kept(_first_shuffled(df, groups, key, seed, lambda total, every: wanted, flag), flag)


def check_ratios(korean: float, english: float) -> None:
    if abs(korean + english - 1) > 0.01:
        raise ValueError("the ratios must sum to 1")


def mix_by_ratio(df: DataFrame, key: str, korean: float = 0.7, english: float = 0.3, target: int | None = None, seed: int = 42, language: str = "language") -> DataFrame:
    """int(target * ratio) rows of each language, or all it has.  Without a target
    the number of rows there are."""
    check_ratios(korean, english)
    share = F.when(F.col(language) == "ko", float(korean)).otherwise(float(english))
    flag = fresh(df, "flag")["flag"]
    return _kept(_first_shuffled(df, [language], key, seed, lambda total, every: F.floor((every if target is None else F.lit(target)) * share), flag), flag)


def mix_prefix(df: DataFrame, position: str, korean: float = 0.7, english: float = 0.3, language: str = "language") -> DataFrame:
    """The first int(rows * its share) rows of each language, in order of position (whole
    numbers or others): a share of each language, not a mix of that ratio."""
    share = F.when(F.col(language) == "ko", korean / (korean + english)).otherwise(english / (korean + english))
    x = fresh(df, "flag", "rank", "total")
    if digits := position_digits(df, position):
        return _kept(first_rows(df, [language], *digits, lambda total, every: F.floor(total * share), x["flag"]), x["flag"])
    out = ranked(df, [language], [F.col(position)], position_bucket(df, position), x["rank"], x["total"])
    return out.where(F.col(x["rank"]) <= F.floor(F.col(x["total"]) * share)).drop(x["rank"], x["total"])


def head_per_source(df: DataFrame, source: str, position: str, limit: int) -> DataFrame:
    """The first rows of each source, counted before any filter.  Each task keeps only its
    first `limit` rows of a source before anything is shuffled."""
    at = fresh(df, "rank")["rank"]
    rank = F.row_number().over(Window.partitionBy(source).orderBy(position))
    return df.withColumn(at, rank).where(F.col(at) <= limit).drop(at)


def train_val_split(df: DataFrame, key: str, train: float = 0.9, seed: int = 42) -> DataFrame:
    """split: train for the first int(train * rows) of the shuffled rows, else val."""
    flag = fresh(df, "flag")["flag"]
    marked = _first_shuffled(df, [], key, seed, lambda total, every: F.floor(total * train), flag)
    return marked.withColumn("split", F.when(F.col(flag), "train").otherwise("val")).drop(flag)


def rank_shards(df: DataFrame, key: str, world: int, epoch: int = 0, seed: int = 42) -> DataFrame:
    """shard of each row: the shuffled rows dealt out in turn, anew each epoch."""
    x = fresh(df, "rank", "total")
    return shuffled_rank(df, key, seed + epoch, x["rank"], x["total"]).withColumn("shard", ((F.col(x["rank"]) - 1) % world).cast("int")).drop(x["rank"], x["total"])


def batches(df: DataFrame, key: str, size: int, seed: int = 42, drop_last: bool = True) -> DataFrame:
    """batch number of each row; rows of an incomplete last batch go."""
    x = fresh(df, "rank", "total")
    numbered = shuffled_rank(df, key, seed, x["rank"], x["total"]).withColumn("batch", F.floor((F.col(x["rank"]) - 1) / size))
    kept = numbered.where(F.col("batch") < F.floor(F.col(x["total"]) / size)) if drop_last else numbered
    return kept.drop(x["rank"], x["total"])


def replicate(df: DataFrame, weight: str, copy: str = "copy") -> DataFrame:
    """int(weight) copies of each row, with their number; below 1 none."""
    n = F.floor(weight).cast("int")
    return df.where(n >= 1).withColumn(copy, F.explode(F.sequence(F.lit(1), n)))


def following(df: DataFrame, position: str, value: str, into: str = "next") -> DataFrame:
    """The next row's value by position, across all rows."""
    x = fresh(df, "bucket", "first", "after", "end")
    marked = df.withColumn(x["bucket"], position_bucket(df, position))
    inside = Window.partitionBy(x["bucket"]).orderBy(position)
    firsts = marked.groupBy(x["bucket"]).agg(F.min_by(value, position).alias(x["first"]))
    # a row for each bucket
    after = firsts.select(x["bucket"], F.lead(x["first"]).over(Window.orderBy(x["bucket"])).alias(x["after"]))
    joined = marked.withColumn(into, F.lead(value).over(inside)).withColumn(x["end"], F.lead(position).over(inside).isNull()).join(F.broadcast(after), x["bucket"])
    return joined.withColumn(into, F.when(F.col(x["end"]), F.col(x["after"])).otherwise(F.col(into))).select(*[f"`{c}`" for c in df.columns], into)
