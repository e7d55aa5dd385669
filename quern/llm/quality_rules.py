"""Quality rules: a threshold table compiled into one projection.

Counts come from one expression over the words of the text, the rules from a
table of integer ratios; both are built-in functions only.  Every ratio is
compared by cross-multiplication of whole numbers, so no rounding decides.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_or_empty

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Common short words of four languages.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or she that the this to was were will with you "
    "au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas pour que qui sa se ses son sont sur un une vous "
    "aber als am auch auf aus bei das dass dem den der die ein eine er es hat ich im ist mit nach nicht noch nur oder sich sie sind so und von war wie wir zu zum zur "
    "al como con del el ella ese esta este fue ha las lo los más muy no o para pero por porque sin sobre su sus también todo y ya"
).split()


class Rule(NamedTuple):
    """Of texts of at least min_words words: low <= metric / per <= high, each
    bound a pair (numerator, denominator) or None."""

    name: str
    metric: str
    per: str
    low: tuple[int, int] | None
    high: tuple[int, int] | None
    min_words: int = 10


#: The threshold table.
RULES = (
    Rule("word_length", "word_chars", "n_words", (2, 1), (20, 1)),
    Rule("symbols", "n_symbols", "n_words", None, (3, 10)),
    Rule("exclamations", "n_exclamations", "n_words", None, (1, 2)),
    Rule("capitals", "n_capitals", "word_chars", None, (2, 5)),
    Rule("stop_words", "n_stop_words", "n_words", (1, 100), None, 50),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, (1, 2)),
    Rule("table_lines", "n_bar_lines", "n_lines", None, (1, 2)),
)


def _repeated_words(words: Column, window: int) -> Column:
    """Words that lie in a window of `window` words found twice or more."""

    def covered(hashes: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - window),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]),
        )
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(of_grams(g)))

    def of_grams(grams: Column) -> Column:
        in_order = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("gram"), i.alias("at"))))
        return let(in_order, of_sorted)

    def of_sorted(pairs: Column) -> Column:
        same = lambda p, k: F.coalesce(F.get(pairs, k)["gram"] == p["gram"], F.lit(False))
        marked = F.transform(pairs, lambda p, k: F.when(same(p, k - 1) | same(p, k + 1), p["at"]))
        return let(F.sort_array(F.filter(marked, lambda at: at.isNotNull())), of_places)

    def of_places(places: Column) -> Column:
        steps = F.transform(places, lambda at, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - at, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), covered))


def metrics(text: Column, window: int = 5) -> Column:
    """A struct of all counts; null text counts as empty.  Windows for n_repeat_words are
    compared by 64-bit hashes."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda value, name: value.cast("long").alias(name)
    return let(
        F.struct(text.alias("text"), words.alias("words"), lines.alias("lines")),
        lambda x: F.struct(
            long(F.size(x["words"]), "n_words"),
            long(F.length(F.array_join(x["words"], "")), "word_chars"),
            long(F.regexp_count(x["text"], F.lit(SYMBOLS)), "n_symbols"),
            long(F.size(x["lines"]) - F.size(F.array_distinct(x["lines"])), "n_dup_lines"),
            long(let(x["words"], lambda w: _repeated_words(w, window)), "n_repeat_words"),
            long(F.size(x["lines"]), "n_lines"),
            long(F.size(F.filter(x["lines"], lambda line: F.contains(line, F.lit(" | ")))), "n_bar_lines"),
            long(F.regexp_count(x["text"], F.lit("[A-Z]")), "n_capitals"),
            long(F.regexp_count(x["text"], F.lit("!")), "n_exclamations"),
            long(F.size(F.filter(x["words"], lambda w: F.lower(w).isin(STOP_WORDS))), "n_stop_words"),
        ),
    )


def _passes(rule: Rule, counts: Column) -> Column:
    ok = F.lit(True)
    if rule.low:
        ok = ok & (counts[rule.metric] * rule.low[1] >= counts[rule.per] * rule.low[0])
    if rule.high:
        ok = ok & (counts[rule.metric] * rule.high[1] <= counts[rule.per] * rule.high[0])
    return (counts["n_words"] < rule.min_words) | ok


def judge(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "quality") -> DataFrame:
    """Every row of docs with a struct `into`: the counts, base_failed, failed (the
    names of the rules not met) and kept.

    Null and empty texts have no words: base_failed, not kept.  Repeated rows are
    judged alike; further columns stay (one of the name of `into` is replaced); an empty
    table gives an empty table."""
    counts = docs.withColumn(into, metrics(F.col(text)))
    c = F.col(into)
    base = (c["n_words"] < 10) | (c["n_repeat_words"] * 100 > c["n_words"] * 20)
    failed = F.array_compact(F.array(*[F.when(~_passes(r, c), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    return counts.withColumn(into, c.withField("base_failed", base).withField("failed", failed).withField("kept", ~base & (F.size(failed) == 0)))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bar_lines", "n_capitals", "n_exclamations", "n_stop_words"]
    return judge(docs).select("doc_id", *[F.col(f"quality.{n}") for n in names], F.array_join("quality.failed", ",").alias("failed"))


def _rule_sql(rule: Rule) -> str:
    tests = [f"{rule.metric} * {rule.low[1]} >= {rule.per} * {rule.low[0]}"] if rule.low else []
    tests += [f"{rule.metric} * {rule.high[1]} <= {rule.per} * {rule.high[0]}"] if rule.high else []
    return f"CASE WHEN NOT (n_words < {rule.min_words} OR ({' AND '.join(tests)})) THEN '{rule.name}' END"


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos
  FROM (SELECT doc_id, list_filter(string_split_regex(text, '{SPACES}'), lambda x: x <> '') AS ws FROM d)
),
g AS (
  SELECT *, CASE WHEN lead(pos, 4) OVER o IS NOT NULL THEN
    [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] END AS gram
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
),
r AS (SELECT *, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice FROM g),
v AS (SELECT *, max(CASE WHEN twice THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) IS NOT NULL AS covered FROM r),
c AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (WHERE covered) AS n_repeat_words,
    count(*) FILTER (WHERE lower(word) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)})) AS n_stop_words
  FROM v GROUP BY doc_id
),
l AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (WHERE contains(line, ' | ')) AS n_bar_lines FROM l GROUP BY doc_id),
m AS (
  SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_bar_lines, 0)::BIGINT AS n_bar_lines, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_capitals,
    len(regexp_extract_all(text, '!'))::BIGINT AS n_exclamations, coalesce(n_stop_words, 0)::BIGINT AS n_stop_words
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, concat_ws(',', {", ".join(_rule_sql(r) for r in RULES)}) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept,
  n_lines, n_bar_lines, n_capitals, n_exclamations, n_stop_words, failed FROM f
"""
