"""The catalogue: every query with its SQL over the same tables.

`lang` of the documents stands in for a record's language; where a pair of languages
is asked for, en is en and all others are ko (a stand-in, not a detection)."""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import instruct as I
from ..functions import numbers as N
from ..functions import text as T
from ..functions.extract import configured_text, generic_text, instruction_fields, language_matches, text_by_source
from ..operators import bpe, dedup, instructions, metrics, order, tokens
from ..shared import shared_dir
from ..sources import readers, recipes, sinks, specs
from ..streaming import clean as streaming
from . import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _two(df: DataFrame) -> DataFrame:
    return df.withColumn("language", F.when(F.col("lang") == "en", "en").otherwise("ko"))


def _q(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _text() -> Column:
    return F.col("text")


# SQL fragments
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: length(x) > 0)"
W = WORDS.format("text")
HASH = r"md5(trim(regexp_replace(lower({0}), '\s+', ' ', 'g')))"
LANG2 = "CASE WHEN lang = 'en' THEN 'en' ELSE 'ko' END"
DETECT = r"CASE WHEN length(regexp_replace(text, '[^가-힣]', '', 'g')) >= 0.2 * greatest(1, length(regexp_replace(text, '\s', '', 'g'))) THEN 'ko' ELSE 'en' END"
MIN_WORDS = r"(CASE WHEN {1} = 'ko' THEN len(regexp_extract_all({0}, '[가-힣]+')) >= 5 ELSE len(" + WORDS + ") >= 8 END)"
R1 = r"(len(regexp_split_to_array({0}, '[.!?]\s+')) >= 3 AND len(list_filter(regexp_split_to_array({0}, '[.!?]\s+'), lambda x: length(x) > 10 AND (length({0}) - length(replace({0}, x, ''))) // length(x) >= 3)) > 0)"
URLS = r"len(regexp_extract_all({0}, 'https?://\S+'))"
DIGITS = r"coalesce(length(regexp_replace({0}, '[^0-9]', '', 'g'))::DOUBLE / nullif(length({0}), 0), 0)"
SPECIAL = r"coalesce(length(regexp_replace({0}, '[\pL\pN_\s]', '', 'g'))::DOUBLE / nullif(length({0}), 0), 0)"
DIVERSE = "coalesce(len(list_distinct(" + WORDS + "))::DOUBLE / nullif(len(" + WORDS + "), 0), 1)"
RUNS = rf"""runs AS (
  SELECT doc_id, max(n) >= 5 AS run FROM (
    SELECT doc_id, word, count(*) AS n FROM (
      SELECT doc_id, word, pos - row_number() OVER (PARTITION BY doc_id, word ORDER BY pos) AS island FROM (
        SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {W} AS w FROM documents)))
    GROUP BY doc_id, word, island) GROUP BY doc_id)"""
FAILURE = rf"""CASE WHEN NOT length(text) BETWEEN 50 AND 5000 THEN 'length'
    WHEN NOT {MIN_WORDS.format('text', 'language')} THEN 'min_words'
    WHEN {R1.format('text')} THEN 'repeated_sentence' WHEN run THEN 'repeated_word_run'
    WHEN {URLS.format('text')} > 3 THEN 'urls' WHEN {DIGITS.format('text')} > 0.3 THEN 'digits' END"""


def _marked_sql(language: str) -> str:
    return f"""WITH {RUNS},
l AS (SELECT d.*, {language} AS language, coalesce(run, false) AS run FROM documents d LEFT JOIN runs USING (doc_id)),
m AS (SELECT *, {FAILURE} AS failure FROM l),
p AS (SELECT *, {HASH.format('text')} AS h FROM m WHERE failure IS NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY source, doc_id) AS rn FROM p)"""


# ------------------------------------------------------------ cleaning documents


@query(
    _marked_sql(DETECT)
    + """
SELECT language, count(*) AS kept, sum(length(text))::BIGINT AS chars,
  (SELECT count(*) FROM m) AS total_processed, (SELECT count(*) FROM m WHERE failure IS NOT NULL) AS filtered_out,
  (SELECT count(*) FROM f WHERE rn > 1) AS duplicates_removed
FROM f WHERE rn = 1 GROUP BY language"""
)
def pretrain_clean_stats(spark, sf_dir):
    return pipelines.clean_statistics(readers.spread(_docs(spark, sf_dir).select("doc_id", "text", "source")), ["source", "doc_id"])


@query(
    _marked_sql("lang")
    + """,
c AS (SELECT (SELECT count(*) FROM m) AS total_processed, count(*) FILTER (WHERE rn = 1 AND language = 'ko') AS korean_texts,
  count(*) FILTER (WHERE rn = 1 AND language = 'en') AS english_texts, (SELECT count(*) FROM m WHERE failure IS NOT NULL) AS filtered_out,
  count(*) FILTER (WHERE rn > 1) AS duplicates_removed FROM f)
SELECT *, round(coalesce(korean_texts::DOUBLE / nullif(korean_texts + english_texts, 0), 0), 3) AS korean_ratio,
  round(coalesce(english_texts::DOUBLE / nullif(korean_texts + english_texts, 0), 0), 3) AS english_ratio FROM c"""
)
def pretrain_counters(spark, sf_dir):
    docs = readers.spread(_docs(spark, sf_dir).select("doc_id", "text", "source", F.col("lang").alias("language")))
    return pipelines.counters(docs, ["source", "doc_id"], detect=False)


@query(_marked_sql(DETECT) + " SELECT doc_id, language, coalesce(failure, 'passed') AS status FROM m")
def document_status(spark, sf_dir):
    return pipelines.mark(readers.spread(_docs(spark, sf_dir).select("doc_id", "text"))).select("doc_id", "language", F.coalesce("failure", F.lit("passed")).alias("status"))


@query(f"SELECT doc_id, {DETECT} AS language FROM documents")
def detect_language(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.detect_language(_text()).alias("language"))


@query("SELECT doc_id, length(text)::INT AS length FROM documents WHERE length(text) BETWEEN 50 AND 5000")
def filter_length(spark, sf_dir):
    return _docs(spark, sf_dir).where(F.length(_text()).between(50, 5000)).select("doc_id", F.length(_text()).alias("length"))


@query(f"SELECT doc_id, {MIN_WORDS.format('text', 'lang')} AS enough FROM documents")
def filter_min_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.enough_words(_text(), F.col("lang")).alias("enough"))


@query(f"SELECT doc_id, {URLS.format('text')}::INT AS urls, {URLS.format('text')} <= 3 AS kept FROM documents")
def filter_url(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.url_count(_text()).alias("urls"), (T.url_count(_text()) <= 3).alias("kept"))


@query(f"SELECT doc_id, round({DIGITS.format('text')}, 6) AS digit_ratio FROM documents")
def filter_digit_ratio(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(T.digit_ratio(_text()), 6).alias("digit_ratio"))


@query(f"SELECT doc_id, {R1.format('text')} AS repeated FROM documents")
def repeated_sentence(spark, sf_dir):
    return readers.spread(_docs(spark, sf_dir)).select("doc_id", T.repeated_sentence(_text()).alias("repeated"))


@query(f"WITH {RUNS} SELECT doc_id, coalesce(run, false) AS repeated FROM documents LEFT JOIN runs USING (doc_id)")
def repeated_word_run(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.repeated_word_run(_text()).alias("repeated"))


@query(f"SELECT doc_id, round({SPECIAL.format('text')}, 6) AS special_ratio, {SPECIAL.format('text')} > 0.3 AS dropped FROM documents")
def special_char_ratio(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(T.special_char_ratio(_text()), 6).alias("special_ratio"), (T.special_char_ratio(_text()) > 0.3).alias("dropped"))


@query(f"SELECT doc_id, round({DIVERSE.format('text')}, 6) AS diversity FROM documents")
def lexical_diversity(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(T.lexical_diversity(_text()), 6).alias("diversity"))


@query(r"""SELECT doc_id, length(text) >= 10 AND coalesce(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '[^\pL]', '', 'g')), 0), 0) > 0.8 AS english FROM documents""")
def english_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.is_english(_text()).alias("english"))


@query(r"SELECT doc_id, n, n >= 3 AS three, n >= 2 AS two FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?]\s+'), lambda x: length(trim(regexp_replace(x, '\s', ' ', 'g'))) > 0))::INT AS n FROM documents)")
def min_sentences(spark, sf_dir):
    n = F.size(F.filter(T.sentences(_text()), lambda s: F.length(T.strip(s)) > 0))
    return _docs(spark, sf_dir).select("doc_id", n.alias("n"), T.min_sentences(_text(), 3).alias("three"), T.min_sentences(_text(), 2).alias("two"))


@query(f"SELECT doc_id, round(1 - {DIVERSE.format('text')}, 6) AS repetition, 1 - {DIVERSE.format('text')} <= 0.3 AS kept FROM documents")
def max_repetition(spark, sf_dir):
    share = T.repetition_share(_text())
    return _docs(spark, sf_dir).select("doc_id", F.round(share, 6).alias("repetition"), (share <= 0.3).alias("kept"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n+', chr(10), 'g')) AS h FROM documents""")
def normalize_whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_whitespace(_text())).alias("h"))


@query(
    r"""SELECT page_id, md5(x) AS h, length(x)::INT AS n FROM (SELECT page_id, trim(regexp_replace(
  replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS x FROM pages)"""
)
def html_strip(spark, sf_dir):
    x = T.strip_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(x).alias("h"), F.length(x).alias("n"))


def _level_sql(name: str, r: T.DocumentRules) -> str:
    return rf"""SELECT doc_id, '{name}' AS level FROM documents LEFT JOIN runs USING (doc_id) WHERE length(text) BETWEEN {r.min_length} AND {r.max_length}
  AND CASE WHEN lang = 'ko' THEN len(regexp_extract_all(text, '[가-힣]+')) >= {r.min_words_korean} ELSE len({W}) >= {r.min_words_other} END
  AND NOT {R1.format('text')} AND NOT coalesce(run, false) AND {URLS.format('text')} <= {r.max_urls} AND {DIGITS.format('text')} <= {r.max_digit_ratio}"""


@query(f"WITH {RUNS} " + " UNION ALL ".join(_level_sql(k, r) for k, r in T.LEVELS.items()))
def quality_levels(spark, sf_dir):
    fits = [F.when(T.document_failure(_text(), F.col("lang"), rules).isNull(), name) for name, rules in T.LEVELS.items()]
    return readers.spread(_docs(spark, sf_dir).select("doc_id", "text", "lang")).select("doc_id", F.explode(F.array_compact(F.array(*fits))).alias("level"))


# -------------------------------------------------------------------- extraction


@query(
    """WITH r AS (
  SELECT doc_id AS id, 'news_' || source AS source, NULL AS text, text AS content, NULL AS body FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 'petitions_' || source, text, text, NULL FROM documents WHERE doc_id % 2 = 1
  UNION ALL SELECT page_id, 'reddit_pages', NULL, NULL, html FROM pages)
SELECT id, source, length(x)::INT AS n FROM (SELECT id, source, regexp_replace(CASE WHEN source LIKE 'news%' THEN coalesce(nullif(text, ''), nullif(content, ''))
  WHEN source LIKE 'petitions%' THEN nullif(content, '') ELSE coalesce(nullif(body, ''), nullif(text, '')) END, '^\\s+|\\s+$', '', 'g') AS x FROM r) WHERE x <> ''""".replace("\\\\", "\\")
)
def extract_text_by_source(spark, sf_dir):
    docs, none = _docs(spark, sf_dir), F.lit(None).cast("string")
    even = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.concat(F.lit("news_"), "source").alias("source"), none.alias("text"), _text().alias("content"), none.alias("body"), none.alias("title"))
    odd = docs.where("doc_id % 2 = 1").select(F.col("doc_id").alias("id"), F.concat(F.lit("petitions_"), "source").alias("source"), _text().alias("text"), _text().alias("content"), none.alias("body"), none.alias("title"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("reddit_pages").alias("source"), none.alias("text"), none.alias("content"), F.col("html").alias("body"), none.alias("title"))
    raw = even.unionByName(odd).unionByName(pages)
    return readers.corpus_records(raw).select("id", "source", F.length("text").alias("n"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN length(url) WHEN length(url) > 20 THEN length(url) ELSE length(html) END::INT AS n FROM pages")
def generic_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.col("url")).alias("content"), "url", "html")
    return pages.select("page_id", F.length(generic_text(pages.select("content", "url", "html"))).alias("n"))


@query(r"""SELECT doc_id, md5(x) AS h, length(x)::INT AS n FROM (SELECT doc_id, lang, substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 1000) AS x FROM documents) WHERE contains(lower(lang), 'e') AND length(x) >= 100""")
def config_extract_truncate(spark, sf_dir):
    docs = _docs(spark, sf_dir).where(language_matches(F.col("lang"), "E")).select("doc_id", configured_text(_text(), 1000).alias("x"))
    return docs.where(F.length("x") >= 100).select("doc_id", F.md5("x").alias("h"), F.length("x").alias("n"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 7")
def head_per_source(spark, sf_dir):
    return order.head_per_source(_docs(spark, sf_dir).select("source", "doc_id"), "source", "doc_id", 7)


@query("SELECT source, doc_id FROM (SELECT CASE WHEN lang = 'en' THEN 'english' ELSE 'other' END AS source, doc_id, text, row_number() OVER (PARTITION BY lang = 'en' ORDER BY doc_id) AS rn FROM documents) WHERE (source <> 'english' OR rn <= 25) AND length(text) > 50")
def fixed_sources(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    frames = {"english": docs.where("lang = 'en'"), "other": docs.where("lang <> 'en'")}
    return readers.fixed_sources(frames, {"english": 25}, "doc_id").where(F.length("text") > 50).select("source", "doc_id")


@query("SELECT md5(text) AS h FROM (SELECT * FROM (SELECT doc_id, text FROM documents WHERE lang <> 'en' ORDER BY doc_id LIMIT 5000) UNION ALL SELECT * FROM (SELECT doc_id, text FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 5000)) WHERE length(text) > 100")
def tokenizer_sample(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    return readers.tokenizer_sample(docs.where("lang <> 'en'"), docs.where("lang = 'en'"), "doc_id", spark).select(F.md5(_text()).alias("h"))


_SPECS = [specs.SourceSpec(f"src{k}", priority=(k * 7) % 5, enabled=k % 4 != 3, license_type="cc" if k % 2 else "mit", commercial_use=k % 3 != 0, description=f"source {k}") for k in range(20)]
_SPEC_VALUES = ", ".join(f"({k}, '{s.name}', '{s.description}', {s.enabled}, {s.priority}, '{s.license_type}', {s.commercial_use})" for k, s in enumerate(_SPECS))
_REGISTRY = f"(VALUES {_SPEC_VALUES}) AS r(pos, name, description, enabled, priority, license, commercial_use)"


#: One row a source of the documents, in order of its first document; some leave their settings out.
_SOURCES = """(SELECT source AS name, 'from document ' || pos AS description, CASE WHEN pos % 6 <> 0 THEN pos % 4 <> 3 END AS enabled, CASE WHEN pos % 7 <> 0 THEN (pos * 7) % 5 END::INT AS priority,
  CASE WHEN pos % 2 = 1 THEN 'cc' ELSE 'mit' END AS license, pos % 3 <> 0 AS commercial_use, pos FROM (SELECT source, min(doc_id) AS pos FROM documents GROUP BY source)) AS r"""


def _sources(spark, sf_dir):
    pos = F.col("position")
    return _docs(spark, sf_dir).groupBy("source").agg(F.min("doc_id").alias("position")).select(
        "position", F.col("source").alias("name"), F.concat(F.lit("from document "), pos.cast("string")).alias("description"),
        F.when(pos % 6 != 0, pos % 4 != 3).alias("enabled"), F.when(pos % 7 != 0, pos * 7 % 5).cast("int").alias("priority"),
        F.when(pos % 2 == 1, "cc").otherwise("mit").alias("license"), (pos % 3 != 0).alias("commercial_use"),
    )


@query(f"SELECT name, priority, license, row_number() OVER (ORDER BY coalesce(priority, 999), pos)::INT AS place FROM {_SOURCES} WHERE coalesce(enabled, true)")
def source_registry(spark, sf_dir):
    active = specs.active_frame(_sources(spark, sf_dir))
    # the registry is a table of settings, one row a source
    place = F.row_number().over(Window.orderBy(F.coalesce("priority", F.lit(999)), "position"))
    return active.select("name", "priority", "license", place.alias("place"))


@query(f"SELECT name, description, coalesce(priority, 999) AS priority, coalesce(enabled, true) AS enabled FROM {_SOURCES}")
def source_listing(spark, sf_dir):
    return specs.listing(_sources(spark, sf_dir))


@query(f"SELECT source, count(*) AS n FROM documents WHERE source IN (SELECT name FROM {_REGISTRY} WHERE commercial_use AND name NOT IN ('src2')) GROUP BY source")
def license_filter(spark, sf_dir):
    kept = specs.commercial_only(_docs(spark, sf_dir).select("source"), specs.registry_frame(spark, _SPECS), excluded=("src2",))
    return kept.groupBy("source").agg(F.count("*").alias("n"))


@query(f"SELECT name, license, commercial_use FROM {_SOURCES}")
def license_manifest(spark, sf_dir):
    return specs.license_manifest(_sources(spark, sf_dir))


@query("SELECT source, doc_id FROM (SELECT 'a' AS source, doc_id FROM documents WHERE lang = 'fr' UNION ALL SELECT 'a', doc_id FROM documents WHERE lang = 'fr' UNION ALL SELECT 'b', doc_id FROM documents WHERE lang = 'es')")
def merge_weighted(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "lang")
    one = lambda lang: docs.where(F.col("lang") == lang).select("doc_id")
    return recipes.merge_weighted({"a": (one("fr"), 2.7), "b": (one("es"), 1.0), "c": (one("de"), 0.5)}).select("source", "doc_id")


# ------------------------------------------------------------------------- dedup


@query(f"SELECT doc_id, copies FROM (SELECT doc_id, row_number() OVER o AS rn, count(*) OVER (PARTITION BY {HASH.format('text')}) AS copies FROM documents WINDOW o AS (PARTITION BY {HASH.format('text')} ORDER BY source, doc_id)) WHERE rn = 1")
def exact_dedup(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "source", T.text_hash(_text()).alias("h"))
    return dedup.keep_first(docs, [F.col("h")], ["source", "doc_id"], "copies").select("doc_id", "copies")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, md5(text) ORDER BY source, doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_per_language(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "lang", "source", T.raw_hash(_text()).alias("h"))
    return dedup.keep_first(docs, [F.col("lang"), F.col("h")], ["source", "doc_id"]).select("doc_id", "lang")


@query(f"SELECT source, count(*) AS seen, count(DISTINCT {HASH.format('text')}) AS \"unique\", count(*) - count(DISTINCT {HASH.format('text')}) AS removed FROM documents GROUP BY source")
def dedup_by_source_stats(spark, sf_dir):
    return dedup.duplicate_statistics(_docs(spark, sf_dir), T.text_hash(_text()), "source")


@query(f"SELECT count(*) AS n, count(DISTINCT md5(text)) AS raw_unique, count(DISTINCT {HASH.format('text')}) AS normalized_unique FROM documents")
def raw_vs_normalized_dup(spark, sf_dir):
    kinds = F.array(F.struct(F.lit("raw").alias("kind"), T.raw_hash(_text()).alias("h")), F.struct(F.lit("normalized").alias("kind"), T.text_hash(_text()).alias("h")))
    keys = _docs(spark, sf_dir).select(F.explode(kinds).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    one = lambda kind, value: F.sum(F.when(F.col("k.kind") == kind, value).otherwise(0))
    return keys.agg(one("raw", F.col("n")).alias("n"), one("raw", F.lit(1)).alias("raw_unique"), one("normalized", F.lit(1)).alias("normalized_unique"))


# ------------------------------------------------------------ order and sampling

_RANKED = f"(SELECT doc_id, {LANG2} AS language, row_number() OVER (PARTITION BY {LANG2} ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER () AS total FROM documents)"
_SHUFFLED = "(SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER () AS total FROM documents)"


@query(f"SELECT doc_id, language FROM {_RANKED} WHERE rn <= CASE WHEN language = 'ko' THEN floor(total * 0.7::DOUBLE) ELSE floor(total * 0.3::DOUBLE) END")
def mix_by_ratio(spark, sf_dir):
    return order.mix_by_ratio(_two(_docs(spark, sf_dir)).select("doc_id", "language"), "doc_id")


@query(f"SELECT doc_id, language FROM {_RANKED} WHERE rn <= 60")
def sample_exact(spark, sf_dir):
    return order.sample_exact(_two(_docs(spark, sf_dir)).select("doc_id", "language"), ["language"], "doc_id", F.lit(60))


@query(f"SELECT doc_id, language FROM (SELECT doc_id, {LANG2} AS language, row_number() OVER (PARTITION BY {LANG2} ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY {LANG2}) AS n FROM documents) WHERE rn <= floor(n * CASE WHEN language = 'ko' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END)")
def mix_prefix(spark, sf_dir):
    return order.mix_prefix(_two(_docs(spark, sf_dir)).select("doc_id", "language"), "doc_id")


@query(f"SELECT doc_id, CASE WHEN rn <= floor(total * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM {_SHUFFLED}")
def train_val_split(spark, sf_dir):
    return order.train_val_split(_docs(spark, sf_dir).select("doc_id"), "doc_id")


@query(f"SELECT doc_id, CASE WHEN rn <= floor(total * 0.99::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM {_SHUFFLED}")
def validation_split(spark, sf_dir):
    return order.train_val_split(_docs(spark, sf_dir).select("doc_id"), "doc_id", 0.99)


@query(f"SELECT doc_id, ((rn - 1) % 8)::INT AS shard FROM {_SHUFFLED}")
def rank_shard(spark, sf_dir):
    return order.rank_shards(_docs(spark, sf_dir).select("doc_id"), "doc_id", 8)


@query(f"SELECT doc_id, (rn - 1) // 32 AS batch FROM {_SHUFFLED} WHERE (rn - 1) // 32 < total // 32")
def batch_drop_last(spark, sf_dir):
    return order.batches(_docs(spark, sf_dir).select("doc_id"), "doc_id", 32)


@query("SELECT doc_id, unnest(range(1, n + 1))::INT AS copy FROM (SELECT doc_id, floor((doc_id % 7) * 0.5)::BIGINT AS n FROM documents)")
def weighted_replication(spark, sf_dir):
    return order.replicate(_docs(spark, sf_dir).select("doc_id", ((F.col("doc_id") % 7) * 0.5).alias("w")), "w").select("doc_id", "copy")


# ------------------------------------------------------------------ instructions

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_PAIRS = f"""pairs AS (SELECT conv_id, {_STRIP.format('max(CASE WHEN rn = 1 THEN text END)')} AS instruction, {_STRIP.format('max(CASE WHEN rn = 2 THEN text END)')} AS output
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id HAVING max(rn) >= 2)"""
_IHASH = HASH.format("(instruction || '  ' || output)")


def _pairs(spark, sf_dir):
    return instructions.pairs(table(spark, sf_dir, "conversations"))


def _rows(spark, sf_dir):
    language = F.when(F.col("conv_id") % 3 == 0, "ko").otherwise("en")
    return _pairs(spark, sf_dir).select("conv_id", "instruction", F.lit("").alias("input"), "output", language.alias("language"), F.lit("chat").alias("source"))


_ROWS = f"{_PAIRS}, rows AS (SELECT conv_id, instruction, '' AS input, output, CASE WHEN conv_id % 3 = 0 THEN 'ko' ELSE 'en' END AS language, 'chat' AS source FROM pairs)"


@query(f"WITH {_PAIRS} SELECT conv_id, md5(instruction) AS i, md5(output) AS o FROM pairs")
def instruction_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", F.md5("instruction").alias("i"), F.md5("output").alias("o"))


def _meaningless(x: str) -> str:
    return f"({SPECIAL.format(x)} > 0.3 OR {DIGITS.format(x)} > 0.5 OR (len({WORDS.format(x)}) > 3 AND {DIVERSE.format(x)} < 0.3))"


_STATUS = (
    f"""CASE WHEN NOT length(instruction) BETWEEN 10 AND 500 THEN 'instruction_length' WHEN NOT length(output) BETWEEN 10 AND 2000 THEN 'output_length'
  WHEN {_meaningless('instruction')} THEN 'instruction_pattern' WHEN {_meaningless('output')} THEN 'output_pattern' WHEN {R1.format('output')} THEN 'output_repetition'
  WHEN len({WORDS.format('output')}) < 3 THEN 'output_short' WHEN {" OR ".join(f"ends_with(output, '{e}')" for e in T.TRUNCATED)} THEN 'output_truncated'
  WHEN ({" OR ".join("contains(lower(output), '" + p.replace("'", "''") + "')" for p in T.REFUSALS)}) AND len({WORDS.format('output')}) < 10 THEN 'output_refusal' ELSE 'passed' END"""
)


@query(f"WITH {_PAIRS} SELECT conv_id, {_STATUS} AS status FROM pairs")
def instruction_quality(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", F.coalesce(T.instruction_failure(F.col("instruction"), F.col("output")), F.lit("passed")).alias("status"))


@query(f"WITH {_PAIRS} SELECT conv_id, copies FROM (SELECT conv_id, row_number() OVER (PARTITION BY {_IHASH} ORDER BY conv_id) AS rn, count(*) OVER (PARTITION BY {_IHASH}) AS copies FROM pairs) WHERE rn = 1")
def instruction_dedup(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return dedup.keep_first(rows, [T.instruction_hash(F.col("instruction"), F.col("input"), F.col("output"))], ["conv_id"], "copies").select("conv_id", "copies")


@query(f"WITH {_PAIRS} SELECT count(*) AS total, count(*) FILTER (WHERE instruction <> '' AND output <> '') AS valid FROM pairs")
def instruction_validity(spark, sf_dir):
    return _pairs(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if((T.strip(F.col("instruction")) != "") & (T.strip(F.col("output")) != "")).alias("valid"))


_TASK = "CASE " + " ".join(f"WHEN regexp_matches(lower(instruction), '{'|'.join(k)}') THEN '{name}'" for name, k in I.TASKS) + " ELSE 'general' END"


@query(f"WITH {_PAIRS} SELECT {_TASK} AS task_category, count(*) AS n FROM pairs GROUP BY 1")
def task_distribution(spark, sf_dir):
    return metrics.distribution(_pairs(spark, sf_dir).select(I.classify_task(F.col("instruction")).alias("task_category")), "task_category")


@query(
    """WITH a AS (SELECT conv_id, list(text ORDER BY turn) AS x, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)
SELECT conv_id, source, md5(i) AS i, md5(g) AS g, md5(o) AS o FROM (
  SELECT conv_id, 'ultrachat' AS source, x[1] AS i, '' AS g, x[2] AS o FROM a WHERE conv_id % 8 = 0 AND len(x) >= 2
  UNION ALL SELECT conv_id, 'evol', x[1], '', x[2] FROM a WHERE conv_id % 8 = 1 AND len(x) >= 2
  UNION ALL SELECT conv_id, 'dolly', x[1], x[2], x[2] FROM a WHERE conv_id % 8 = 2
  UNION ALL SELECT conv_id, 'oasst', x[1], '', x[2] FROM a WHERE conv_id % 8 = 3
  UNION ALL SELECT conv_id, 'alpaca', x[1], x[3], x[2] FROM a WHERE conv_id % 8 = 4
  UNION ALL SELECT conv_id, 'chatgpt', x[1], '', x[2] FROM a WHERE conv_id % 8 = 5
  UNION ALL SELECT conv_id, 'sharegpt', x[1], '', x[2] FROM a WHERE conv_id % 8 = 6 AND len(x) >= 2
  UNION ALL SELECT conv_id, 'other', x[1], coalesce(x[3], ''), x[2] FROM a WHERE conv_id % 8 = 7) WHERE i <> '' AND o <> ''""".replace("md5(i)", "md5(" + _STRIP.format("i") + ")").replace("md5(o)", "md5(" + _STRIP.format("o") + ")").replace("md5(g)", "md5(" + _STRIP.format("coalesce(g, '')") + ")")
)
def instruction_extract(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    x, k = F.col("x"), F.col("conv_id") % 8
    at = lambda i: F.get(x, F.lit(i))["text"]
    none = F.lit(None).cast("string")
    raw = turns.select(
        "conv_id", F.element_at(F.array(*[F.lit(s) for s in ("ultrachat", "evol", "dolly", "oasst", "alpaca", "chatgpt", "sharegpt", "other")]), k.cast("int") + 1).alias("source"),
        F.when(k == 0, F.transform(x, lambda m: F.struct(m["text"].alias("content")))).alias("messages"), F.when(k.isin(1, 6), F.transform(x, lambda m: F.struct(m["text"].alias("value")))).alias("conversations"),
        F.when(k.isin(2, 4, 5), at(0)).alias("instruction"), F.when(k == 4, at(2)).alias("input"), F.when(k.isin(4, 5), at(1)).alias("output"),
        F.when(k == 7, at(0)).alias("question"), F.when(k == 7, at(1)).alias("answer"), F.when(k == 2, at(1)).when(k == 7, at(2)).alias("context"), F.when(k == 2, at(1)).alias("response"),
        F.when(k == 3, at(1)).alias("text"), F.when(k == 3, at(0)).alias("parent_text"), F.when(k == 3, "assistant").otherwise(none).alias("role"),
    )
    f = raw.select("conv_id", "source", instruction_fields(raw).alias("f")).where("f IS NOT NULL")
    return f.select("conv_id", "source", F.md5("f.instruction").alias("i"), F.md5("f.input").alias("g"), F.md5("f.output").alias("o"))


@query(f"WITH {_PAIRS} SELECT conv_id, md5('### 지시사항:' || chr(10) || instruction || chr(10) || chr(10) || '### 응답:' || chr(10) || output) AS h FROM pairs")
def prompt_template(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", F.md5(I.prompt(F.col("instruction"), F.col("output"))).alias("h"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, md5(string_agg(CASE WHEN role = 'user' THEN '사용자: ' ELSE '봇: ' END || text, chr(10) ORDER BY turn) || chr(10) || '봇: ') AS h FROM k WHERE back <= 5 GROUP BY conv_id""")
def chat_prompt_last5(spark, sf_dir):
    return instructions.chat_prompts(table(spark, sf_dir, "conversations")).select("conv_id", F.md5("prompt").alias("h"))


@query("SELECT conv_id, turn, md5(trim(split_part(text, chr(10), 1))) AS h FROM conversations")
def first_line(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(I.first_line(_text())).alias("h"))


def _pick(n: int) -> str:
    return f"(('0x' || substr(md5(conv_id::VARCHAR), 1, 8))::BIGINT % {n} + 1)"


def _list(values) -> str:
    return f"[{_q(values)}]"


_CONTEXT = f"(CASE WHEN language = 'ko' THEN {_list(I.PREFIXES['ko'])} ELSE {_list(I.PREFIXES['en'])} END)[{_pick(4)}] || instruction"
_EXAMPLE = f"instruction || '. ' || (CASE WHEN language = 'ko' THEN {_list(I.EXAMPLES['ko'])} ELSE {_list(I.EXAMPLES['en'])} END)[{_pick(3)}]"


def _case(patterns) -> str:
    q = lambda s: s.replace("'", "''")
    return "CASE " + " ".join(f"WHEN regexp_matches(instruction, '{q(p)}') THEN regexp_replace(instruction, '{q(p)}', '{q(r)}', 'g')" for p, r in patterns) + " END"


_PARAPHRASE = f"CASE WHEN language = 'ko' THEN {_case(I.PARAPHRASES['ko'])} ELSE {_case(I.PARAPHRASES['en'])} END"
_FORMALITY = f"CASE WHEN language = 'ko' THEN CASE WHEN contains(instruction, '요') OR contains(instruction, '습니다') THEN {_case(I.TO_INFORMAL)} ELSE {_case(I.TO_FORMAL)} END ELSE {_case(I.POLITE_EN)} END"
_CANDIDATES = f"""c AS (SELECT * FROM (
  SELECT conv_id, 'paraphrase' AS method, {_PARAPHRASE} AS x, output, language, 'chat_paraphrased' AS source, instruction FROM rows
  UNION ALL SELECT conv_id, 'context', {_CONTEXT}, output, language, 'chat_contextualized', instruction FROM rows
  UNION ALL SELECT conv_id, 'formality', {_FORMALITY}, output, language, 'chat_formality_changed', instruction FROM rows
  UNION ALL SELECT conv_id, 'examples', {_EXAMPLE}, output, language, 'chat_with_examples', instruction FROM rows) WHERE x IS NOT NULL)"""


@query(f"WITH {_ROWS} SELECT conv_id, md5({_CONTEXT}) AS h FROM rows")
def augment_context(spark, sf_dir):
    return _rows(spark, sf_dir).select("conv_id", F.md5(I.with_context(F.col("instruction"), F.col("language"), F.col("conv_id").cast("string"))).alias("h"))


@query(f"WITH {_ROWS} SELECT conv_id, md5({_EXAMPLE}) AS h FROM rows")
def augment_examples(spark, sf_dir):
    return _rows(spark, sf_dir).select("conv_id", F.md5(I.with_examples(F.col("instruction"), F.col("language"), F.col("conv_id").cast("string"))).alias("h"))


@query(f"WITH {_ROWS} SELECT conv_id, md5({_PARAPHRASE}) AS paraphrased, md5({_FORMALITY}) AS changed FROM rows")
def paraphrase_formality(spark, sf_dir):
    i, language = F.col("instruction"), F.col("language")
    return _rows(spark, sf_dir).select("conv_id", F.md5(I.paraphrase(i, language)).alias("paraphrased"), F.md5(I.change_formality(i, language)).alias("changed"))


@query(f"WITH {_ROWS} SELECT language, greatest(0, CASE WHEN language = 'ko' THEN 600 ELSE 400 END - count(*))::BIGINT AS needed FROM rows GROUP BY language")
def augment_need(spark, sf_dir):
    counts = _rows(spark, sf_dir).groupBy("language").agg(F.count("*").alias("n"))
    return instructions.augmentation_need(counts, 1000, {"ko": 0.6, "en": 0.4})


@query(
    f"""WITH {_ROWS}, {_CANDIDATES},
n AS (SELECT *, {HASH.format("(x || '  ' || output)")} AS h, md5('42:' || conv_id || '/' || method) AS o FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY o) AS first FROM n WHERE h NOT IN (SELECT {_IHASH} FROM rows)),
r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY o, h) AS rank FROM f WHERE first = 1)
SELECT conv_id, method, source, language, md5(x) AS h FROM r WHERE rank <= CASE WHEN language = 'ko' THEN 20 ELSE 50 END"""
)
def augment_bounded(spark, sf_dir):
    more = instructions.augment(_rows(spark, sf_dir), F.when(F.col("language") == "ko", 20).otherwise(50))
    return more.select("conv_id", "method", "source", "language", F.md5("instruction").alias("h"))


# ------------------------------------------------------------------------ tokens

_COUNTS = f"counts AS (SELECT token, count(*) AS freq FROM (SELECT unnest({W}) AS token FROM documents) GROUP BY token)"


def _counts(spark, sf_dir):
    return tokens.word_counts(readers.spread(_docs(spark, sf_dir).select("text")), T.words(_text()))


@query(f"WITH {_COUNTS} SELECT token, freq FROM counts ORDER BY freq DESC, token LIMIT 100")
def word_freq_topk(spark, sf_dir):
    return _counts(spark, sf_dir).orderBy(F.desc("freq"), "token").limit(100)


@query(f"WITH {_COUNTS} SELECT token, freq, (row_number() OVER (ORDER BY freq DESC, token) + 3)::INT AS id FROM counts ORDER BY freq DESC, token LIMIT 896")
def vocab_build(spark, sf_dir):
    return tokens.vocabulary(_counts(spark, sf_dir), 1000, 4)


@query(f"WITH {_COUNTS} SELECT DISTINCT unnest(string_split(token, '')) AS char FROM counts")
def char_alphabet(spark, sf_dir):
    return tokens.alphabet(_counts(spark, sf_dir))


@query(
    f"""WITH {_COUNTS}, s AS (SELECT freq, unnest(range(1, length(token))) AS i, token FROM counts WHERE length(token) > 1)
SELECT substr(token, i, 1) AS a, substr(token, i + 1, 1) AS b, sum(freq)::BIGINT AS freq FROM s GROUP BY 1, 2"""
)
def bpe_pair_counts(spark, sf_dir):
    return tokens.pair_counts(_counts(spark, sf_dir))


@query(f"WITH {_COUNTS}, v AS (SELECT token FROM counts ORDER BY freq DESC, token LIMIT 896) SELECT sum(freq)::BIGINT AS total, sum(CASE WHEN token IN (SELECT token FROM v) THEN freq ELSE 0 END)::BIGINT AS covered, round(sum(CASE WHEN token IN (SELECT token FROM v) THEN freq ELSE 0 END)::DOUBLE / sum(freq), 6) AS ratio FROM counts")
def vocab_coverage(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return tokens.coverage(docs, T.words(_text()), tokens.vocabulary(_counts(spark, sf_dir), 1000, 4))


_ID = "(('0x' || substr(md5({0}), 1, 8))::BIGINT % 65535 + 1)"
_IDS = f"ids AS (SELECT doc_id, list_transform({W}, lambda x: {_ID.format('x')}) AS ids FROM documents)"


def _ids(spark, sf_dir):
    return readers.spread(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", tokens.hash_ids(_text()).alias("ids"))


@query(f"WITH {_IDS} SELECT doc_id, len(ids)::INT AS n, coalesce(list_sum(ids), 0)::BIGINT AS total, ids[1]::BIGINT AS first FROM ids")
def hash_token_ids(spark, sf_dir):
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, b: a + b)
    return _ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n"), total.alias("total"), F.try_element_at("ids", F.lit(1)).alias("first"))


@query(f"WITH {_IDS} SELECT doc_id, coalesce(list_sum(ids[1:128]), 0)::BIGINT AS total, least(len(ids), 128)::INT AS n_real, (128 - least(len(ids), 128))::INT AS n_ignored FROM ids")
def pad_truncate(spark, sf_dir):
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)
    padded = _ids(spark, sf_dir).select("doc_id", tokens.pad(F.col("ids"), 128).alias("p"), tokens.mask(F.col("ids"), 128).alias("m"))
    return padded.select("doc_id", add("p").alias("total"), add("m").cast("int").alias("n_real"), F.size(F.filter(tokens.labels(F.col("p")), lambda x: x == -100)).alias("n_ignored"))


@query(f"WITH {_IDS}, s AS (SELECT doc_id, ids, unnest(range(0, len(ids) - 255, 128)) AS start FROM ids WHERE len(ids) >= 256) SELECT doc_id, start::INT AS start, list_sum(ids[start + 1:start + 256])::BIGINT AS total FROM s")
def sliding_chunks(spark, sf_dir):
    made = tokens.chunks(_ids(spark, sf_dir), "ids", 256, 128)
    return made.select("doc_id", "start", F.aggregate("chunk", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query(f"WITH {_IDS}, s AS (SELECT doc_id, len(ids) + 1 AS n, unnest(range(0, len(ids) - 1022, 896)) AS start FROM ids WHERE len(ids) + 1 >= 1024) SELECT doc_id, start::INT AS start FROM s")
def overlap_chunks(spark, sf_dir):
    ended = _ids(spark, sf_dir).withColumn("ids", F.concat("ids", F.array(F.lit(0).cast("long"))))
    return tokens.chunks(ended, "ids", 1024, 1024 - 128).select("doc_id", "start")


@query(f"WITH {_IDS} SELECT doc_id, len(ids)::INT AS n FROM ids WHERE len(ids) + 2 >= 50")
def token_min_length(spark, sf_dir):
    return _ids(spark, sf_dir).where(F.size("ids") + 2 >= 50).select("doc_id", F.size("ids").alias("n"))


@query(f"WITH {_IDS}, b AS (SELECT doc_id, doc_id // 16 AS batch, len(ids) AS n FROM ids) SELECT doc_id, batch, least(max(n) OVER (PARTITION BY batch), 512)::INT AS width, least(n, 512)::INT AS n_real FROM b")
def batch_padding(spark, sf_dir):
    made = tokens.batch_pad(_ids(spark, sf_dir).withColumn("batch", F.floor(F.col("doc_id") / 16)), "ids", "batch", 512)
    return made.select("doc_id", "batch", F.size("ids").alias("width"), F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).alias("n_real"))


@query(r"""SELECT doc_id, len(x)::INT AS n, len(list_filter(x, lambda y: regexp_matches(y, '^[.!?,:;"''()\[\]{}]$')))::INT AS marks FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '([.!?,:;"''()\[\]{}])', ' \1 ', 'g'), '\s+'), lambda x: length(x) > 0) AS x FROM documents)""")
def punctuation_tokens(spark, sf_dir):
    x = _docs(spark, sf_dir).select("doc_id", tokens.punctuation_tokens(_text()).alias("x"))
    return x.select("doc_id", F.size("x").alias("n"), F.size(F.filter("x", lambda y: y.rlike(f"^{tokens.SPLIT_PUNCTUATION}$"))).alias("marks"))


_CHAR = f"""CASE WHEN unicode(c) BETWEEN 44032 AND 55203 THEN unicode(c) - 44032 + 4 WHEN unicode(c) BETWEEN 97 AND 122 THEN unicode(c) - 97 + 11176
  WHEN unicode(c) BETWEEN 65 AND 90 THEN unicode(c) - 65 + 11202 WHEN unicode(c) BETWEEN 48 AND 57 THEN unicode(c) - 48 + 11228
  WHEN contains('{tokens.CHAR_PUNCTUATION.replace("'", "''")}', c) THEN instr('{tokens.CHAR_PUNCTUATION.replace("'", "''")}', c) - 1 + 11238 ELSE 1 END"""


@query(
    f"""WITH x AS (SELECT doc_id, list_transform(string_split(text, ''), lambda c: {_CHAR}) AS ids FROM documents)
SELECT doc_id, len(ids)::INT AS n, len(list_filter(ids, lambda i: i = 1))::INT AS unknown, list_sum(ids)::BIGINT AS total, ids[1]::INT AS first FROM x"""
)
def char_token_ids(spark, sf_dir):
    ids = _docs(spark, sf_dir).select("doc_id", tokens.char_ids(_text()).alias("ids"))
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, b: a + b)
    return ids.select("doc_id", F.size("ids").alias("n"), F.size(F.filter("ids", lambda x: x == 1)).alias("unknown"), total.alias("total"), F.try_element_at("ids", F.lit(1)).cast("int").alias("first"))


@query(f"WITH {_IDS} SELECT doc_id, len(x)::INT AS n, list_sum(x)::BIGINT AS total, md5(list_aggregate(list_transform(list_filter(x, lambda y: y > 2), lambda y: CASE WHEN y = 3 THEN '[UNK]' ELSE '[' || y || ']' END), 'string_agg', ' ')) AS h FROM (SELECT doc_id, list_concat([1::BIGINT], ids, [2::BIGINT]) AS x FROM ids) WHERE len(x) > 2")
def hash_round_trip(spark, sf_dir):
    x = _docs(spark, sf_dir).select("doc_id", tokens.hash_encode(_text()).alias("x")).where(F.size("x") > 2)
    total = F.aggregate("x", F.lit(0).cast("long"), lambda a, b: a + b)
    return x.select("doc_id", F.size("x").alias("n"), total.alias("total"), F.md5(tokens.hash_decode(F.col("x"))).alias("h"))


# no Hangul stands in the documents: no word ends in a particle or an ending
_MARKS = tokens.PUNCTUATION.replace("'", "''")
_MORPHEMES = rf"""x AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{_MARKS}|[0-9]+|[a-zA-Z]+|[^\s{_MARKS[1:-1]}]+'), lambda w: CASE WHEN regexp_matches(w, '^[a-zA-Z]+$') THEN lower(w) ELSE w END) AS m FROM documents)"""


@query(f"WITH {_MORPHEMES} SELECT doc_id, (len(m) + 2)::INT AS n, len(m)::INT AS unknown, (3 + coalesce(list_sum(list_transform(m, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64536 + 1000)), 0))::BIGINT AS total FROM x")
def morpheme_encode(spark, sf_dir):
    x = readers.spread(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", tokens.morpheme_encode(_text()).alias("x"))
    total = F.aggregate("x", F.lit(0).cast("long"), lambda a, b: a + b)
    return x.select("doc_id", F.size("x").alias("n"), F.size(F.filter("x", lambda y: y >= 1000)).alias("unknown"), total.alias("total"))


#: A small vocabulary by rule: letters, then merges whose parts come before them.
_FEW_MERGES = [tuple(m.split()) for m in ("t h", "th e", "e r", "i n", "a n", "e n", "o n", "in g", "an d", "t i", "ti on", "the r", "r e", "e s", "d e", "en t", "s t", "l a", "ing s", "q u")]
_FEW_IDS = {**bpe.BPE_SPECIALS, **{c: k + 4 for k, c in enumerate("abcdefghijklmnopqrstuvwxyz")}, **{a + b: k + 30 for k, (a, b) in enumerate(_FEW_MERGES)}}
_SPELLED = "'<' || array_to_string(list_filter(string_split({}, ''), lambda c: c <> ''), '><') || '>'"
_MERGED = "{}"
for _a, _b in _FEW_MERGES:
    _MERGED = f"replace({_MERGED}, '<{_a}><{_b}>', '<{_a}{_b}>')"


@query(
    rf"""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')), ' +', ' ', 'g')) AS text FROM documents),
p AS (SELECT doc_id, list_transform(regexp_extract_all(text, ' ?[a-z]+'), lambda w: {_MERGED.format(_SPELLED.format('w'))}) AS p FROM d),
s AS (SELECT doc_id, regexp_extract_all(array_to_string(p, ''), '<([^>]*)>', 1) AS s FROM p),
v AS (SELECT map_from_entries([{', '.join(f"('{t}', {i})" for t, i in _FEW_IDS.items())}]) AS v)
SELECT doc_id, len(s) + 2 AS n, len(list_filter(s, lambda x: x = ' ')) AS unknown, md5(array_to_string(list_concat([2], list_transform(s, lambda x: coalesce(v[x], 1)), [3]), ',')) AS h FROM s, v"""
)
def bpe_encode_known(spark, sf_dir):
    """Letters of all texts by a small vocabulary; blanks before words have no id there."""
    letters = F.lower(F.regexp_replace("text", "[^a-zA-Z]+", " "))
    ids = readers.spread(_docs(spark, sf_dir)).select("doc_id", bpe.bpe_encode(letters, _FEW_IDS, _FEW_MERGES).alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), F.size(F.filter("ids", lambda x: x == 1)).cast("long").alias("unknown"), F.md5(F.array_join("ids", ",")).alias("h"))


@query(
    r"""WITH RECURSIVE words AS (
  SELECT token, count(*)::BIGINT AS freq FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS token FROM documents) GROUP BY token
),
steps AS (
  SELECT 0 AS step, NULL::VARCHAR AS a, NULL::VARCHAR AS b, NULL::BIGINT AS n,
    (SELECT list({'s': '<' || array_to_string(list_filter(string_split(token, ''), lambda c: c <> ''), '><') || '>', 'f': freq}) FROM words) AS w
  UNION ALL
  SELECT step + 1, p.a, p.b, p.n, list_transform(w, lambda x: {'s': replace(x.s, '<' || p.a || '><' || p.b || '>', '<' || p.a || p.b || '>'), 'f': x.f})
  FROM steps, LATERAL (
    SELECT z[1] AS a, z[2] AS b, sum(f)::BIGINT AS n FROM (
      SELECT x.f AS f, unnest(list_zip(s[1:len(s) - 1], s[2:])) AS z FROM (SELECT x, regexp_extract_all(x.s, '<([^>]*)>', 1) AS s FROM (SELECT unnest(w) AS x))
    ) GROUP BY 1, 2 ORDER BY n DESC, a DESC, b DESC LIMIT 1
  ) p WHERE step < 24
)
SELECT step::INT AS step, a, b FROM steps WHERE step > 0"""
)
def bpe_merges(spark, sf_dir):
    """The first merges over all words of letters, in rounds on the executors."""
    counts = tokens.word_counts(_docs(spark, sf_dir), F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0)))
    size = len(bpe.BPE_SPECIALS) + tokens.alphabet(counts).count() + 24
    merges = bpe.train_bpe(counts, size, driver_chars=0)[1]
    return spark.createDataFrame([(k + 1, *m) for k, m in enumerate(merges)], "step int, a string, b string")


@query()
def bpe_encode(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    vocab, merges = bpe.train_bpe(bpe.piece_counts(docs, _text()), 32_000)
    made = bpe.bpe_coded(docs, ["doc_id"], _text(), vocab, merges)
    return made.select("doc_id", F.size("ids").alias("n"), F.size(F.filter("ids", lambda x: x == 1)).alias("unknown"), F.md5("decoded").alias("h"))


@query(rf"WITH {_MORPHEMES} SELECT doc_id, len(m)::INT AS n, md5(regexp_replace(array_to_string(m, ' '), ' ({_MARKS})', '\1', 'g')) AS h FROM x")
def morpheme_tokenize(spark, sf_dir):
    m = readers.spread(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", tokens.morphemes(_text()).alias("m"))
    return m.select("doc_id", F.size("m").alias("n"), F.md5(tokens.morpheme_join(F.col("m"))).alias("h"))


_COMPOSED = [c for c in map(chr, range(0xC0, 0x180)) if unicodedata.normalize("NFD", c) != c]


def _decomposed(x: str) -> str:
    """Nested replacements of the composed Latin letters; the documents have no others."""
    for c in _COMPOSED:
        x = f"replace({x}, '{c}', '{unicodedata.normalize('NFD', c)}')"
    return x


@query(rf"SELECT doc_id, md5(trim(regexp_replace({_decomposed('text')}, '\s+', ' ', 'g'))) AS h FROM documents")
def nfd_normalize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tokens.nfd(_text())).alias("h"))


_PREFIX = " ".join(f"WHEN i + {n - 1} <= length(word) AND substr(word, i, {n}) IN (SELECT token FROM v) THEN {n}" for n in range(6, 0, -1))


@query(
    rf"""WITH RECURSIVE {_COUNTS}, v AS MATERIALIZED (SELECT token FROM counts ORDER BY freq DESC, token LIMIT 896),
t AS MATERIALIZED (SELECT doc_id, unnest(x) AS word, unnest(range(len(x))) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '([.!?,:;"''()\[\]{{}}])', ' \1 ', 'g'), '\s+'), lambda w: length(w) > 0) AS x FROM documents)),
w AS (SELECT DISTINCT word FROM t WHERE length(word) > 2 AND word NOT IN (SELECT token FROM v)),
walk AS (SELECT word, 1 AS i, '' AS parts FROM w UNION ALL
  SELECT word, i + size, parts || ' ' || substr(word, i, size) FROM (SELECT word, i, parts, CASE {_PREFIX} ELSE 1 END AS size FROM walk WHERE i <= length(word)))
SELECT doc_id, sum(length(p) - length(replace(p, ' ', '')) + 1)::INT AS n, md5(string_agg(p, ' ' ORDER BY pos)) AS h
FROM (SELECT doc_id, pos, coalesce(substr(k.parts, 2), t.word) AS p FROM t LEFT JOIN (SELECT word, parts FROM walk WHERE i > length(word)) k USING (word)) GROUP BY doc_id"""
)
def subword_fallback(spark, sf_dir):
    # a vocabulary of a fixed size
    vocab = {r["token"] for r in tokens.vocabulary(_counts(spark, sf_dir), 1000, 4).select("token").collect()}
    # texts without a word are left out by the text itself: a filter on the parts would split all words twice
    docs = readers.spread(_docs(spark, sf_dir).select("doc_id", "text")).where(_text().rlike(T.NON_SPACE))
    parts = docs.select("doc_id", tokens.subword_text(_text(), vocab).alias("p"))
    return parts.select("doc_id", (F.length("p") - F.length(F.replace("p", F.lit(" "), F.lit(""))) + 1).alias("n"), F.md5("p").alias("h"))


# ----------------------------------------------------------------------- metrics


@query(
    r"""WITH h AS (SELECT * FROM documents ORDER BY doc_id LIMIT 100), v AS (SELECT length(text) AS n FROM h WHERE length(regexp_replace(text, '\s', '', 'g')) > 0)
SELECT (SELECT count(*) FROM documents) AS n_docs, coalesce(avg(n), 0) AS avg_length, coalesce(min(n), 0)::INT AS min_length, coalesce(max(n), 0)::INT AS max_length,
  count(*) * 100.0::DOUBLE / (SELECT count(*) FROM h) AS valid_ratio FROM v"""
)
def dataset_profile(spark, sf_dir):
    return metrics.profile(_docs(spark, sf_dir).select("doc_id", "text"), "text", "doc_id")


@query(
    r"""WITH h AS (SELECT * FROM conversations ORDER BY conv_id * 1000 + turn LIMIT 100), p AS (SELECT (SELECT count(*) FROM conversations) AS n_docs, avg(length(text)) AS a FROM h WHERE length(regexp_replace(text, '\s', '', 'g')) > 0)
SELECT n_docs, concat_ws(',', CASE WHEN a < 50 THEN 'short_texts' END, CASE WHEN n_docs < 100 THEN 'few_documents' END) AS issues,
  CASE WHEN n_docs < 1000 THEN 'more_data_recommended' WHEN n_docs < 10000 THEN 'enough_for_tests' ELSE 'enough_for_training' END AS advice FROM p"""
)
def quality_issues(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "text")
    found = metrics.quality_issues(metrics.profile(turns, "text", "pos"))
    return found.select("n_docs", "issues", metrics.recommendation(F.col("n_docs")).alias("advice"))


@query(f"SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars, count(*) >= 100 AS achieved, round(count(*) * 100.0::DOUBLE / 100, 1) AS achievement FROM documents GROUP BY lang")
def corpus_totals(spark, sf_dir):
    totals = _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length(_text())).cast("long").alias("chars"))
    return metrics.achievement(totals, "n", 100)


@query(f"SELECT round(avg(len({W})), 6) AS avg_words, round(avg(CASE WHEN len({W}) > 1 THEN 1 - {DIVERSE.format('text')} END), 6) AS repetition_ratio FROM documents")
def repetition_ratio(spark, sf_dir):
    return metrics.word_metrics(_docs(spark, sf_dir), "text")


@query(
    f"""WITH w AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {W} AS w FROM documents)),
g AS (SELECT word AS a, lead(word) OVER (ORDER BY doc_id, pos) AS b FROM w)
SELECT count(*) AS n_bigrams, count(DISTINCT (a, b)) AS n_distinct, round(count(DISTINCT (a, b))::DOUBLE / count(*), 6) AS ratio FROM g WHERE b IS NOT NULL"""
)
def distinct_bigrams(spark, sf_dir):
    return metrics.distinct_bigrams(readers.spread(_docs(spark, sf_dir).select("doc_id", "text")), "text", "doc_id")


@query(f"SELECT round(exp(sum(loss * n) / sum(n)), 6) AS perplexity, round(exp(avg(loss)), 6) AS batch_perplexity FROM (SELECT 1 + (doc_id % 100) / 50.0::DOUBLE AS loss, least(len({W}), 256) AS n FROM documents) WHERE n >= 10")
def perplexity_weighted(spark, sf_dir):
    rows = _docs(spark, sf_dir).select((F.lit(1) + (F.col("doc_id") % 100) / F.lit(50.0)).alias("loss"), F.size(F.slice(T.words(_text()), 1, 256)).alias("n")).where("n >= 10")  # cut to the longest sequence
    return metrics.perplexity(rows, "loss", "n")


@query(
    f"""WITH {_IDS}, w AS (SELECT doc_id, unnest(ids) AS x, unnest(range(len(ids))) AS pos FROM ids),
p AS (SELECT x % 50 AS p, lead(CASE WHEN x % 7 = 0 THEN -100 ELSE x % 50 END) OVER (PARTITION BY doc_id ORDER BY pos) AS y FROM w)
SELECT count(*) AS n, count(*) FILTER (WHERE p = y) AS correct, round(count(*) FILTER (WHERE p = y)::DOUBLE / count(*), 6) AS accuracy FROM p WHERE y <> -100"""
)
def masked_accuracy(spark, sf_dir):
    ids = _ids(spark, sf_dir)
    made = ids.select(F.transform("ids", lambda x: x % 50).alias("p"), F.transform("ids", lambda x: F.when(x % 7 == 0, -100).otherwise(x % 50)).alias("t"))
    return metrics.masked_accuracy(made, "p", "t")


@query("SELECT event_type AS name, round(sum(value), 4) AS total, round(avg(value), 6) AS average, count(*) AS count, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def timer_summary(spark, sf_dir):
    return metrics.timer_summary(table(spark, sf_dir, "events").withColumnRenamed("event_type", "name"), "name", "value")


@query("SELECT round(sum(value * (1 + event_id % 5)) / sum(1 + event_id % 5), 6) AS mean FROM events")
def running_mean(spark, sf_dir):
    return metrics.running_mean(table(spark, sf_dir, "events").select("value", (1 + F.col("event_id") % 5).alias("w")), "value", "w")


@query("SELECT round(avg(value), 6) AS avg_time, round(avg(10 + event_id % 90), 6) AS avg_tokens, round(avg(10 + event_id % 90) / avg(value), 4) AS tokens_per_second, min(value) AS min_time, max(value) AS max_time FROM events WHERE value > 0")
def benchmark_rates(spark, sf_dir):
    return metrics.benchmark_rates(table(spark, sf_dir, "events").where("value > 0").select("value", (10 + F.col("event_id") % 90).alias("n")), "value", "n")


# ------------------------------------------------------------------------ logits

_LOGITS = "l AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS token, unnest(embedding)::DOUBLE AS logit FROM embeddings)"


def _logits(spark, sf_dir):
    exploded = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "logit"))
    return exploded.withColumn("logit", F.col("logit").cast("double"))


@query(f"WITH {_LOGITS} SELECT vec_id, token FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token) AS r FROM l) WHERE r <= 5")
def top_k(spark, sf_dir):
    return metrics.top_k(_logits(spark, sf_dir), "vec_id", "logit", 5, "token").select("vec_id", "token")


@query(f"WITH {_LOGITS} SELECT vec_id, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY round(logit, 1) DESC) AS r FROM l) WHERE r <= 5 GROUP BY vec_id")
def top_k_with_ties(spark, sf_dir):
    rounded = _logits(spark, sf_dir).withColumn("logit", F.round("logit", 1))
    return metrics.top_k(rounded, "vec_id", "logit", 5, "token", with_ties=True).groupBy("vec_id").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_LOGITS}, p AS (SELECT vec_id, token, logit, exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id) AS p FROM l),
b AS (SELECT vec_id, token, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT vec_id, count(*) AS n, max(token) AS last FROM b WHERE before <= 0.9123 GROUP BY vec_id"""
)
def topp_nucleus(spark, sf_dir):
    return metrics.nucleus(_logits(spark, sf_dir), "vec_id", "logit", "token", 0.9123).groupBy("vec_id").agg(F.count("*").alias("n"), F.max("token").alias("last"))


@query(f"WITH {_LOGITS} SELECT vec_id, token, round(CASE WHEN token % 3 <> 0 THEN logit WHEN logit < 0 THEN logit * 1.2::DOUBLE ELSE logit / 1.2::DOUBLE END, 6) AS logit FROM l")
def repetition_penalty(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", "token", F.round(metrics.repetition_penalty(F.col("logit"), F.col("token") % 3 == 0, 1.2), 6).alias("logit"))


# ----------------------------------------------------------------------- numbers


@query("SELECT o_orderkey, CASE WHEN n < 1000 THEN n::VARCHAR WHEN n < 1e6 THEN printf('%.1fK', n / 1000.0) WHEN n < 1e9 THEN printf('%.1fM', n / 1e6) ELSE printf('%.1fB', n / 1e9) END AS number, CASE WHEN s < 60 THEN printf('%.1f초', s) WHEN s < 3600 THEN printf('%d분 %.1f초', floor(s / 60)::BIGINT, s - 60 * floor(s / 60)) ELSE printf('%d시간 %d분 %.1f초', floor(s / 3600)::BIGINT, floor((s % 3600) / 60)::BIGINT, s - 60 * floor(s / 60)) END AS time FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 900 ELSE (o_orderkey * o_orderkey * 7 + 13) * 1000 + 1 END AS n, o_orderkey * 0.25::DOUBLE + 0.125 AS s FROM orders)")
def format_values(spark, sf_dir):
    k = F.col("o_orderkey")
    n = F.when(k % 4 == 0, k % 900).otherwise((k * k * 7 + 13) * 1000 + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", N.format_number(n).alias("number"), N.format_time(k * F.lit(0.25) + 0.125).alias("time"))


@query("SELECT o_orderkey, round(CASE WHEN o_orderkey < 100 THEN o_orderkey / 100.0::DOUBLE ELSE greatest(0, 0.5 * (1 + cos(pi() * (o_orderkey - 100) / 900.0::DOUBLE))) END, 6) AS rate FROM orders")
def cosine_rate(spark, sf_dir):
    """Order keys stand in for steps."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(N.cosine_rate(F.col("o_orderkey"), 100, 1000), 6).alias("rate"))


# --------------------------------------------------------------------- streaming


def _stream_dirs(spark: SparkSession) -> tuple[str, str]:
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return f"{at}/out", f"{at}/checkpoint"


@query(
    _marked_sql(DETECT)
    + """
SELECT language, count(*) AS kept, count(DISTINCT h) AS hashes FROM f WHERE rn = 1 GROUP BY language"""
)
def stream_clean(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    stream = streaming.read_stream(spark, f"{sf_dir}/documents.parquet", schema).select("doc_id", "text")
    out = streaming.run_available(streaming.clean_stream(stream).select("language", "hash"), *_stream_dirs(docs.sparkSession))
    return out.groupBy("language", "hash").agg(F.count("*").alias("n")).groupBy("language").agg(F.sum("n").alias("kept"), F.count("*").alias("hashes"))


@query("SELECT date_trunc('hour', ts)::VARCHAR AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    counted = streaming.windowed_counts(table(spark, sf_dir, "events"), "ts", "1 hour", "1 hour", "event_type")
    return counted.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT user_id, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session_size, count(*) AS sessions FROM (SELECT user_id, session, count(*) AS session_size FROM s GROUP BY 1, 2) GROUP BY 1, 2"""
)
def event_sessions(spark, sf_dir):
    counted = streaming.session_counts(table(spark, sf_dir, "events"), "ts", "30 minutes", "1 hour", "user_id")
    return counted.groupBy("user_id", F.col("n").alias("session_size")).agg(F.count("*").alias("sessions"))




@query("SELECT least(25, count(*))::BIGINT AS n FROM documents")
def stream_take(spark, sf_dir):
    stream = streaming.read_stream(spark, f"{sf_dir}/documents.parquet", "doc_id long, text string, lang string, source string, n_chars long").select("doc_id")
    return streaming.run_available(streaming.take(stream, 25), *_stream_dirs(spark)).agg(F.count("*").alias("n"))


@query(
    """WITH w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events WHERE event_id % 3 = 0)
SELECT date_trunc('hour', ts)::VARCHAR AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, w
WHERE event_id % 3 < 2 OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark GROUP BY 1, 2"""
)
def stream_event_windows(spark, sf_dir):
    """Events that come in three deliveries, each over the whole time: in the third all
    windows behind the first one's watermark are closed, and their late rows are dropped."""
    events, at = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value"), f"{shared_dir(spark)}/deliveries-{uuid.uuid4().hex}"
    for delivery in range(3):
        events.where(F.col("event_id") % 3 == delivery).coalesce(1).write.mode("append").parquet(at)
    stream = streaming.read_stream(spark, at, "event_id long, ts timestamp, event_type string, value double", files_per_trigger=1)
    counted = streaming.windowed_counts(stream, "ts", "1 hour", "1 hour", "event_type")
    hours = counted.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "total")
    return streaming.run_updates(hours, *_stream_dirs(spark), ["hour", "event_type"]).select("hour", "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT doc_id, lang, md5(text) AS h FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def json_array_file(spark, sf_dir):
    """Written as one JSON array, replaced by another one, and read again."""
    at, docs = f"{_new_folder(spark)}.json", _docs(spark, sf_dir).select("doc_id", "lang", "text")
    sinks.write_json_array(docs.where("doc_id % 5 = 0"), at, position="doc_id")
    sinks.write_json_array(docs.where("doc_id % 2 = 0 OR doc_id % 3 = 0"), at, position="doc_id", force=True)
    return readers.json_array(spark, at, "doc_id long, lang string, text string").select("doc_id", "lang", F.md5("text").alias("h"))


_DELIVERED = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _deliveries(spark, sf_dir, parts: int, rows_a_file: int = 500_000) -> tuple[str, int]:
    """The events in deliveries that come one after the other, each over the whole time, and in how many files
    each: a user and hour of a delivery lies in one file, in order of event_id, and in one row group, which
    tasks never divide."""
    events, at = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"), _new_folder(spark)
    key, delivery = [F.col("user_id"), F.date_trunc("hour", "ts")], F.col("event_id") % parts
    files = max(1, events.count() // (parts * rows_a_file))
    # all deliveries have as many files, or one each, so that a trigger takes a whole one
    if files > 1 and events.select(delivery, F.pmod(F.hash(*key), F.lit(files))).distinct().count() < parts * files:
        files = 1
    for k in range(parts):
        rows = events.where(delivery == k)
        rows = rows.repartition(files, *key) if files > 1 else rows.coalesce(1)
        rows.sortWithinPartitions("event_id").write.option("parquet.block.size", 1 << 30).mode("append").parquet(at)
    return at, files


@query(
    """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts)::VARCHAR AS start, (max(ts) + INTERVAL 30 MINUTE)::VARCHAR AS last, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session"""
)
def stream_sessions(spark, sf_dir):
    """Events in three deliveries: later ones lie between, before and behind the sessions of the
    first, which grow and join in the state.  A last row far ahead closes them all."""
    (at, files), (far, one) = _deliveries(spark, sf_dir, 3), table(spark, sf_dir, "events").agg(F.max("ts"), F.max("user_id")).first()
    spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), (F.lit(far) + F.expr("INTERVAL 900 DAYS")).alias("ts"), F.lit(one + 1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value")).write.mode("append").parquet(at)
    stream = streaming.read_stream(spark, at, _DELIVERED, files_per_trigger=files)
    sessions = streaming.session_updates(stream, "ts", "30 minutes", "800 days", "user_id")
    path, checkpoint = _stream_dirs(spark)
    streaming.run_stopping(sessions, path, checkpoint)
    shown = lambda c: F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0*$", "")
    text = lambda c: F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd HH:mm:ss")).otherwise(shown(c))
    return streaming.batches_written(spark, path, sessions.schema).select("user_id", text("start").alias("start"), text("end").alias("last"), "n", F.round("total", 4).alias("total"))


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id % 4, event_id) = 1")
def stream_restarted(spark, sf_dir):
    """The first event of a user and hour, of four deliveries; the run stops after each of the first
    two and goes on from its checkpoint.  State of keys behind the watermark is dropped."""
    at, files = _deliveries(spark, sf_dir, 4)
    path, checkpoint = _stream_dirs(spark)
    schema = None
    for stop_after in (1, 1, None):
        stream = streaming.read_stream(spark, at, _DELIVERED, files_per_trigger=files).withColumn("hour", F.date_trunc("hour", "ts"))
        # a key's rows of a delivery are in one file, in order of event_id, and its first one stays
        first = stream.withWatermark("hour", "800 days").dropDuplicatesWithinWatermark(["user_id", "hour"])
        schema = first.schema
        streaming.run_stopping(first, path, checkpoint, stop_after)
    return streaming.batches_written(spark, path, schema).select("event_id", "user_id")


@query("SELECT text, 'docs' AS source, 'en' AS language FROM (SELECT trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text, lang FROM documents ORDER BY doc_id LIMIT 300) WHERE lang = 'en' AND length(text) >= 100")
def source_head(spark, sf_dir):
    """The first 300 rows of the files, then the rules."""
    spec = specs.SourceSpec("docs", path=f"{sf_dir}/documents.parquet", format="parquet", language="en", limits={"full": 300}, min_text_length=100, filter_field="lang", filter_value="en")
    return readers.read_source(spark, spec)


@query("SELECT text, 'docs' AS source, 'en' AS language FROM (SELECT trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents ORDER BY doc_id % 4, doc_id LIMIT 120) WHERE length(text) >= 100")
def source_stream_head(spark, sf_dir):
    """The documents in four deliveries, each in files in order of doc_id, read as a stream up to a limit."""
    at, docs, dirs = _new_folder(spark), _docs(spark, sf_dir), _stream_dirs(spark)
    spec = specs.SourceSpec("docs", path=at, format="parquet", language="en", limits={"full": 120}, min_text_length=100, streaming=True)
    out = None
    for delivery in range(4):
        docs.where(F.col("doc_id") % 4 == delivery).repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("append").parquet(at)
        out = readers.stream_head(spark, spec, "doc_id long, text string, lang string, source string, n_chars long", *dirs, files_per_trigger=1_000_000)
    return out


# ----------------------------------------------------------------- whole pipelines


@query(
    _marked_sql(DETECT)
    + """,
k AS (SELECT doc_id, language, text, row_number() OVER (PARTITION BY language ORDER BY md5('42:' || doc_id), doc_id) AS rank, count(*) OVER () AS every FROM f WHERE rn = 1)
SELECT doc_id, language, md5(text) AS h FROM k WHERE rank <= floor(every * CASE WHEN language = 'ko' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END)"""
)
def pretrain_corpus(spark, sf_dir):
    docs = readers.spread(_docs(spark, sf_dir).select("doc_id", "text", "source"))
    return pipelines.pretrain(docs, "doc_id", ["source", "doc_id"]).select("doc_id", "language", F.md5(_text()).alias("h"))


@query(
    _marked_sql(DETECT)
    + f""",
k AS (SELECT language, text, row_number() OVER (PARTITION BY language ORDER BY md5('42:' || doc_id), doc_id) AS rank, count(*) OVER () AS every FROM f WHERE rn = 1),
c AS (SELECT language, count(*) AS n, sum(length(text))::BIGINT AS chars FROM k WHERE rank <= floor(every * CASE WHEN language = 'ko' THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END) GROUP BY language)
SELECT language, n, chars, (SELECT count(*) FROM m) AS total_processed, (SELECT count(*) FROM f WHERE rn = 1) AS kept, 20 AS licences, 5 AS outputs FROM c"""
)
def prepared_folder(spark, sf_dir):
    """A whole run by a preset: the corpus and the files beside it, read again."""
    at = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    docs = readers.spread(_docs(spark, sf_dir).select("doc_id", "text", "source"))
    made = pipelines.prepare(docs, at, "doc_id", ["source", "doc_id"], pipelines.recipe("korean_heavy"), specs.registry_frame(spark, _SPECS))
    n_outputs = made.where("there").count()
    corpus = spark.read.parquet(f"{at}/corpus").groupBy("language").agg(F.count("*").alias("n"), F.sum("length").cast("long").alias("chars"))
    one = lambda name, schema, value: spark.read.schema(schema).json(f"{at}/{name}").agg(value).first()[0]
    return corpus.select(
        "language", "n", "chars", F.lit(one("preprocessing_stats", "total_processed long", F.sum("total_processed"))).alias("total_processed"),
        F.lit(one("language_distribution", "n long", F.sum("n"))).alias("kept"), F.lit(one("license_manifest", "name string", F.count("*"))).cast("int").alias("licences"), F.lit(n_outputs).cast("int").alias("outputs"),
    )


@query(
    f"""WITH {_PAIRS}, st AS (SELECT *, {_STATUS} AS status, row_number() OVER (PARTITION BY ({_STATUS}) = 'passed', {_IHASH} ORDER BY conv_id) AS copy FROM pairs),
rows AS (SELECT conv_id, instruction, '' AS input, output, CASE WHEN conv_id % 3 = 0 THEN 'ko' ELSE 'en' END AS language, 'chat' AS source FROM st WHERE status = 'passed' AND copy = 1),
{_CANDIDATES},
n AS (SELECT *, {HASH.format("(x || '  ' || output)")} AS h, md5('42:' || conv_id || '/' || method) AS o FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY o) AS first FROM n WHERE h NOT IN (SELECT {_IHASH} FROM rows)),
r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY o, h) AS rank FROM f WHERE first = 1),
u AS (SELECT conv_id, source, language, instruction, output FROM rows UNION ALL SELECT conv_id, source, language, x, output FROM r
  WHERE rank <= greatest(0, CASE WHEN language = 'ko' THEN 90 ELSE 60 END - (SELECT count(*) FROM rows WHERE rows.language = r.language))),
m AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY md5('42:' || conv_id || '/' || source), conv_id || '/' || source) AS place FROM u)
SELECT conv_id, source, language, md5(instruction) AS i, md5(output) AS o, {_TASK} AS task_category FROM m WHERE place <= CASE WHEN language = 'ko' THEN 90 ELSE 60 END"""
)
def instruction_build(spark, sf_dir):
    raw = _rows(spark, sf_dir)
    made = pipelines.instructions(raw, "conv_id", pipelines.InstructionConfig(target=150))
    return made.select("conv_id", "source", "language", F.md5("instruction").alias("i"), F.md5("output").alias("o"), "task_category")


@query(
    r"""WITH r AS (
  SELECT 'long_en' AS source, 'en' AS language, 2 AS priority, substr(x, 1, 2000) AS text, 100 AS least FROM d WHERE contains(lower(lang), 'en')
  UNION ALL SELECT 'fr', 'ko', 1, x, 1 FROM d WHERE contains(lower(lang), 'fr')
  UNION ALL SELECT 'every', 'ko', 3, substr(x, 1, 400), 50 FROM d
  UNION ALL SELECT 'every_en', 'en', 3, substr(x, 1, 2000), 1 FROM d),
h AS (SELECT *, md5(text) AS h FROM r WHERE length(text) >= least),
k AS (SELECT *, row_number() OVER (PARTITION BY language, h ORDER BY priority, source) AS copy FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY ('0x' || substr(h, 1, 15))::BIGINT) AS rank, count(*) OVER (PARTITION BY language) AS total FROM k WHERE copy = 1)
SELECT source, language, h FROM p WHERE rank <= floor(total * CASE WHEN language = 'ko' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END)""".replace("WITH r AS", r"WITH d AS (SELECT lang, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM documents), r AS", 1)
)
def configured_corpus(spark, sf_dir):
    at = dict(path=f"{sf_dir}/documents.parquet", format="parquet")
    sources = [
        specs.SourceSpec("long_en", language="en", priority=2, min_text_length=100, max_text_length=2000, filter_field="lang", filter_value="EN", **at),
        specs.SourceSpec("fr", language="ko", priority=1, filter_field="lang", filter_value="fr", **at),
        specs.SourceSpec("off", language="ko", priority=0, enabled=False, **at),
        specs.SourceSpec("every", language="ko", priority=3, min_text_length=50, max_text_length=400, **at),
        specs.SourceSpec("every_en", language="en", priority=3, max_text_length=2000, **at),
        specs.SourceSpec("gone", path=f"{sf_dir}/no-such-table", format="parquet"),
    ]
    return pipelines.corpus(spark, sources).select("source", "language", F.col("hash").alias("h"))


@query("SELECT lang AS language, count(*) AS n, sum(length(text))::BIGINT AS chars, sum(length(text))::BIGINT AS lengths, count(DISTINCT md5(text)) AS texts FROM documents GROUP BY lang")
def json_corpus(spark, sf_dir):
    """Written as JSON lines in folders by language, and read again."""
    at = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    sinks.write_corpus(_docs(spark, sf_dir).withColumnRenamed("lang", "language"), at, format="json")
    back = readers.json_lines(spark, at, "text string, length int", glob="*.json")
    return back.groupBy("language").agg(F.count("*").alias("n"), F.sum(F.length(_text())).cast("long").alias("chars"), F.sum("length").alias("lengths"), F.count_distinct(F.md5(_text())).alias("texts"))


@query(f"WITH {_PAIRS} SELECT conv_id, md5(instruction) AS i, md5(output) AS o FROM pairs WHERE instruction <> '' AND output <> ''")
def json_instructions(spark, sf_dir):
    """Raw instruction lines: written under their source's name, read with their schema, and the fields taken by that name."""
    at = f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"
    sinks.write(_pairs(spark, sf_dir).select(F.col("conv_id").cast("string").alias("context"), "instruction", F.col("output").alias("response")), f"{at}/instruction_raw_dolly.jsonl", format="json")
    back = readers.instruction_lines(spark, at)
    f = back.select(instruction_fields(back).alias("f")).where("f IS NOT NULL")
    return f.select(F.col("f.input").cast("long").alias("conv_id"), F.md5("f.instruction").alias("i"), F.md5("f.output").alias("o"))


# --------------------------------------------------------------- sources and sinks


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/made-{uuid.uuid4().hex}"


@query("SELECT 'whole' AS kind, count(*) FILTER (WHERE doc_id % 2 = 0) AS n, sum(length(text)) FILTER (WHERE doc_id % 2 = 0)::BIGINT AS chars FROM documents UNION ALL SELECT 'corrupt', count(*) FILTER (WHERE doc_id % 2 = 1), NULL FROM documents")
def json_corrupt_lines(spark, sf_dir):
    """Every other line is cut short: those are left out by the scan and listed by another."""
    at, line = _new_folder(spark), F.to_json(F.struct("text"))
    _docs(spark, sf_dir).select(F.when(F.col("doc_id") % 2 == 0, line).otherwise(F.substring(line, F.lit(1), F.length(line) - 2)).alias("value")).write.text(at)
    whole = readers.json_lines(spark, at, "text string", glob="*.txt").agg(F.count("*").alias("n"), F.sum(F.length(_text())).cast("long").alias("chars"))
    corrupt = readers.corrupt_lines(spark, at, "text string", glob="*.txt").agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("chars"))
    return whole.select(F.lit("whole").alias("kind"), "n", "chars").unionByName(corrupt.select(F.lit("corrupt").alias("kind"), "n", "chars"))


@query("SELECT count(*) + sum(len(string_split(text, chr(10))))::BIGINT AS n, sum(length(text))::BIGINT + sum(length(replace(text, chr(10), '')))::BIGINT AS chars FROM documents")
def vocabulary_texts(spark, sf_dir):
    at, docs = _new_folder(spark), _docs(spark, sf_dir).select("text")
    sinks.write_texts(docs, f"{at}/rows.jsonl")
    sinks.write_texts(docs, f"{at}/lines.txt", as_lines=True)
    return readers.vocabulary_texts(spark, [f"{at}/rows.jsonl", f"{at}/lines.txt"]).agg(F.count("*").alias("n"), F.sum(F.length(_text())).cast("long").alias("chars"))


@query(f"SELECT md5(text) AS h FROM documents UNION ALL SELECT md5({_list(readers.FALLBACK_SENTENCES)}[k % {len(readers.FALLBACK_SENTENCES)} + 1] || ' 샘플 ' || (k + 1) || '번째 문장입니다.') FROM (SELECT unnest(range(1000)) AS k)")
def training_fallback(spark, sf_dir):
    """Two training folders: one with its file, one without, which gives the made-up rows."""
    at = _new_folder(spark)
    sinks.write_texts(_docs(spark, sf_dir), f"{at}/mixed_pretraining.jsonl")
    return readers.training_lines(spark, at).unionByName(readers.training_lines(spark, f"{at}/none")).select(F.md5(_text()).alias("h"))


@query("SELECT count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents")
def training_file(spark, sf_dir):
    at = _new_folder(spark)
    sinks.write_texts(_docs(spark, sf_dir), f"{at}/mixed_pretraining.jsonl")
    return readers.training_lines(spark, at).agg(F.count("*").alias("n"), F.sum(F.length(_text())).cast("long").alias("chars"))


@query(f"WITH {_ROWS} SELECT language, count(*)::INT AS n, count(*) FILTER (WHERE input <> '')::INT AS with_input, count(DISTINCT md5(instruction))::INT AS instructions FROM (SELECT language, input, instruction FROM rows UNION ALL SELECT 'ko', unnest(['', 'x', '']), unnest(['k1', 'k2', 'k3']) UNION ALL SELECT 'en', unnest(['', 'x', '']), unnest(['e1', 'e2', 'e3'])) GROUP BY language")
def sample_instruction_rows(spark, sf_dir):
    """The sample pairs beside those of the conversations."""
    rows = _rows(spark, sf_dir).unionByName(readers.sample_instructions(spark), allowMissingColumns=True)
    return rows.groupBy("language").agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("input") != "").cast("int").alias("with_input"), F.count_distinct(F.md5("instruction")).cast("int").alias("instructions"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, role, md5(text) AS h FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM conversations)")
def chat_round_trip(spark, sf_dir):
    at = _new_folder(spark)
    sinks.write_chats(table(spark, sf_dir, "conversations"), at)
    return readers.chat_history(spark, at, lines=True).select("conv_id", "turn", "role", F.md5(_text()).alias("h"))


@query(f"WITH {_PAIRS} SELECT {_TASK} AS task_category, count(*) AS n FROM pairs GROUP BY 1")
def task_sink(spark, sf_dir):
    at, rows = _new_folder(spark), _rows(spark, sf_dir)
    sinks.write_instructions(rows.withColumn("task_category", I.classify_task(F.col("instruction"))), at)
    return spark.read.schema("task_category string, n long").json(f"{at}/task_distribution")


@query(
    _marked_sql(DETECT)
    + """
SELECT (SELECT count(*) FROM m) AS total_processed, (SELECT count(*) FROM m WHERE failure IS NOT NULL) AS filtered_out, (SELECT count(*) FROM f WHERE rn > 1) AS duplicates_removed, true AS dated"""
)
def statistics_sink(spark, sf_dir):
    at = _new_folder(spark)
    sinks.write_statistics(pipelines.counters(readers.spread(_docs(spark, sf_dir).select("doc_id", "text", "source")), ["source", "doc_id"]), at)
    back = spark.read.schema("total_processed long, filtered_out long, duplicates_removed long, written string").json(at)
    return back.select("total_processed", "filtered_out", "duplicates_removed", F.col("written").isNotNull().alias("dated"))


@query(f"WITH {_COUNTS} SELECT token, (row_number() OVER (ORDER BY freq DESC, token) + 3)::INT AS id FROM counts ORDER BY freq DESC, token LIMIT 896")
def vocabulary_sink(spark, sf_dir):
    at = _new_folder(spark)
    vocab = {r["token"]: r["id"] for r in tokens.vocabulary(_counts(spark, sf_dir), 1000, 4).collect()}  # a vocabulary of a fixed size
    sinks.write_vocabulary(spark, vocab, [("a", "b")], at)
    back, _ = sinks.read_vocabulary(spark, at)
    return spark.createDataFrame(list(back.items()), "token string, id int")


@query("SELECT 4 AS files, true AS some_bytes, false AS again, true AS forced, (SELECT count(*) FROM documents) AS n")
def overwrite_policy(spark, sf_dir):
    """Files and bytes of a corpus written once, not again, and again by force."""
    at, docs = _new_folder(spark), _docs(spark, sf_dir).select("doc_id").repartition(4)
    sinks.write(docs, at)
    again, forced = sinks.write(docs, at), sinks.write(docs, at, force=True)
    used = sinks.disk_usage(sinks.manifest(spark, at, "*.parquet"))
    n = spark.read.parquet(at).agg(F.count("*").alias("n")).first()["n"]
    return used.select(F.col("files").cast("int").alias("files"), (F.col("bytes") > 0).alias("some_bytes"), F.lit(again).alias("again"), F.lit(forced).alias("forced"), F.lit(n).alias("n"))


@query("SELECT max(c) AS checkpoint FROM (SELECT 'checkpoint-' || user_id AS c FROM events GROUP BY user_id HAVING bool_or(event_id % 5 = 0) AND bool_or(event_id % 5 IN (1, 2)) AND user_id % 4 <> 1)")
def newest_checkpoint(spark, sf_dir):
    """Events stand in for files: a user's are those of a checkpoint, some of them without weights."""
    name = F.element_at(F.array(*[F.lit(n) for n in ("config.json", "pytorch_model.bin", "model.bin", "optimizer.pt", "log.txt")]), (F.col("event_id") % 5 + 1).cast("int"))
    weights = name.endswith(".bin") & (F.col("user_id") % 4 == 1)
    files = table(spark, sf_dir, "events").where(~weights).select(F.concat(F.lit("/m/checkpoint-"), F.col("user_id").cast("string"), F.lit("/"), name).alias("file"))
    return sinks.latest_checkpoint(files)


@query("SELECT 'docs_en' AS source, 'en' AS language, true AS written, count(*) FILTER (WHERE lang = 'en' AND length(text) >= 100) AS n FROM documents UNION ALL SELECT 'docs_fr', 'ko', true, count(*) FILTER (WHERE lang = 'fr' AND length(text) >= 1) FROM documents")
def ingest_sources(spark, sf_dir):
    at, where = _new_folder(spark), dict(path=f"{sf_dir}/documents.parquet", format="parquet", filter_field="lang")
    sources = [specs.SourceSpec("docs_en", language="en", min_text_length=100, filter_value="en", **where), specs.SourceSpec("docs_fr", language="ko", filter_value="fr", **where)]
    listed = recipes.ingest(spark, sources, at)
    counts = readers.json_lines(spark, f"{at}/*", "text string, source string, language string", glob="*.json")
    counts = counts.groupBy("language").agg(F.count("*").alias("n"))
    return listed.join(counts, "language").select("source", "language", "written", "n")


@query(f"WITH {_COUNTS}, v AS (SELECT token FROM counts ORDER BY freq DESC, token LIMIT 896) SELECT token, freq FROM counts ANTI JOIN v USING (token)")
def vocab_uncovered(spark, sf_dir):
    return tokens.uncovered(_docs(spark, sf_dir), T.words(_text()), tokens.vocabulary(_counts(spark, sf_dir), 1000, 4))


@query(
    f"""WITH {_COUNTS}, s AS (SELECT freq, unnest(range(1, length(token))) AS i, token FROM counts WHERE length(token) > 1)
SELECT substr(token, i, 1) AS a, substr(token, i + 1, 1) AS b, sum(freq)::BIGINT AS freq FROM s GROUP BY 1, 2 ORDER BY 3 DESC, 1 DESC, 2 DESC LIMIT 1"""
)
def argmax_pair(spark, sf_dir):
    return tokens.most_frequent_pair(tokens.pair_counts(_counts(spark, sf_dir)))


@query("SELECT count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents")
def text_encoding(spark, sf_dir):
    at = _new_folder(spark)
    sinks.write_texts(_docs(spark, sf_dir), at, encoding="UTF-16LE")
    back = spark.read.schema("text string").option("encoding", "UTF-16LE").option("lineSep", "\n").json(at)
    return back.agg(F.count("*").alias("n"), F.sum(F.length(_text())).cast("long").alias("chars"))


@query(rf"SELECT doc_id, 0 AS unknown, md5(regexp_replace(trim(regexp_replace({_decomposed('text')}, '\s+', ' ', 'g')), ' ([0-9])', '\1', 'g')) AS h FROM documents")
def bpe_round_trip(spark, sf_dir):
    """Decoded ids are the normalized text; a lone blank before a number is no piece."""
    docs = readers.spread(_docs(spark, sf_dir).select("doc_id", "text"))
    vocab, merges = bpe.train_bpe(bpe.piece_counts(docs, _text()), 1000)
    made = bpe.bpe_coded(docs, ["doc_id"], _text(), vocab, merges)
    return made.select("doc_id", F.size(F.filter("ids", lambda x: x == 1)).alias("unknown"), F.md5("decoded").alias("h"))


@query(
    f"""WITH {_COUNTS}, {_IDS}, top AS (SELECT token FROM counts ORDER BY freq DESC, token LIMIT 100),
k AS (SELECT map_from_entries(list((id, token))) AS known FROM (SELECT {_ID.format('token')} AS id, min(token) AS token FROM top GROUP BY 1))
SELECT doc_id, md5(list_aggregate(list_transform(list_filter(ids, lambda y: y > 2), lambda y: coalesce(known[y], CASE WHEN y = 3 THEN '[UNK]' ELSE '[' || y || ']' END)), 'string_agg', ' ')) AS h FROM ids, k WHERE len(ids) > 0"""
)
def hash_decode_known(spark, sf_dir):
    """Ids of the hundred most frequent words are shown as the word."""
    top = _counts(spark, sf_dir).orderBy(F.desc("freq"), "token").limit(100).groupBy(tokens.stable_id(F.col("token")).alias("id")).agg(F.min("token").alias("token"))
    known = {r["id"]: r["token"] for r in top.collect()}
    shown = tokens.hash_decode(F.col("x"), known)
    return readers.spread(_docs(spark, sf_dir)).select("doc_id", tokens.hash_encode(_text()).alias("x")).where(F.size("x") > 2).select("doc_id", F.md5(shown).alias("h"))


@query("SELECT asked, used, count(*) AS n, count(*) AS framed FROM documents JOIN (VALUES (0, 'korean', 'korean'), (1, 'improved_korean', 'improved_korean'), (2, 'pretrained', 'korean'), (3, 'other', 'korean')) AS t(k, asked, used) ON doc_id % 4 = k GROUP BY 1, 2")
def tokenizer_choice(spark, sf_dir):
    """A quarter of the documents goes through each encoder that may be asked for."""
    docs, parts = _docs(spark, sf_dir), []
    for k, kind in enumerate(("korean", "improved_korean", "pretrained", "other")):
        used, encode = tokens.choose(kind)
        ids = docs.where(F.col("doc_id") % 4 == k).select(encode(_text()).alias("x"))
        framed = F.count_if((F.get("x", F.lit(0)) == 1) & (F.element_at("x", -1) == 2))
        parts.append(ids.select(F.lit(kind).alias("asked"), F.lit(used).alias("used"), "x").groupBy("asked", "used").agg(F.count("*").alias("n"), framed.alias("framed")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    """SELECT p_partkey, concat_ws('; ', CASE WHEN n_heads IS NULL THEN 'missing: n_heads' END, CASE WHEN batch_size IS NULL THEN 'missing: batch_size' END, CASE WHEN vocab_size <= 0 THEN 'must be positive: vocab_size' END,
  CASE WHEN rate <= 0 THEN 'must be positive: learning_rate' END, CASE WHEN n_heads <> 0 AND p_size % n_heads <> 0 THEN 'd_model must be a multiple of n_heads' END) AS errors
FROM (SELECT p_partkey, p_size, p_partkey % 5 AS vocab_size, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 4 END AS n_heads, p_retailprice - 901 AS rate, CASE WHEN p_partkey % 3 <> 0 THEN 4 END AS batch_size FROM part)"""
)
def config_check(spark, sf_dir):
    """Parts stand in for settings of runs."""
    k = F.col("p_partkey")
    runs = table(spark, sf_dir, "part").select(
        "p_partkey", (k % 5).alias("vocab_size"), F.col("p_size").alias("d_model"), F.when(k % 11 != 0, k % 4).alias("n_heads"), F.lit(2).alias("n_layers"),
        F.col("p_size").alias("max_seq_len"), (F.col("p_retailprice") - 901).alias("learning_rate"), F.when(k % 3 != 0, 4).alias("batch_size"),
    )
    return runs.select("p_partkey", recipes.config_errors_of(runs).alias("errors"))


@query(
    f"""SELECT {LANG2} AS language, 'docs_' || {LANG2} AS source, CASE WHEN {LANG2} = 'ko' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS share, CASE WHEN {LANG2} = 'ko' THEN 2 ELSE 1 END AS priority,
  count(*) FILTER (WHERE length(text) > 0) AS n FROM documents GROUP BY ALL"""
)
def recipe_sources(spark, sf_dir):
    """A recipe in JSON without a ratio: its datasets read, shares by their target sizes."""
    at, docs = _new_folder(spark), _two(_docs(spark, sf_dir))
    for language in ("ko", "en"):
        sinks.write(docs.where(F.col("language") == language).select("text"), f"{at}/{language}", format="json")
    part = lambda language, size, priority: {"target_size_gb": size, "datasets": [{"name": f"docs_{language}", "path": f"{at}/{language}", "priority": priority}]}
    shares, found = recipes.load_recipe(json.dumps({"korean_component": part("ko", 6, 2), "english_component": part("en", 4, 1)}))
    rows = readers.read_sources(spark, found, strict=True).groupBy("language", "source", "priority").agg(F.count("*").alias("n"))
    share = F.when(F.col("language") == "ko", shares["ko"]).otherwise(shares["en"])
    return rows.select("language", "source", F.round(share, 6).alias("share"), "priority", "n")


#: Korean sentences with their morphemes, the text joined again, and the ids of the marks,
#: particles and endings.
_KOREAN = [
    ("나는 학교에서 공부합니다.", "나는|학교|에서|공부|합니다|.", "나는 학교에서 공부합니다.", "1,9,36,2"),
    ("집으로부터까지 갔다", "집으로부터|까지|갔다", "집으로부터까지 갔다", "1,18,2"),
    ("한다고 했습니다", "한다고|했|습니다", "한다고 했습니다", "1,32,2"),
    ("Hello 세계와 123!", "hello|세계|와|123|!", "hello 세계와 123!", "1,12,2"),
    ("이", "이", "이", "1,4,2"),
    ("학생들에게 책을", "학생들|에게|책|을", "학생들에게 책을", "1,23,6,2"),
]


@query("SELECT doc_id, text, morphemes, joined, ids FROM (SELECT doc_id FROM documents) JOIN (VALUES " + ", ".join(f"({k}, {_q(row)})" for k, row in enumerate(_KOREAN)) + f") AS t(k, text, morphemes, joined, ids) ON doc_id % {len(_KOREAN)} = k")
def morphemes_of_korean(spark, sf_dir):
    """The documents hold no Korean: each gets one of the sentences."""
    sentence = F.get(F.array(*[F.lit(t) for t, *_ in _KOREAN]), (F.col("doc_id") % len(_KOREAN)).cast("int"))
    texts = _docs(spark, sf_dir).select("doc_id", sentence.alias("text"))
    m = texts.select("doc_id", "text", tokens.morphemes(_text()).alias("m"), tokens.morpheme_encode(_text()).alias("x"))
    ids = F.array_join(F.transform(F.filter("x", lambda i: i < 1000), lambda i: i.cast("string")), ",")
    return m.select("doc_id", "text", F.array_join("m", "|").alias("morphemes"), tokens.morpheme_join(F.col("m")).alias("joined"), ids.alias("ids"))
