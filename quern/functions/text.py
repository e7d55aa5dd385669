"""Text rules as columns.  Lengths are in code points; spaces are those of Unicode
and the separators 0x1C to 0x1F."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .repeats import repeats_udf

SPACE = r"(?U)[\s\x1c-\x1f]"
NON_SPACE = r"(?U)[^\s\x1c-\x1f]"
HANGUL = "[가-힣]"
RUN_OF_FIVE = r"(?U)(?<!\S)(\S+)(?:\s+\1){4}(?!\S)"

#: Endings of truncated answers, and phrases of refusals.
TRUNCATED = ("...", "…", "등등", "등", "그리고")
REFUSALS = ("죄송합니다", "모르겠습니다", "확인이 어렵습니다", "sorry", "i don't know", "i'm not sure")


def strip(t: Column) -> Column:
    return F.regexp_replace(t, f"^{SPACE}+|{SPACE}+$", "")


def words(t: Column) -> Column:
    """Whitespace tokens."""
    return F.array_remove(F.split(t, SPACE + "+"), "")


def sentences(t: Column) -> Column:
    return F.split(t, r"[.!?]\s+")


def chars_of(t: Column, char_class: str) -> Column:
    """How many characters are of a class."""
    return F.length(t) - F.length(F.regexp_replace(t, char_class + "+", ""))


def missing_to_null(t: Column) -> Column:
    """An empty string counts as missing."""
    return F.nullif(t, F.lit(""))


def first_present(*columns: Column) -> Column:
    return F.coalesce(*[missing_to_null(c) for c in columns])


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def detect_language(t: Column, share: float = 0.2) -> Column:
    """ko if that share of the non-space characters is Hangul, else en."""
    return F.when(ratio(chars_of(t, HANGUL), chars_of(t, NON_SPACE)) >= share, "ko").otherwise("en")


def normalized(t: Column) -> Column:
    """Lower case, runs of space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(t), SPACE + "+", " "))


def text_hash(t: Column) -> Column:
    return F.md5(normalized(t))


def raw_hash(t: Column) -> Column:
    return F.md5(t)


def instruction_hash(instruction: Column, given: Column, output: Column) -> Column:
    return text_hash(F.concat_ws(" ", instruction, given, output))


# ------------------------------------------------------------------- predicates


def enough_words(t: Column, language: Column, korean: int = 5, other: int = 8) -> Column:
    """ko: runs of Hangul; any other language: whitespace tokens."""
    return F.when(language == "ko", F.regexp_count(t, F.lit(HANGUL + "+")) >= korean).otherwise(F.size(words(t)) >= other)


def repeated_sentence(t: Column, parts: int = 3, times: int = 3, longer_than: int = 10) -> Column:
    """Some sentence of more than that many characters stands that often in the text."""
    return repeats_udf(parts, times, longer_than)(t)


def repeated_word_run(t: Column) -> Column:
    """The same whitespace token five times in a row."""
    return t.rlike(RUN_OF_FIVE)


def url_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit(r"http[s]?://\S+"))


def digit_ratio(t: Column) -> Column:
    return ratio(chars_of(t, r"(?U)\d"), F.length(t))


def special_char_ratio(t: Column) -> Column:
    return ratio(chars_of(t, r"(?U)[^\p{L}\p{N}_\s]"), F.length(t))


def lexical_diversity(t: Column) -> Column:
    """Distinct share of the whitespace tokens; 1 for none."""
    w = words(t)
    return F.coalesce(F.try_divide(F.size(F.array_distinct(w)), F.size(w)), F.lit(1.0))


def english_share(t: Column) -> Column:
    return ratio(chars_of(t, "[A-Za-z]"), chars_of(t, r"\p{L}"))


def is_english(t: Column) -> Column:
    return (F.length(t) >= 10) & (english_share(t) > 0.8)


def meaningless(t: Column) -> Column:
    few = (F.size(words(t)) > 3) & (lexical_diversity(t) < 0.3)
    return (special_char_ratio(t) > 0.3) | (digit_ratio(t) > 0.5) | few


def truncated(t: Column) -> Column:
    out = F.lit(False)
    for ending in TRUNCATED:
        out = out | t.endswith(ending)
    return out


def refusal(t: Column) -> Column:
    says = F.lit(False)
    for phrase in REFUSALS:
        says = says | F.contains(F.lower(t), F.lit(phrase))
    return says & (F.size(words(t)) < 10)


def min_sentences(t: Column, n: int) -> Column:
    return F.size(F.filter(sentences(t), lambda s: F.length(strip(s)) > 0)) >= n


def repetition_share(t: Column) -> Column:
    return F.lit(1.0) - lexical_diversity(t)


def strip_html(t: Column) -> Column:
    """Scripts, styles, comments and tags out, the common entities decoded, space
    runs as one."""
    out = F.regexp_replace(t, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def normalize_whitespace(t: Column) -> Column:
    """Blanks and tabs as one blank, no blanks at line ends, no empty lines."""
    one = F.regexp_replace(t, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(one, r" ?\n ?", "\n"), r"\n+", "\n")


@dataclass(frozen=True)
class DocumentRules:
    """Thresholds of the document filters."""

    min_length: int = 50
    max_length: int = 5000
    min_words_korean: int = 5
    min_words_other: int = 8
    max_urls: int = 3
    max_digit_ratio: float = 0.3


#: Quality levels: the same rules, more or less strict.
LEVELS = {
    "strict": DocumentRules(100, 5000, 10, 16, 1, 0.2),
    "normal": DocumentRules(),
    "permissive": DocumentRules(20, 20000, 3, 5, 10, 0.5),
}


def document_failure(t: Column, language: Column, rules: DocumentRules = DocumentRules()) -> Column:
    """The first rule that the text breaks, cheap ones first, or null."""
    return (
        F.when(~F.length(t).between(rules.min_length, rules.max_length), "length")
        .when(~enough_words(t, language, rules.min_words_korean, rules.min_words_other), "min_words")
        .when(repeated_sentence(t), "repeated_sentence")
        .when(repeated_word_run(t), "repeated_word_run")
        .when(url_count(t) > rules.max_urls, "urls")
        .when(digit_ratio(t) > rules.max_digit_ratio, "digits")
    )


@dataclass(frozen=True)
class InstructionRules:
    min_instruction: int = 10
    max_instruction: int = 500
    min_output: int = 10
    max_output: int = 2000


def instruction_failure(instruction: Column, output: Column, rules: InstructionRules = InstructionRules()) -> Column:
    """The first rule that a pair breaks, or null."""
    return (
        F.when(~F.length(instruction).between(rules.min_instruction, rules.max_instruction), "instruction_length")
        .when(~F.length(output).between(rules.min_output, rules.max_output), "output_length")
        .when(meaningless(instruction), "instruction_pattern")
        .when(meaningless(output), "output_pattern")
        .when(repeated_sentence(output), "output_repetition")
        .when(F.size(words(output)) < 3, "output_short")
        .when(truncated(output), "output_truncated")
        .when(refusal(output), "output_refusal")
    )
