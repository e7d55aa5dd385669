"""Which field of a raw record holds its text, and instruction pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import first_present, missing_to_null, strip

#: Fields in the order they are tried, by part of the source's name.
TEXT_FIELDS = (
    ("wiki", ("text",)), ("news", ("text", "content")), ("petitions", ("title+content",)), ("chat", ("text", "context")),
    ("common_crawl", ("text",)), ("oscar", ("text",)), ("openwebtext", ("text",)), ("c4", ("text",)), ("pile", ("text",)),
    ("reddit", ("body", "text")),
)
OTHER_TEXT_FIELDS = ("text", "content", "body", "article")
GENERIC_TEXT_FIELDS = ("text", "content", "article", "document", "sentence", "title")


def _field(df: DataFrame, name: str) -> Column:
    if name == "title+content":
        title, content = missing_to_null(_field(df, "title")), missing_to_null(_field(df, "content"))
        return F.coalesce(F.concat(title, F.lit("\n"), content), title, content)
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def text_by_source(df: DataFrame, source: str = "source") -> Column:
    """The text field that the source's name asks for, stripped; blank is null."""
    out = None
    for part, fields in TEXT_FIELDS:
        value = first_present(*[_field(df, f) for f in fields])
        test = F.contains(F.col(source), F.lit(part))
        out = F.when(test, value) if out is None else out.when(test, value)
    value = out.otherwise(first_present(*[_field(df, f) for f in OTHER_TEXT_FIELDS]))
    return missing_to_null(strip(value))


def generic_text(df: DataFrame) -> Column:
    """The first field with a text, of the usual names; else the first string
    column with more than 20 characters."""
    strings = [F.col(c) for c, kind in df.dtypes if kind == "string"]
    named = [_field(df, f) for f in GENERIC_TEXT_FIELDS]
    long = F.get(F.filter(F.array(*strings), lambda s: F.length(s) > 20), F.lit(0)) if strings else F.lit(None).cast("string")
    return first_present(*named, long)


def configured_text(value: Column, max_length: int | None = None) -> Column:
    """Stripped, then cut to the configured length."""
    out = strip(F.coalesce(value, F.lit("")))
    return F.substring(out, 1, max_length) if max_length else out


def language_matches(field: Column, wanted: str) -> Column:
    """Case-insensitive part of a field."""
    return F.contains(F.lower(field), F.lit(wanted.lower()))


def instruction_fields(df: DataFrame, source: str = "source") -> Column:
    """struct(instruction, input, output) by the source's name, stripped; null where
    the instruction or the output is missing."""
    f = lambda name: _field(df, name)
    item = lambda name, part, i: F.try_element_at(F.col(name), F.lit(i))[part] if name in df.columns else F.lit(None).cast("string")
    pair = lambda name, part: (F.when(F.size(name) >= 2, item(name, part, 1)), F.when(F.size(name) >= 2, item(name, part, 2)))
    has = lambda name: F.col(name).isNotNull() if name in df.columns else F.lit(False)
    named = lambda *parts: [F.contains(F.col(source), F.lit(p)) for p in parts]
    row = lambda instruction, given, output: F.struct(instruction.alias("instruction"), given.alias("input"), output.alias("output"))
    none = F.lit(None).cast("string")
    conv = pair("conversations", "value") if "conversations" in df.columns else (none, none)
    msgs = pair("messages", "content") if "messages" in df.columns else (none, none)
    alpaca, (chatgpt, evol), (sharegpt, ultrachat), dolly, oasst = named("alpaca")[0], named("chatgpt", "evol"), named("sharegpt", "ultrachat"), named("dolly")[0], named("oasst")[0]
    spoken = F.coalesce(f("role") == "assistant", F.lit(False))
    value = (
        F.when(alpaca, row(f("instruction"), f("input"), f("output")))
        .when(chatgpt | evol, F.when(has("conversations"), row(conv[0], none, conv[1])).otherwise(row(f("instruction"), none, f("output"))))
        .when(sharegpt | ultrachat, F.when(has("messages"), row(msgs[0], none, msgs[1])).otherwise(row(conv[0], none, conv[1])))
        .when(dolly, row(f("instruction"), f("context"), f("response")))
        .when(oasst, F.when(spoken, row(f("parent_text"), none, f("text"))).otherwise(row(f("text"), none, f("response"))))
        .otherwise(
            row(
                first_present(f("instruction"), f("question"), f("input"), f("prompt")),
                first_present(f("input"), f("context")),
                first_present(f("output"), f("answer"), f("response"), f("completion")),
            )
        )
    )
    there = missing_to_null(value["instruction"]).isNotNull() & missing_to_null(value["output"]).isNotNull()
    return F.when(there, row(strip(value["instruction"]), strip(F.coalesce(value["input"], F.lit(""))), strip(value["output"])))
