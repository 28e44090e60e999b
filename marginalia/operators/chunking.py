"""Cutting bodies into passages, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, strip

MARGIN = 62


def budget_for(window: int) -> int:
    """The tokens of a passage that leave room for its context in a model's window."""
    return max(window - MARGIN, 1)


def blocks(body: Column) -> Column:
    """The trimmed blocks between blank lines, each with its octet offset."""
    raw = F.split(body, "\n\n+")
    gaps = F.concat(F.regexp_extract_all(body, F.lit("\n\n+"), F.lit(0)), F.array(F.lit("")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))

    def step(s, x):
        text = strip(x["raw"])
        lead = F.octet_length(x["raw"]) - F.octet_length(F.regexp_replace(x["raw"], r"(?U)^\s+", ""))
        block = F.struct((s["at"] + lead).cast("int").alias("start"), text.alias("text"))
        return F.struct((s["at"] + F.octet_length(x["raw"]) + F.octet_length(x["gap"])).cast("int").alias("at"), F.when(text == "", s["out"]).otherwise(F.concat(s["out"], F.array(block))).alias("out"))

    pairs = F.transform(F.arrays_zip(raw.alias("raw"), gaps.alias("gap")), lambda x: F.struct(x["raw"].alias("raw"), F.coalesce(x["gap"], F.lit("")).alias("gap")))
    return F.aggregate(pairs, start, step, lambda s: s["out"])


def chunk_blocks(found: Column, budget: int) -> Column:
    """Blocks joined while the budget holds; a heading starts a new passage. ``array<struct<start, text>>``."""
    empty = F.array().cast("array<struct<start:int,text:string>>")
    none = F.lit(None).cast("struct<start:int,text:string>")
    start = F.struct(none.alias("cur"), empty.alias("out"))

    def step(s, b):
        cut = b["text"].startswith("#") | (estimate_tokens(s["cur"]["text"]) + estimate_tokens(b["text"]) > budget)
        joined = F.struct(s["cur"]["start"].alias("start"), F.concat(s["cur"]["text"], F.lit("\n\n"), b["text"]).alias("text"))
        first = s["cur"].isNull()
        return F.struct(F.when(first | cut, b).otherwise(joined).alias("cur"), F.when(first | ~cut, s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"]))).alias("out"))

    return F.aggregate(found, start, step, lambda s: F.when(s["cur"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"]))))


def split_bodies(notes: DataFrame, budget: int = budget_for(512)) -> DataFrame:
    """``path, ordinal, start, text`` of every passage of every note."""
    once = notes.where("path is not null").groupBy("path").agg(F.max("body").alias("body"))
    cut = once.select("path", F.posexplode(chunk_blocks(blocks(F.col("body")), budget)).alias("ordinal", "c"))
    return cut.select("path", "ordinal", "c.start", "c.text")


def with_context(name: Column, description: Column, text: Column) -> Column:
    """A passage under its note's name and description."""
    said = F.coalesce(description, F.lit(""))
    return F.concat(F.coalesce(name, F.lit("")), F.when(said != "", F.concat(F.lit("\n"), said)).otherwise(F.lit("")), F.lit("\n\n"), text)


def split_key(key: Column) -> Column:
    """``path#ordinal`` or ``path#ordinal?k`` in its parts; an ordinal that isn't a number, or none, is 0."""
    tail = F.when(F.instr(key, "#") > 0, F.substring_index(key, "#", -1))
    path = F.when(tail.isNull(), key).otherwise(F.left(key, F.length(key) - F.length(tail) - 1))
    number = F.regexp_extract(F.substring_index(tail, "?", 1), r"^(\d{1,9})$", 1)
    return F.struct(path.alias("path"), F.when(number.isNull() | (number == ""), F.lit(0)).otherwise(number.try_cast("int")).alias("ordinal"), F.coalesce(F.instr(tail, "?") > 0, F.lit(False)).alias("is_question"))
