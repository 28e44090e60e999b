"""Rules that notes should keep, each breach one finding (path, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import field, stem
from ..functions.tokens import VOCABULARY, token_count
from .chunking import with_context
from .links import dangling, homonyms

# The types and states a note may have.
TYPES = ("user", "feedback", "project", "reference")
STATES = ("active", "archived")


def _rules() -> list[Column]:
    name, own, type_, status = field("name"), stem(F.col("path")), field("type"), field("status")
    folded = lambda c: F.coalesce(field(c).isin(">", "|"), F.lit(False))
    return [
        F.when(name.isNotNull() & (name != own), F.concat(F.lit("name differs from the file: "), name)),
        F.when(~own.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit("file name is not in kebab case")),
        F.when(own.rlike(rf"^({'|'.join(TYPES)})[-_]"), F.lit("file name begins with a type")),
        F.when(name.isNull(), F.lit("no name")),
        F.when(field("description").isNull(), F.lit("no description")),
        F.when(type_.isNotNull() & ~type_.isin(*TYPES), F.concat(F.lit("unknown type: "), type_)),
        F.when(status.eqNullSafe(F.lit("archived")) & field("superseded_by").isNull(), F.lit("archived without a successor")),
        F.when(folded("name") | folded("description"), F.lit("folded text in the header")),
        F.when(F.coalesce(F.contains("body", F.lit("\r")), F.lit(False)) | F.coalesce(F.contains(name, F.lit("\r")), F.lit(False)), F.lit("Windows line ends")),
        F.when(status.isNotNull() & ~status.isin(*STATES), F.concat(F.lit("unknown status: "), status)),
    ]


def note_findings(notes: DataFrame) -> DataFrame:
    rows = notes.where("path is not null").select("path", F.explode(F.array_compact(F.array(*_rules()))).alias("message"))
    return rows.distinct()


def nested_metadata(raw: DataFrame) -> DataFrame:
    """``raw(path, content)``: notes whose header nests its fields under ``metadata``."""
    head = F.substring_index("content", "\n---", 1)
    return raw.where(head.rlike(r"(?m)^metadata:\s*$")).select("path", F.lit("nested metadata in the header").alias("message"))


def outdated_pins(notes: DataFrame, installed: dict[str, str]) -> DataFrame:
    """Notes that depend on a version of a tool other than the installed one. ``1.2.x`` means any that begins 1.2;
    tools that aren't installed are passed over. The versions are a small table of the caller's."""
    spark = notes.sparkSession
    have = F.broadcast(spark.createDataFrame([(k, v) for k, v in installed.items()], "tool string, have string"))
    pins = notes.where("path is not null").select("path", F.explode(F.split(field("depends_on"), ",")).alias("pin")).select("path", F.trim("pin").alias("pin"))
    parts = pins.select("path", "pin", F.split("pin", r"\s+").alias("p")).where(F.size("p") >= 2).select("path", "pin", F.col("p")[0].alias("tool"), F.regexp_replace(F.col("p")[1], r"\.x$", "").alias("want"))
    return parts.join(have, "tool").where(~F.startswith("have", "want")).select("path", F.concat(F.lit("depends on "), F.col("pin"), F.lit(", installed is "), F.col("have")).alias("message")).distinct()


def truncated(notes: DataFrame, chunks: DataFrame, window: int = 512, vocabulary: str = VOCABULARY, most: int = 10) -> DataFrame:
    """``path, ordinal, tokens``: the ``most`` passages that with their context exceed a model's window by most. A report, not a failure."""
    heads = notes.where("path is not null").groupBy("path").agg(F.max(F.struct(field("name").alias("n"), field("description").alias("d"))).alias("h"))
    texts = chunks.select("path", "ordinal", "text").distinct().join(heads, "path").select("path", "ordinal", with_context(F.col("h.n"), F.col("h.d"), F.col("text")).alias("text"))
    # A token holds at least one octet: short texts can't exceed the window, and aren't sent to the tokenizer.
    long_ = texts.where(F.octet_length("text") > window - 2).withColumn("tokens", token_count(F.col("text"), vocabulary) + 2)
    return long_.where(F.col("tokens") > window).select("path", "ordinal", "tokens").orderBy(F.desc("tokens"), "path", "ordinal").limit(most)


def all_findings(notes: DataFrame) -> DataFrame:
    return note_findings(notes).unionByName(homonyms(notes)).unionByName(dangling(notes))


def is_clean(findings: DataFrame) -> bool:
    return findings.isEmpty()
