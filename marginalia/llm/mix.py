"""Mixing sources to target shares by weighted fair queueing (problem 8).

Each source's documents are shuffled by a hash and queued, one pass after another up to ``max_repeats``. A document's
virtual finish time is the source's tokens up to and with it, divided by the source's target share. All copies
ordered by finish time and cut at the total budget give each source its share as long as it has documents; what a
source that has run out leaves goes to the others in proportion. Tokens are counted with a public
tokenizer's file.

Nothing sorts a source in one task. Within a source and pass the shuffled order is cut into slots of the hash, as many as leave about
``rows_in_one`` documents in each; token sums of the slots give each slot's offset, and
running sums are taken inside a slot only. The global order by finish time is cut the same way: token sums of
ranges of finish time, one for every ``rows_in_one`` uses, find the one range in which the budget ends, and only that range is sorted.

Defined results: a source's name is compared in lower case without separators; documents without a source, id or
text, and of sources without a target, are left aside (``aside`` in the report counts the tokens of the
unknown ones nowhere); a target with a null, zero or negative share or no repeats takes nothing; a document with
no tokens comes along free; repeated document rows count once (a repeat of a ``doc_id`` with another text too, the
one with fewest tokens counts); ties in finish time go by source, pass and id; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import VOCABULARY, count
from ..session import materialize

def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count(x, path) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    return run


def source_key(column: str):
    """The spellings of a source fold to lower-case letters and digits."""
    return F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", "")


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source (folded), tokens; each document once. Longer texts than a million characters are encoded in
    stretches."""
    rows = documents.select("doc_id", source_key("source").alias("source"), "text").where("doc_id is not null and source is not null and source <> '' and text is not null")
    sized = rows.mapInArrow(_tokens(vocabulary), "doc_id bigint, source string, tokens bigint")
    return sized.groupBy("doc_id").agg(F.min(F.struct("tokens", "source")).alias("x")).select("doc_id", "x.source", "x.tokens")  # counts are shuffled, texts aren't


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, vocabulary: str = VOCABULARY, seed: int = 17, rows_in_one: int = 100_000) -> DataFrame:
    """The mixture: ``doc_id, source, pass, tokens, finish``, one row for each use of a document. ``total`` defaults to
    the tokens of all documents that have a source. ``rows_in_one`` is about what a slot or a range holds."""
    sized = materialize(count_tokens(documents, vocabulary))
    known = targets.select(source_key("source").alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    if total is None:
        total = sized.agg(F.sum("tokens")).first()[0] or 0
    sums = sized.groupBy("source").agg(F.sum("tokens").alias("size")).join(known, "source")
    # The finish time at which the budget is spent is at most that at which the shares alone spend it, or later where
    # sources run out: found from one row for each source.
    per_source = sums.select("source", "share", "repeats", "size").collect()  # one row for each target
    level = _level([(r["share"], r["size"] * r["repeats"]) for r in per_source], total)
    spark = documents.sparkSession
    passes = [(r["source"], float(r["share"]), int(r["size"]), int(min(r["repeats"], np.ceil(r["share"] * level / r["size"]) + 1)) if r["size"] else 1) for r in per_source]
    plan = spark.createDataFrame(passes, "source string, share double, size bigint, passes int")
    uses = sized.groupBy("source").agg(F.count("*").alias("n")).join(F.broadcast(plan.select("source", "passes")), "source").agg(F.max("n").alias("most"), F.sum(F.col("n") * F.col("passes")).alias("all")).first()
    slots_log2 = max(4, int(np.ceil(np.log2(max(1, (uses["most"] or 0) / rows_in_one)))))
    ranges = max(64, int(np.ceil((uses["all"] or 0) / rows_in_one)))
    slot = F.pmod(F.shiftright("shuffle", 64 - slots_log2 - 1), F.lit(1 << slots_log2))
    copies = (
        sized.join(F.broadcast(plan), "source")  # one row for each target
        .withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes"))))
        .withColumn("shuffle", F.xxhash64("doc_id", "pass", F.lit(seed)))
        .withColumn("slot", slot)
    )
    offsets = copies.groupBy("source", "pass", "slot").agg(F.sum("tokens").alias("in_slot"))
    offsets = offsets.withColumn("before", F.sum("in_slot").over(Window.partitionBy("source").orderBy("pass", "slot").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select("source", "pass", "slot", F.coalesce("before", F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "pass", "slot").orderBy("shuffle", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    timed = copies.join(offsets, ["source", "pass", "slot"]).withColumn("finish", (F.col("before") + F.sum("tokens").over(inside)) / F.col("share"))
    timed = materialize(timed.select("doc_id", "source", "pass", "tokens", "finish"))
    # Ranges of finish time; their sums find the range in which the budget ends.
    top = max(level * 1.001, 1.0)
    timed = timed.withColumn("range", F.least(F.lit(ranges), F.floor(F.col("finish") / top * ranges)).cast("int"))
    per_range = sorted((r["range"], r["tokens"] or 0) for r in timed.groupBy("range").agg(F.sum("tokens").alias("tokens")).collect())  # at most ranges + 1 rows
    spent, last = 0, -1
    for range_, tokens in per_range:
        if spent + tokens > total:
            last = range_
            break
        spent += tokens
    if last < 0:
        return timed.drop("range")
    whole = timed.where(F.col("range") < last)
    edge = timed.where(F.col("range") == last).withColumn("so_far", F.sum("tokens").over(Window.partitionBy("range").orderBy("finish", "source", "pass", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    return whole.unionByName(edge.where(F.col("so_far") <= total - spent).drop("so_far")).drop("range")


def _level(sources: list[tuple[float, float]], total: float) -> float:
    """The finish time at which the sources (share, tokens at most) have given the total, or all they have."""
    left, weight, level = float(total), sum(w for w, _ in sources), 0.0
    for w, most in sorted(sources, key=lambda x: x[1] / x[0]):
        end = most / w
        if (end - level) * weight >= left:
            return level + left / weight
        left -= (end - level) * weight
        level, weight = end, max(weight - w, 1e-300)
    return level


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target: source, target_share, max_repeats, documents, uses, most_uses, tokens, actual_share."""
    per_doc = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("tokens").alias("tokens"))
    got = per_doc.groupBy(F.col("source").alias("key")).agg(F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"), F.sum("tokens").alias("tokens"))
    whole = got.agg(F.sum("tokens").alias("all_tokens"))
    joined = targets.select("source", "target_share", "max_repeats", source_key("source").alias("key")).join(got, "key", "left").join(F.broadcast(whole))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("source", "target_share", "max_repeats", zero("documents"), zero("uses"), zero("most_uses"), zero("tokens"), F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)).alias("actual_share"))
