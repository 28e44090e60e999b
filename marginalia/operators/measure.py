"""Measuring retrieval: hit rates, fidelity, context cost, draws of targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoder import quantised
from ..functions.vectors import cosine, usable
from .ranking import rank_notes, score_pairs


def hit_rates(ranked: DataFrame, cases: DataFrame, tolerated: DataFrame | None = None) -> DataFrame:
    """By family: cases, top1, top5, right_passage and, with ``tolerated(qid, path)``, tolerant_top5. ``ranked(qid, path, ordinal, place)``,
    ``cases(qid, family, expected, ordinal)``. Families are never merged."""
    hit = ranked.where("place <= 5").select("qid", F.col("path").alias("expected"), "place", F.col("ordinal").alias("got"))
    rows = cases.join(hit, ["qid", "expected"], "left")
    out = [F.count("*").alias("cases"), F.avg(F.coalesce((F.col("place") == 1).cast("double"), F.lit(0.0))).alias("top1"), F.avg(F.col("place").isNotNull().cast("double")).alias("top5"), F.avg(F.coalesce((F.col("got") == F.col("ordinal")).cast("double"), F.lit(0.0))).alias("right_passage")]
    if tolerated is not None:
        near = ranked.where("place <= 5").join(tolerated, ["qid", "path"], "left_semi").select("qid").distinct().withColumn("near", F.lit(True))
        rows = rows.join(near, "qid", "left")
        out.append(F.avg(F.col("near").isNotNull().cast("double")).alias("tolerant_top5"))
    return rows.groupBy("family").agg(*out)


def diagnose(vectors: DataFrame, queries: DataFrame, cases: DataFrame, dim: int = 64) -> DataFrame:
    """``qid, target_score, top_score, gap``: how far the expected note is from the best. Only these two are scored for each query."""
    best = rank_notes(vectors, queries, 1, dim=dim).select("qid", F.col("score").alias("top_score"))
    target = score_pairs(vectors, queries, cases.select("qid", F.col("expected").alias("path")), dim).select("qid", F.col("score").alias("target_score"))
    return target.join(best, "qid").withColumn("gap", F.col("top_score") - F.col("target_score"))


def fidelity(vectors: DataFrame, chunks: DataFrame, dim: int = 64, bucket: int = 100) -> DataFrame:
    """By the length of the chunk (estimated tokens, in buckets): vectors, the least, upper median and mean cosine between each
    vector and itself after 8-bit quantisation."""
    size = chunks.groupBy("path", "ordinal").agg(F.max(F.floor(F.octet_length("text") / 3) + 1).alias("tokens"))
    rows = vectors.where(usable(dim=dim) & F.col("question_no").isNull()).groupBy("vec_id", "path", "ordinal").agg(F.max("embedding").alias("embedding")).join(size, ["path", "ordinal"])
    kept = rows.withColumn("like", cosine(F.col("embedding"), quantised(F.col("embedding")))).withColumn("bucket", (F.floor(F.col("tokens") / bucket) * bucket).cast("bigint"))
    place = Window.partitionBy("bucket").orderBy("like", "vec_id")
    ranked = kept.withColumn("k", F.row_number().over(place)).withColumn("n", F.count("*").over(Window.partitionBy("bucket")))
    return ranked.groupBy("bucket").agg(F.count("*").alias("vectors"), F.min("like").alias("least"), F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("like"))).alias("median"), F.avg("like").alias("mean"))


def passage_cost(passages: DataFrame, cases: DataFrame) -> DataFrame:
    """What a reader of passages pays: ``qid, passages, tokens, reached``, of ``passages(qid, path, text)`` and ``cases(qid, expected)``. Tokens are
    a quarter of the octets, rounded up. Queries without a passage pay nothing."""
    paid = passages.groupBy("qid").agg(F.count("*").alias("passages"), F.sum(F.ceil(F.octet_length("text") / 4)).alias("tokens"), F.collect_set("path").alias("paths"))  # a handful for each query
    rows = cases.select("qid", "expected").join(paid, "qid", "left")
    return rows.select("qid", F.coalesce("passages", F.lit(0)).alias("passages"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.array_contains("paths", F.col("expected")), F.lit(False)).alias("reached"))


SEED = 0x5EED1234ABCD0001


def draw(n: int, of: int, seed: int = SEED) -> list[int]:
    """``n`` different numbers below ``of``, by a 64-bit xorshift: the same on every machine."""
    state, pool, out = seed, list(range(of)), []
    for _ in range(min(n, of)):
        for by in (13, -7, 17):
            state ^= (state << by) & (2**64 - 1) if by > 0 else state >> -by
        at = state % len(pool)
        out.append(pool[at])
        pool[at] = pool[-1]
        pool.pop()
    return out
