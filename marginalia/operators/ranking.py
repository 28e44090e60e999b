"""Ranking notes for query vectors: the best vector of each note, bonuses, pools and budgets.

Ties go by path, then ordinal and question number, whatever the order of the rows. Scores are in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import field
from ..functions.vectors import cosine, score_against, usable, usable_rows


def top(scored: DataFrame, limit: int, score: str = "score", name: str = "name") -> DataFrame:
    return scored.orderBy(F.desc(score), name).limit(limit)


def best_per_note(scored: DataFrame) -> DataFrame:
    """The highest score of each (qid, path), with the vector it comes from."""
    best = F.max(F.struct("score", (-F.coalesce("ordinal", F.lit(0))).alias("o"), (-F.coalesce("question_no", F.lit(-1))).alias("q"))).alias("b")
    return scored.groupBy("qid", "path").agg(best).select("qid", "path", F.col("b.score").alias("score"), (-F.col("b.o")).alias("ordinal"))


def score_pairs(vectors: DataFrame, queries: DataFrame, pairs: DataFrame, dim: int = 64) -> DataFrame:
    """``qid, path, score, ordinal`` of the given ``pairs(qid, path)`` only."""
    asked = queries.where(usable(dim=dim)).select("qid", F.col("embedding").alias("asked"))
    wanted = pairs.select("qid", "path").distinct().join(asked, "qid")
    rows = vectors.where(usable(dim=dim)).select("path", "ordinal", "question_no", "embedding")
    return best_per_note(wanted.join(rows, "path").select("qid", "path", "ordinal", "question_no", cosine(F.col("embedding"), F.col("asked")).alias("score")))


def rank_notes(vectors: DataFrame, queries: DataFrame, limit: int, bonus: DataFrame | None = None, dim: int = 64, base: DataFrame | None = None) -> DataFrame:
    """``qid, path, score, ordinal, place``: the ``limit`` best notes of each query. ``bonus(qid, path, bonus)``, none of them
    below 0, is added to the note's cosine: whoever is among the best has a bonus, or is among the best without any, so only those are looked at.
    ``base`` spares the scan: a ranking without bonus of ``limit`` notes or more."""
    best = base.select("qid", "path", "score", "ordinal") if base is not None else best_per_note(score_against(vectors, queries, dim, limit))
    if bonus is not None:
        both = best.unionByName(score_pairs(vectors, queries, bonus, dim)).groupBy("qid", "path").agg(F.max(F.struct("score", (-F.col("ordinal")).alias("o"))).alias("b")).select("qid", "path", F.col("b.score").alias("score"), (-F.col("b.o")).alias("ordinal"))
        best = both.join(bonus.select("qid", "path", "bonus"), ["qid", "path"], "left").withColumn("score", F.col("score") + F.coalesce("bonus", F.lit(0.0))).drop("bonus")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "path"))
    return best.withColumn("place", place).where(F.col("place") <= limit)


def is_active(status="status"):
    return ~F.col(status).eqNullSafe(F.lit("archived"))


def note_heads(notes: DataFrame) -> DataFrame:
    """path, status, name, description, verified, type of each note, once."""
    return notes.where("path is not null").groupBy("path").agg(F.max(F.struct(*[field(c).alias(c) for c in ("status", "name", "description", "verified", "type")])).alias("h")).select("path", "h.*")


def search(vectors: DataFrame, queries: DataFrame, notes: DataFrame, pool: int = 25, shown: int = 5, archives: bool = False, bonus: DataFrame | None = None, base: DataFrame | None = None) -> DataFrame:
    """The first ``shown`` active notes of the ``pool`` best of each query, and how many archived ones stood before the
    last of them: ``qid, path, score, ordinal, place, hidden``. Notes that are gone are shown without description."""
    ranked = rank_notes(vectors, queries, pool, bonus, base=base)
    seen = ranked.join(note_heads(notes), "path", "left").withColumn("active", F.lit(True) if archives else is_active())
    before = Window.partitionBy("qid").orderBy("place")
    n_active = F.sum(F.col("active").cast("int"))
    seen = seen.withColumn("n", n_active.over(before.rowsBetween(Window.unboundedPreceding, 0)))
    hidden = seen.withColumn("hidden", F.sum(F.when(~F.col("active") & (F.col("n") < shown), 1).otherwise(0)).over(Window.partitionBy("qid")))
    return hidden.where(F.col("active") & (F.col("n") <= shown)).select("qid", "path", "score", "ordinal", F.col("n").alias("place"), "hidden", "name", "description")


def answer(vectors: DataFrame, queries: DataFrame, notes: DataFrame, chunks: DataFrame, n: int = 5, max_chars: int = 4000, least_room: int = 200, pool: int = 25, bonus: DataFrame | None = None, base: DataFrame | None = None) -> DataFrame:
    """Passages under one budget of characters for each query: ``qid, path, name, score, verified, text``. Archived
    and missing notes are passed over; a passage is cut to what is left, and none is begun with less than
    ``least_room`` left."""
    ranked = rank_notes(vectors, queries, pool, bonus, base=base)
    texts = chunks.select("path", "ordinal", "text").groupBy("path", "ordinal").agg(F.max("text").alias("text"))
    live = ranked.join(note_heads(notes), "path").where(is_active()).join(texts, ["path", "ordinal"])
    rows = live.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", "path", "name", "score", "verified", "text"))).alias("rows"))  # at most ``pool`` rows
    empty = F.array().cast("array<struct<place:int,path:string,name:string,score:double,verified:string,text:string>>")
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("stop"), empty.alias("out"))

    def step(s, r):
        room = F.lit(max_chars) - s["used"]
        stop = s["stop"] | (room < least_room) | (F.size(s["out"]) >= n)
        text = F.left(r["text"], room)
        row = F.struct(r["place"].alias("place"), r["path"].alias("path"), r["name"].alias("name"), r["score"].alias("score"), r["verified"].alias("verified"), text.alias("text"))
        return F.struct(F.when(stop, s["used"]).otherwise(s["used"] + F.length(text)).alias("used"), stop.alias("stop"), F.when(stop, s["out"]).otherwise(F.concat(s["out"], F.array(row))).alias("out"))

    return rows.select("qid", F.explode(F.aggregate("rows", start, step, lambda s: s["out"])).alias("r")).select("qid", "r.*")


def hook(vectors: DataFrame, queries: DataFrame, notes: DataFrame, chunks: DataFrame, least_score: float = 0.60, bonus: DataFrame | None = None, base: DataFrame | None = None) -> DataFrame:
    """Two passages of 700 characters together, of notes that score at least ``least_score``."""
    return answer(vectors, queries, notes, chunks, n=2, max_chars=700, bonus=bonus, base=base).where(F.col("score") >= least_score)


def shape_prompt(prompt):
    """Of a prompt the first twelve lines in one, cut to 1200 characters; null if it is short or a command."""
    joined = F.left(F.array_join(F.slice(F.split(prompt, "\n"), 1, 12), " "), F.lit(1200))
    return F.when((F.char_length(prompt) >= 30) & ~prompt.rlike("^[/!]"), joined)


def render_passage(as_json: bool = False):
    if as_json:
        return F.to_json(F.struct("path", "name", "score", "verified", "text"))
    return F.concat(F.lit("## "), F.coalesce("name", "path"), F.lit(" ("), F.col("path"), F.lit(", "), F.format_string("%.3f", F.col("score")), F.lit(")\n\n"), F.col("text"), F.lit("\n"))


def excerpt(text):
    return F.translate(F.left(text, F.lit(180)), "\n", " ")


def nearest_active_note(vectors: DataFrame, queries: DataFrame, notes: DataFrame, threshold: float = 0.90, pool: int = 5) -> DataFrame:
    """The first active note among the ``pool`` best by text vectors only, if it reaches the threshold."""
    ranked = rank_notes(vectors.where("question_no is null"), queries, pool).join(note_heads(notes), "path").where(is_active())
    first = Window.partitionBy("qid").orderBy("place")
    return ranked.withColumn("n", F.row_number().over(first)).where((F.col("n") == 1) & (F.col("score") >= threshold)).select("qid", "path", "score")


def recenter(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """The vectors less their mean, of length one again. The mean is ``dim`` numbers."""
    def sums(batches):
        import pyarrow as pa

        for batch in batches:
            x = usable_rows(batch.column("embedding"), dim)[1]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(x.sum(axis=0)), pa.array([len(x)] * dim, pa.int64())], names=["i", "total", "n"])

    mean = vectors.select("embedding").mapInArrow(sums, "i int, total double, n bigint").groupBy("i").agg((F.sum("total") / F.sum("n")).alias("m"))
    mean = mean.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    # one row: the mean
    off = vectors.crossJoin(F.broadcast(mean)).withColumn("off", F.zip_with("embedding", "mean", lambda v, m: v - m))
    norm = F.greatest(F.sqrt(F.aggregate("off", F.lit(0.0), lambda s, v: s + v * v)), F.lit(1e-9))
    return off.withColumn("norm", norm).withColumn("embedding", F.transform("off", lambda v: v / F.col("norm"))).drop("off", "norm", "mean")


def mmr(vectors: DataFrame, queries: DataFrame, pool: int = 20, take: int = 5, weight: float = 0.7, dim: int = 64) -> DataFrame:
    """Of the ``pool`` best notes of each query, ``take`` chosen one by one for their score less their likeness to those
    chosen before: ``qid, path, place, score``. Ties keep the ranking's order."""
    ranked = rank_notes(vectors, queries, pool, dim=dim)
    of = vectors.where("question_no is null and size(embedding) = 64" if dim == 64 else "question_no is null").groupBy("path", "ordinal").agg(F.max("embedding").alias("embedding"))
    rows = ranked.join(of, ["path", "ordinal"])

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place").reset_index(drop=True)
        x = np.stack([np.asarray(e, dtype=float) for e in group["embedding"]])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        like, chosen = np.zeros(len(x)), []
        for _ in range(min(take, len(x))):
            value = weight * group["score"].to_numpy() - (1 - weight) * like
            value[chosen] = -np.inf
            chosen.append(int(np.argmax(value)))
            like = np.maximum(like, x @ x[chosen[-1]])
        out = group.loc[chosen, ["qid", "path", "score"]]
        out["place"] = np.arange(1, len(chosen) + 1)
        return out[["qid", "path", "place", "score"]]

    return rows.select("qid", "path", "place", "score", "embedding").groupBy("qid").applyInPandas(choose, "qid bigint, path string, place int, score double")
