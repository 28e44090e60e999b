"""Learning from searches and the reads that followed them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import alike


def asof_backward(left: DataFrame, right: DataFrame, by: str, at: str, tolerance: int, prefix: str = "r_", bucket: int | None = None, salts: int = 8) -> DataFrame:
    """Each left row with the last right row of the same ``by`` whose ``at`` is at most its own and at most
    ``tolerance`` earlier; left rows without one are dropped. Of right rows at the same time the greatest wins,
    compared column by column: the others are folded away before the shuffle. Time is cut into buckets no shorter than the
    tolerance, a right row goes to its own and the next, and left rows are spread over ``salts``: so a hot key, or no key
    at all, is still many small groups, each of a few right rows for each second at most."""
    width = max(bucket or 0, tolerance, 1)
    cut = lambda shift: F.floor(F.col(at) / width).cast("bigint") + shift
    others = [c for c in right.columns if c not in (by, at)]
    folded = right.where(F.col(at).isNotNull() & F.col(by).isNotNull()).groupBy(by, at).agg(F.max(F.struct(*others)).alias("p"))
    payload = F.struct(F.col(at).alias(f"{prefix}{at}"), *[F.col(f"p.{c}").alias(f"{prefix}{c}") for c in others])
    tagged = folded.select(F.col(by), F.col(at), F.lit(0).alias("side"), payload.alias("r"), F.explode(F.array(cut(0), cut(1))).alias("slot"), F.lit(None).cast(left.schema.simpleString()).alias("l"))
    tagged = tagged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    probes = left.where(F.col(at).isNotNull() & F.col(by).isNotNull()).select(F.col(by), F.col(at), F.lit(1).alias("side"), F.lit(None).cast(tagged.schema["r"].dataType).alias("r"), cut(0).alias("slot"), F.struct(*left.columns).alias("l"), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int").alias("salt"))
    order = Window.partitionBy(by, "slot", "salt").orderBy(at, "side").rowsBetween(Window.unboundedPreceding, 0)
    paired = tagged.unionByName(probes).withColumn("last", F.last("r", ignorenulls=True).over(order))
    return paired.where((F.col("side") == 1) & F.col("last").isNotNull() & (F.col(at) - F.col(f"last.{prefix}{at}") <= tolerance)).select("l.*", "last.*")


def missed_pairs(searches: DataFrame, reads: DataFrame, window: int = 600) -> DataFrame:
    """``query, path, day``: for each read, the latest search at most ``window`` seconds before it, unless that search
    showed the path. Searches come before reads of the same second; the later id wins among searches."""
    s = searches.where("secs is not null").select("secs", "search_id", "query", "shown").groupBy("secs", "search_id").agg(F.max(F.struct("query", "shown")).alias("x")).select(F.lit(0).alias("all"), "secs", "search_id", "x.query", "x.shown")
    r = reads.where("secs is not null and path is not null").select(F.lit(0).alias("all"), "read_id", "secs", "path").distinct()
    last = asof_backward(r, s, "all", "secs", window)
    return last.where(~F.coalesce(F.array_contains("r_shown", F.col("path")), F.lit(False))).select("read_id", F.col("r_query").alias("query"), "path", F.floor(F.col("secs") / 86400).cast("bigint").alias("day"))


def fold(pairs: DataFrame) -> DataFrame:
    """``query, path, source, count, last_day`` from ``pairs(query, path, day[, source])``: how many different days, and the last. A pair once
    said explicitly stays explicit."""
    source = F.col("source") if "source" in pairs.columns else F.lit("missed")
    rows = pairs.withColumn("explicit", source == "explicit")
    return rows.groupBy("query", "path").agg(F.when(F.max("explicit"), "explicit").otherwise("missed").alias("source"), F.count_distinct("day").cast("int").alias("count"), F.max("day").alias("last_day"))


def forget(table: DataFrame, query: str) -> DataFrame:
    return table.where(~F.col("query").eqNullSafe(F.lit(query.strip())))


def decay(last_day: Column, today: int) -> Column:
    """A half for every 60 days."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(today) - last_day, F.lit(0)) / 60)


def pairs_report(table: DataFrame, today: int) -> DataFrame:
    return table.select("query", "path", "source", "count", "last_day", decay(F.col("last_day"), today).alias("weight"))


def learned_bonus(table: DataFrame, vectors_of: DataFrame, queries: DataFrame, today: int, skip_own: bool = False) -> DataFrame:
    """``qid, path, bonus`` for ``queries(qid, query, embedding)`` from the pairs whose query is alike (cosine 0.85 or more):
    each adds 0.03 by likeness, by count up to three and by age, together at most 0.05. ``vectors_of(query, embedding)`` holds the pairs' vectors;
    ``skip_own`` leaves out pairs with the very same text. The queries go to the executors in blocks."""
    near = alike(vectors_of.select(F.col("query").alias("key"), "embedding"), queries, 0.85).withColumnRenamed("key", "query")
    if skip_own:
        near = near.join(queries.select("qid", "query"), ["qid", "query"], "left_anti")
    alike_ = table.where("path is not null").join(near, "query")
    part = 0.03 * F.col("sim") * F.least(F.coalesce("count", F.lit(0)), F.lit(3)) / 3 * decay(F.col("last_day"), today)
    return alike_.groupBy("qid", "path").agg(F.least(F.sum(part), F.lit(0.05)).alias("bonus"))


def within_window(bonus: DataFrame, base: DataFrame, width: float = 0.10) -> DataFrame:
    """The bonuses of notes whose score without any bonus, ``base(qid, path, score)``, is at most ``width`` below the query's best."""
    near = base.withColumn("best", F.max("score").over(Window.partitionBy("qid"))).where(F.col("best") - F.col("score") <= width)
    return bonus.join(near.select("qid", "path"), ["qid", "path"], "left_semi")


def sum_bonuses(*bonuses: DataFrame) -> DataFrame:
    out = bonuses[0].select("qid", "path", "bonus")
    for b in bonuses[1:]:
        out = out.unionByName(b.select("qid", "path", "bonus"))
    return out.groupBy("qid", "path").agg(F.sum("bonus").alias("bonus"))


def missing_queries(table: DataFrame, vectors_of: DataFrame) -> DataFrame:
    """The pairs' queries that have no vector yet."""
    return table.select("query").where("query is not null").distinct().join(vectors_of.select("query"), "query", "left_anti")


def usage_report(searches: DataFrame, now: int) -> DataFrame:
    """Searches in all and in the last day, and the upper median of how many notes they showed."""
    once = searches.groupBy("search_id").agg(F.max("secs").alias("secs"), F.max(F.coalesce(F.size("shown"), F.lit(0))).alias("n"))
    counts = once.groupBy("n").agg(F.count("*").alias("c"))  # the median from counts, not from a sorted list
    total = once.agg(F.count("*").alias("total"), F.sum(F.when((F.col("secs") > now - 86400) & (F.col("secs") <= now), 1).otherwise(0)).alias("last_day"))
    up_to = counts.withColumn("upto", F.sum("c").over(Window.orderBy("n"))).crossJoin(F.broadcast(total))  # one row for each length, and one row
    return up_to.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("total", "last_day").agg(F.min("n").cast("bigint").alias("median_shown"))
