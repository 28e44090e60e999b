"""Streams: logs as they grow, missed pairs with a watermark, and a periodic refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, folder: str, like: DataFrame, files_at_once: int = 100) -> DataFrame:
    """A Parquet folder as a stream, with the schema of a table already there."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def missed_stream(searches: DataFrame, reads: DataFrame, window: int = 600, late: str = "10 minutes") -> DataFrame:
    """``read_id, path, read_at, search_at, query, shown`` for each read and each search at most ``window`` seconds before it; both sides need
    ``at``, a timestamp. State is kept for the watermark and the window only. The latest search of each read is
    picked in ``latest_missed``, since a stream may only append."""
    slot = lambda shift: F.floor(F.unix_seconds("at") / window).cast("bigint") + shift
    s = searches.withWatermark("at", late).select(F.col("at").alias("search_at"), "query", "shown", F.explode(F.array(slot(0), slot(1))).alias("slot"))
    r = reads.where("path is not null").withWatermark("at", late).select("read_id", "path", F.col("at").alias("read_at"), slot(0).alias("slot"))
    near = (F.col("search_at") <= F.col("read_at")) & (F.col("read_at") <= F.col("search_at") + F.expr(f"interval {window} seconds"))
    return r.join(s, (r["slot"] == s["slot"]) & near).select("read_id", "path", "read_at", "search_at", "query", "shown")


def latest_missed(matched: DataFrame) -> DataFrame:
    """Of each read the latest search, if it didn't show the path: ``query, path, day``."""
    last = matched.groupBy("read_id", "path").agg(F.max(F.struct("search_at", "query", "shown")).alias("s"), F.max("read_at").alias("read_at"))
    return last.where(~F.coalesce(F.array_contains("s.shown", F.col("path")), F.lit(False))).select(F.col("s.query").alias("query"), "path", F.unix_date(F.to_date("read_at")).cast("bigint").alias("day"))


def once_a_day(pairs: DataFrame, late: str = "1 day") -> DataFrame:
    """Each pair of ``pairs(query, path, at)`` once a day."""
    return pairs.withWatermark("at", late).withColumn("day", F.to_date("at")).dropDuplicatesWithinWatermark(["query", "path", "day"])


def watch(changes: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, every: str = "30 seconds") -> StreamingQuery:
    """Calls ``act(batch, number)`` for each batch of a stream; a restart goes on where it stopped."""
    return changes.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
