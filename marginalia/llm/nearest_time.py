"""Pairing records of two tables by nearest time, per entity, within a tolerance (problem 4).

Both sides are cut into shards of one entity and one stretch of time; the right side also goes to the
neighbouring shard where it lies within the tolerance of an edge, so that every shard answers alone. Repeats
are folded before the shuffle: of the right rows of one entity and second only the smallest id can win, and
equal left rows have equal answers. A shard therefore holds at most ``bucket`` left and
``bucket + 2 * tolerance`` right keys whatever the rows: a hot entity becomes many shards.

In a shard the sorted right keys carry a piecewise-linear index: one line for each ``PIECE`` keys, with its
largest error measured, so that the prediction plus or minus that error brackets the true position and a
bisection of the bracket gives it exactly.

Defined results: rows with a null key, time or id take no part; an empty string is an entity like another;
a right row with a null or empty list shows nothing; ties go to the earlier time, then the smaller id;
repeated rows count once; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 64


class LineIndex:
    """Predicts the position of a key among sorted distinct keys, with an error bound for each piece."""

    def __init__(self, keys: np.ndarray):
        self.keys, n = keys, len(keys)
        self.first = keys[::PIECE]
        start = np.arange(0, n, PIECE)
        end = np.minimum(start + PIECE, n) - 1
        spread = np.maximum(keys[end] - keys[start], 1)
        self.slope = (end - start) / spread
        self.start = start
        piece = np.arange(n) // PIECE
        guess = start[piece] + (keys - self.first[piece]) * self.slope[piece]
        off = np.abs(guess - np.arange(n))
        self.error = np.ceil(np.maximum.reduceat(off, start)).astype(np.int64) + 1 if n else np.zeros(0, np.int64)

    def lower_bound(self, probes: np.ndarray) -> np.ndarray:
        """For each probe the first position whose key isn't smaller."""
        n = len(self.keys)
        if not n:
            return np.zeros(len(probes), np.int64)
        piece = np.maximum(np.searchsorted(self.first, probes, side="right") - 1, 0)
        guess = (self.start[piece] + (probes - self.first[piece]) * self.slope[piece]).astype(np.int64)
        edge = np.minimum(self.start[piece] + PIECE, n)
        low = np.clip(guess - self.error[piece], self.start[piece], edge)
        high = np.clip(guess + self.error[piece] + 1, low, edge)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            less = open_ & (self.keys[np.minimum(mid, n - 1)] < probes)
            low = np.where(less, mid + 1, low)
            high = np.where(open_ & ~less, mid, high)
        return low


def _match(table: pa.Table, tolerance: int, bucket: int) -> pa.RecordBatch | None:
    """Answers whole shards; the rows come sorted by shard."""
    entity, slot = table["entity"].combine_chunks(), table["slot"].combine_chunks()
    n = len(entity)
    change = np.ones(n, bool)
    if n > 1:
        change[1:] = pc.or_(pc.not_equal(entity[1:], entity[:-1]), pc.not_equal(slot[1:], slot[:-1])).to_numpy(zero_copy_only=False)
    group = np.cumsum(change) - 1
    secs = table["secs"].to_numpy()
    right_id = table["right_id"].combine_chunks()
    is_right = right_id.is_valid().to_numpy(zero_copy_only=False)
    span = bucket + 4 * tolerance + 4
    local = secs - slot.to_numpy(zero_copy_only=False) * bucket + 2 * tolerance + 2  # in 0 .. span for every row of a shard
    key = group * span + local
    at_right, at_left = np.flatnonzero(is_right), np.flatnonzero(~is_right)
    if not len(at_right) or not len(at_left):
        return None
    at_right = at_right[np.argsort(key[at_right], kind="stable")]
    keys, probes = key[at_right], key[at_left]
    after = LineIndex(keys).lower_bound(probes)
    before = after - 1
    far = np.int64(tolerance + 1)
    gap_after = np.where(after < len(keys), keys[np.minimum(after, len(keys) - 1)] - probes, far)
    gap_before = np.where(before >= 0, probes - keys[np.maximum(before, 0)], far)
    take_before = gap_before <= gap_after
    gap = np.where(take_before, gap_before, gap_after)
    ok = gap <= tolerance
    pick = at_right[np.where(take_before, before, np.minimum(after, len(keys) - 1))[ok]]
    rows = pa.array(at_left[ok])
    return pa.RecordBatch.from_arrays(
        [entity.take(rows), table["secs"].combine_chunks().take(rows), right_id.take(pa.array(pick)), table["secs"].combine_chunks().take(pa.array(pick))],
        names=["entity", "secs", "right_id", "right_secs"],
    )


def _shards(tolerance: int, bucket: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            table = pa.concat_tables([kept, now]) if kept is not None else now
            last = table.slice(table.num_rows - 1)
            same = pc.and_(pc.equal(table["entity"], last["entity"][0]), pc.equal(table["slot"], last["slot"][0]))
            cut = pc.index(same, True).as_py()  # the last shard may go on in the next batch
            if cut and (found := _match(table.slice(0, cut), tolerance, bucket)) is not None:
                yield found
            kept = table.slice(cut)
        if kept is not None and (found := _match(kept, tolerance, bucket)) is not None:
            yield found

    return run


def nearest_in_time(reads: DataFrame, searches: DataFrame, tolerance: int = 600, bucket: int = 3600) -> DataFrame:
    """``reads(read_id, secs, path)`` with the nearest of ``searches(search_id, secs, shown)`` that showed the
    path: ``read_id, path, secs, search_id, search_secs``. Reads without a partner give no row."""
    reads = reads.select("read_id", "secs", "path").where("read_id is not null and secs is not null and path is not null")
    left = reads.select(F.col("path").alias("entity"), "secs").distinct()
    left = left.select("entity", F.floor(F.col("secs") / bucket).cast("bigint").alias("slot"), "secs", F.lit(None).cast("bigint").alias("right_id"))
    right = (
        searches.where("search_id is not null and secs is not null")
        .select("search_id", "secs", F.explode("shown").alias("entity"))
        .where("entity is not null")
        .groupBy("entity", "secs")
        .agg(F.min("search_id").alias("right_id"))
    )
    slot = lambda by: F.floor((F.col("secs") + by) / bucket).cast("bigint")
    right = right.select("entity", F.explode(F.sequence(slot(-tolerance), slot(tolerance))).alias("slot"), "secs", "right_id")
    found = (
        left.unionByName(right)
        .repartition("entity", "slot")
        .sortWithinPartitions("entity", "slot")
        .mapInArrow(_shards(tolerance, bucket), "entity string, secs bigint, right_id bigint, right_secs bigint")
    )
    return reads.join(found.withColumnRenamed("entity", "path"), ["path", "secs"]).select("read_id", "path", "secs", F.col("right_id").alias("search_id"), F.col("right_secs").alias("search_secs")).distinct()
