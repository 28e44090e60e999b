"""Passages of evaluation items in a corpus (problem 7).

The items' word n-grams are counted over the whole corpus. Of every window of ``run`` words of an item the
rarest n-gram is a seed, so whoever copies the window copies its seed, and seeds are as rare as the item
allows; no n-gram is left out for being frequent. Each document is scanned once: where a seed occurs, the
document's words around it are aligned with the item by Smith-Waterman (words match or not, gaps cost), which
scores edited copies too. From the alignment come its score, the share of the item that is covered and the
longest run of equal consecutive words; ``leaks`` keeps every aligned pair with its figures, and a pair is a
verbatim leak if the run reaches ``run``.

An edited copy without ``run`` equal words in a row is aligned only if it keeps a seed: one of the rarest n-grams of the item's windows, whatever
other n-grams it keeps. ``README.md`` has the measured share of copies found.

Items enter by broadcast in blocks of at most ``most_chars`` characters (a longer item is a block of its own), and the corpus is read once
for each block.

Defined results: null ids and texts take no part; texts without words give nothing; an item shorter than
``run`` words counts only when scored by alignment, never as verbatim; repeated documents count once; equal
figures need no order (all pairs come out); empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import each, grams, hashed_words

MATCH, MISMATCH, GAP = 2, -1, -1


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman over word hashes: the best local score, and the longest run of equal words."""
    n = len(text)
    score = run = 0
    above, streak = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
    steps = np.arange(n + 1, dtype=np.int32)
    for w in item:
        same = text == w
        now = np.zeros(n + 1, np.int32)
        now[1:] = np.maximum(above[:-1] + np.where(same, MATCH, MISMATCH), 0)
        now = np.maximum(now, above + GAP)
        now = np.maximum.accumulate(now - GAP * steps) + GAP * steps  # gaps along the text, all at once
        above = np.maximum(now, 0)
        best = int(above.max())
        score = max(score, best)
        next_ = np.zeros(n + 1, np.int32)
        next_[1:] = np.where(same, streak[:-1] + 1, 0)
        streak = next_
        run = max(run, int(streak.max()))
    return score, run


class Items:
    """The items' words, and which n-grams of theirs are seeds."""

    def __init__(self, ids: np.ndarray, texts: list[str], n: int, run: int):
        hashed, start = hashed_words(texts, bare=True)
        self.ids, self.n, self.run = np.array(ids, np.int64), n, run
        self.words = [hashed[a:b] for a, b in each(start)]
        self.grams = [grams(w, n) for w in self.words]
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.grams]))

    def seeds(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gram, item, place) of the rarest n-gram of every window, sorted by gram; count goes by ``known``."""
        order = np.empty(len(self.known), np.int64)
        order[np.lexsort((self.known, count))] = np.arange(len(self.known))  # equal counts go by the n-gram
        places = []
        for g in self.grams:
            width = min(self.run - self.n + 1, len(g))
            windows = np.lib.stride_tricks.sliding_window_view(order[np.searchsorted(self.known, g)], width) if width else np.zeros((0, 1), np.int64)
            places.append(np.unique(windows.argmin(axis=1) + np.arange(len(windows))))
        item, place = np.repeat(np.arange(len(places)), [len(x) for x in places]), np.concatenate([np.zeros(0, np.int64), *places])
        gram = np.concatenate([np.zeros(0, np.uint64), *(g[x] for g, x in zip(self.grams, places))])
        by = np.lexsort((place, item, gram))
        return gram[by], item[by], place[by]


def _holding(shared):
    """The documents with any n-gram of an item, and which of them, with repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = shared.value.known, shared.value.n
        for batch in batches:
            hashed, start = hashed_words(batch.column("text").to_pylist(), bare=True)
            size = np.diff(start)
            g = grams(hashed, n)  # over the borders of documents too: those are left out
            if not len(g) or not len(known):
                continue
            doc = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(known, g), len(known) - 1)
            hit = np.flatnonzero((known[at] == g) & (doc[: len(g)] == doc[n - 1 :]))
            if len(hit):
                docs, first = np.unique(doc[hit], return_index=True)
                offsets = pa.array(np.append(first, len(hit)).astype(np.int32))
                take = pa.array(docs)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("text").take(take), pa.ListArray.from_arrays(offsets, pa.array(at[hit].astype(np.int32)))], names=["doc_id", "text", "found"])

    return run


def _scan(shared, shared_seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, (seed, item_of, place_of) = shared.value, shared_seeds.value
        for batch in batches:
            hashed, start = hashed_words(batch.column("text").to_pylist(), bare=True)
            out = []
            for row, (a, b) in enumerate(each(start)):
                words = hashed[a:b]
                g = grams(words, items.n)
                if not len(g) or not len(seed):
                    continue
                low = np.searchsorted(seed, g)
                hits = np.flatnonzero(seed[np.minimum(low, len(seed) - 1)] == g)
                spans: dict[int, list[tuple[int, int]]] = {}
                for at in hits:
                    i = low[at]
                    while i < len(seed) and seed[i] == g[at]:
                        size, back = len(items.words[item_of[i]]), place_of[i]
                        room = size // 4 + 8  # words that a copy may have gained
                        spans.setdefault(int(item_of[i]), []).append((max(0, at - back - room), min(len(words), at - back + size + room)))
                        i += 1
                for item, ranges in spans.items():
                    merged: list[list[int]] = []
                    for lo, hi in sorted(ranges):
                        if merged and lo <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], hi)
                        else:
                            merged.append([lo, hi])
                    got = [align(items.words[item], words[lo:hi]) for lo, hi in merged]
                    out.append((row, int(items.ids[item]), max(s for s, _ in got), max(r for _, r in got), len(items.words[item])))
            if out:
                row, item, score, longest, size = (pa.array(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), item, score, longest, size], names=["doc_id", "item_id", "score", "longest_run", "item_words"])

    return run


def leaks(documents: DataFrame, items: DataFrame, n: int = 5, run: int = 13, most_chars: int = 20_000_000) -> DataFrame:
    """``doc_id, item_id, score, longest_run, item_words, share``: every document in which a seed of an item was
    aligned. share is the score over the item's best possible one."""
    if not 0 < n <= run:
        raise ValueError("n must be between 1 and run")
    few = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    size = few.agg(F.sum(F.char_length("text"))).first()[0] or 0
    if size <= most_chars:
        return _leaks(documents, few, n, run)
    few, blocks, out = materialize(few), -(-size * 5 // (most_chars * 4)), None  # blocks differ in size: a fifth is left free
    for i in range(blocks):
        part = _leaks(documents, few.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i), n, run)
        out = part if out is None else out.unionByName(part)
    # an item of several texts may have been in several blocks
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "longest_run", "item_words", "share")])


def _leaks(documents: DataFrame, items: DataFrame, n: int, run: int) -> DataFrame:
    spark = documents.sparkSession
    few = items.orderBy("item_id", "text").toArrow()  # a block of at most most_chars characters, or one item
    kept = Items(few["item_id"].to_numpy(), few["text"].to_pylist(), n, run)
    shared = spark.sparkContext.broadcast(kept)
    rows = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    # The corpus is read once: only documents that hold an n-gram of an item go on, and all counts come from them.
    rows = materialize(rows.mapInArrow(_holding(shared), "doc_id bigint, text string, found array<int>"))
    counted = rows.select(F.explode("found").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).toArrow()  # two numbers for each n-gram of the block
    count = np.zeros(len(kept.known), np.int64)
    count[counted["gram"].to_numpy()] = counted["n"].to_numpy()
    seeds = spark.sparkContext.broadcast(kept.seeds(count))
    found = rows.select("doc_id", "text").mapInArrow(_scan(shared, seeds), "doc_id bigint, item_id bigint, score bigint, longest_run bigint, item_words bigint")
    best = found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("longest_run").alias("longest_run"), F.max("item_words").alias("item_words"))
    return best.withColumn("share", F.col("score") / (MATCH * F.col("item_words")))


def verbatim(found: DataFrame, run: int = 13) -> DataFrame:
    return found.where(F.col("longest_run") >= run).select("doc_id", "item_id")
