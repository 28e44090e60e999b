"""Groups of texts that share most of their word n-grams, by pigeonhole blocks (problem 6).

The fingerprint of a text is a row of slots, each the smallest of its n-grams' hashes under one hash function; two texts
with a Jaccard similarity t agree in about a share t of their slots. The slots are cut into blocks of ``rows`` each: were the
slots that differ spread as evenly as can be, texts close enough would by the pigeonhole principle keep two blocks whole. The slots that differ lie at random, so
that is a matter of chance, and the number of blocks is set so that a pair exactly at the threshold keeps ``LEAST_SHARED`` blocks with
probability 1 - ``MISSED``, a closer one with more. Blocks are joined on. With each block goes one bit of every slot, and pairs whose bits
lie further apart than ``SIGMAS`` deviations of what the threshold gives don't count. Candidates are read again and verified exactly: the bit vectors of
their n-grams must lie within the Hamming distance that is equal to the similarity asked for, (1 - t) / (1 + t) times the sum of their sizes.

``exact=True`` leaves nothing to chance: n-grams are ordered from the rarest, and of n-grams in an order that both share, two texts
at the threshold have one in common among the first ``size - ceil(t * size) + 1`` of each. It costs more, the more so the more texts share their rarest n-grams.

(A 64-bit SimHash with fixed blocks can't do this at t = 0.5: close pairs then differ in some 17 to 25 bits, so blocks
of two or three bits would be left, which nearly all pairs share. That is why the fingerprints are of minimum hashes.)

Texts with equal sets of n-grams are one class and enter the join once; ``pairs`` are between classes, ``members`` names each text's
class, and only ``near_pairs`` expands them. No n-grams are kept: texts are read twice, the second time only those of candidates.
A block of more than ``most_in_block`` classes is cut into parts, and every two parts meet in a task of their own. The blocks, far larger
than the texts, are dealt out in up to ``ROUNDS`` rounds, and the files of a shuffle go as soon as its rows are written.

Defined results: a null text counts as empty; texts of fewer than n words have no n-gram and are in no pair, but
``members`` has them too, in one class for each sequence of words (one for no words); repeated rows of a key count once (if
their texts disagree, the one of the smallest class id, of those with n-grams if any); empty tables give no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import forget, materialize, partitions_for
from .words import MIX, each, gram_sets, grams, hashed_words

LEAST_SHARED, MISSED, SIGMAS = 2, 0.0002, 4.5
SEED = 20240311
NO_WORDS = np.uint64(0x6E6F6E65)
#: The most bits of slots that go with a block.
MARKS = 256
#: A row of a block: the block, a class, its size and its slots' bits.
ROW = np.dtype([("block", "<i8"), ("id", "<i8"), ("size", "<i4"), ("marks", "<u8", MARKS // 64)])
#: The same in a cell of a large block, which stands in place of the block: and on which side of the cell it is, -1 if the cell has no sides.
CELL = np.dtype([*ROW.descr, ("side", "i1")])
#: The blocks are dealt out in so many rounds at most, in fewer if a round holds no more rows than this.
ROUNDS, DEALT = 8, 8_000_000
#: What a task holds at once, in rows of blocks; what is made of them at once.
HELD, MADE = 1_500_000, 1 << 18
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class NearDuplicates(NamedTuple):
    members: DataFrame  # key, class_id
    pairs: DataFrame  # class_a < class_b, common, size_a, size_b
    classes: DataFrame  # class_id (all of them with an n-gram)


def layout(threshold: float) -> tuple[int, int, int]:
    """Slots in a block, blocks, and how many of the slots' bits may differ."""
    rows = int(np.clip(round(1.8 / -np.log(min(threshold, 0.99))), 1, 12))
    p, count = threshold**rows, LEAST_SHARED
    while (1 - p) ** count + count * p * (1 - p) ** (count - 1) > MISSED:  # none or one of the blocks is whole
        count += 1
    bits = min(rows * count, MARKS)
    apart = (1 - threshold) / 2
    return rows, count, int(np.ceil(bits * apart + SIGMAS * np.sqrt(bits * apart * (1 - apart))))


def class_hashes(words: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram sets and where each begins, and two hashes of each text's set. A text of fewer than n words stands for its whole
    sequence of words, and its hashes are inverted."""
    sets, edge = gram_sets(words, start, n)
    short = np.flatnonzero(edge[1:] == edge[:-1])
    whole = [grams(words[start[i] : start[i + 1]], int(start[i + 1] - start[i]))[0] if start[i + 1] > start[i] else NO_WORDS for i in short.tolist()]
    with np.errstate(over="ignore"):
        one, two = sets * np.uint64(0xD6E8FEB86659FD93), (sets ^ (sets >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        total = lambda x: np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])[edge])
        first, second = (total(one ^ (one >> np.uint64(29))) ^ np.diff(edge).astype(np.uint64)) * MIX, total(two)
        for i, x in zip(short.tolist(), whole):
            first[i], second[i] = ~(x * np.uint64(0xD6E8FEB86659FD93)), x
    return sets, edge, first.view(np.int64), second.view(np.int64)


def slots_of(sets: np.ndarray, edge: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A row for each set that isn't empty: the least of its hashes under each function."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    edge = edge[np.concatenate([[True], np.diff(edge) > 0])]
    out = np.empty((len(factors), len(edge) - 1), np.uint32)
    at = 0
    while at < len(edge) - 1:  # as many sets at a time as the processor's cache holds
        end = max(at + 1, int(np.searchsorted(edge, edge[at] + 32_768)) - 1)
        part, first = x[edge[at] : edge[end]], edge[at:end] - edge[at]
        hashed = np.empty_like(part)
        for j, f in enumerate(factors):
            np.multiply(part, f, out=hashed)
            out[j, at:end] = np.minimum.reduceat(hashed, first)
        at = end
    return out.T


def _fingerprints(n: int, threshold: float):
    rows, count, _ = layout(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED)
        factors = rng.integers(0, 2**31, rows * count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            sets, edge, first, second = class_hashes(*hashed_words(batch.column("text").to_pylist()), n)
            size = np.diff(edge)
            slots = slots_of(sets, edge, factors)
            with np.errstate(over="ignore"):
                block = np.zeros((len(slots), count), np.uint64)
                for i in range(rows):
                    block = (block ^ slots[:, i::rows]) * MIX
                    block ^= block >> np.uint64(31)
                bits = np.zeros((len(slots), MARKS), bool)
                some = slots[:, : bits.shape[1]] * np.uint32(0x9E3779B1)
                bits[:, : some.shape[1]] = some >> np.uint32(31)
            raw = np.concatenate([np.packbits(bits, axis=1), (block >> np.uint64(32)).astype(np.uint32).view(np.uint8).reshape(len(slots), 4 * count)], axis=1)
            to = np.where(size > 0, np.cumsum(size > 0) - 1, -1)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(raw.shape[1]), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())
            columns = [batch.column("key"), pa.array(first), pa.array(second), pa.array(size.astype(np.int32)), packed.take(pa.array(to, mask=to < 0))]  # null for a text without n-grams
            yield pa.RecordBatch.from_arrays(columns, names=["key", "class_1", "class_2", "size", "print"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, edge, first, second = class_hashes(*hashed_words(batch.column("text").to_pylist()), n)
            packed = pa.array([x[a:b].tobytes() for x in (sets.view(np.uint8).reshape(-1, 8)[:, BYTES],) for a, b in each(edge)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("class_id"), pa.array(first), pa.array(second), packed], names=["class_id", "class_1", "class_2", "bits"])

    return run


#: The octets of a hash that are kept to verify: 40 bits.
BYTES = slice(3, 8)


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([_unpack(x) for x in batch.column(c).to_pylist()] for c in ("bits_a", "bits_b"))
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)], np.int64)
            a, b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
            distance = a + b - 2 * common  # Hamming
            ok = pa.array(distance <= (1 - threshold) / (1 + threshold) * (a + b) + 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("class_a").filter(ok), batch.column("class_b").filter(ok), pa.array(common).filter(ok), pa.array(a).filter(ok), pa.array(b).filter(ok)], names=["class_a", "class_b", "common", "size_a", "size_b"])

    return run


def _kept(df: DataFrame) -> DataFrame:
    """``materialize``, and what was shuffled for it goes at once, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return materialize(df)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def _class_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", F.xxhash64("class_1", "class_2")).drop("class_1", "class_2")


def _rows(batch: pa.RecordBatch, blocks: range) -> np.ndarray:
    """The rows of some blocks of classes."""
    raw = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    out = np.empty((batch.num_rows, len(blocks)), ROW)
    out["block"] = (np.array(blocks, np.int64) << 32) + np.ascontiguousarray(raw[:, MARKS // 8 + 4 * blocks.start : MARKS // 8 + 4 * blocks.stop]).view(np.uint32)
    out["id"], out["size"] = batch.column("class_id").to_numpy()[:, None], batch.column("size").to_numpy()[:, None]
    out["marks"] = np.ascontiguousarray(raw[:, : MARKS // 8]).view(np.uint64)[:, None, :]
    return out.ravel()


PACKED = "part int, rows binary"


def _packed(rows: np.ndarray, parts: int) -> pa.RecordBatch:
    """The rows, packed by the part of all blocks that they belong to."""
    with np.errstate(over="ignore"):
        part = ((rows["block"].view(np.uint64) * MIX) >> np.uint64(33)).astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    edge = np.flatnonzero(np.diff(part[order], prepend=-1))
    raw = [rows[order[a:b]].tobytes() for a, b in zip(edge, [*edge[1:], len(order)])]
    return pa.RecordBatch.from_arrays([pa.array(part[order[edge]].astype(np.int32)), pa.array(raw, pa.binary())], names=["part", "rows"])


def _deal(blocks: range, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, MADE // len(blocks))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                yield _packed(_rows(whole.slice(at, step), blocks), parts)

    return run


def _split(count: int, large: np.ndarray, cells: np.ndarray, parts: int):
    """The rows of the ``large`` blocks, which are sorted, in all cells of their part of the block, one for each part it meets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, MADE // count)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                rows = _rows(whole.slice(at, step), range(count))
                to = np.minimum(np.searchsorted(large, rows["block"]), len(large) - 1)
                mine = large[to] == rows["block"]
                rows, many = rows[mine], cells[to[mine]]
                if not len(rows):
                    continue
                mix = lambda x: ((x ^ (x >> np.uint64(29))) * MIX) ^ ((x ^ (x >> np.uint64(29))) * MIX >> np.uint64(32))
                with np.errstate(over="ignore"):
                    own = (mix(rows["id"].view(np.uint64) ^ np.uint64(SEED)) % many.astype(np.uint64)).astype(np.int64)
                end = np.cumsum(many)
                for first in range(0, int(end[-1]), MADE):
                    place = np.arange(first, min(first + MADE, int(end[-1])))
                    i = np.searchsorted(end, place, "right")
                    other, half = place - (end[i] - many[i]), own[i]
                    out = np.empty(len(i), CELL)
                    for c in ("id", "size", "marks"):
                        out[c] = rows[c][i]
                    with np.errstate(over="ignore"):
                        pair = (np.minimum(half, other).astype(np.uint64) << np.uint64(32)) + np.maximum(half, other).astype(np.uint64)
                        out["block"] = mix(mix(rows["block"][i].view(np.uint64)) + pair).view(np.int64)
                    out["side"] = np.where(half == other, -1, half > other)
                    yield _packed(out, parts)

    return run


MET = "class_a bigint, class_b bigint, block bigint, members bigint"


def _meet(rows: np.ndarray, threshold: float, most: int, half: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Pairs of one block of at most ``most`` rows whose bits are near, each a row; of a larger block only its name and size. With ``half``,
    only pairs across the halves of a block."""
    names, apart = [x.split()[0] for x in MET.split(", ")], layout(threshold)[2]
    order = np.argsort(rows["block"])
    block = rows["block"][order]
    edge = np.flatnonzero(np.concatenate([[True], np.diff(block) != 0, [True]]))
    members = np.diff(edge)
    large = np.flatnonzero(members > most)
    if len(large):
        none = pa.nulls(len(large), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(block[edge[large]]), pa.array(members[large])], names=names)
    some = (members > 1) & (members <= most)
    order, members = order[np.repeat(some, members)], members[some]
    rows = rows[order]
    half = half[order] if half is not None else None
    ids, size, marks = (np.ascontiguousarray(rows[c]) for c in ("id", "size", "marks"))
    later = np.repeat(np.cumsum(members), members) - np.arange(len(rows)) - 1  # rows of the same block behind each
    at, step = np.flatnonzero(later), 1
    while len(at):
        for first in range(0, len(at), 1 << 17):
            i = at[first : first + (1 << 17)]
            j = i + step
            near = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
            if half is not None:
                near &= half[i] != half[j]
            i, j = i[near], j[near]
            near = np.bitwise_count(marks[i] ^ marks[j]).sum(axis=1, dtype=np.int32) <= apart
            i, j = ids[i[near]], ids[j[near]]
            if len(i):
                none = pa.nulls(len(i), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), none, none], names=names)
        step += 1
        at = at[later[at] >= step]


def _parts(threshold: float, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = [np.frombuffer(x, ROW) for batch in batches for x in batch.column("rows").to_pylist()]
        if raw:
            yield from _meet(np.concatenate(raw), threshold, most)

    return run


def _cells(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = [np.frombuffer(x, CELL) for batch in batches for x in batch.column("rows").to_pylist()]
        if raw:
            rows = np.concatenate(raw)
            across = rows["side"] >= 0
            for part in (rows[~across], rows[across]):
                if len(part):
                    yield from _meet(part, threshold, len(part), part["side"] if part["side"][0] >= 0 else None)

    return run


def _sharing(classes: DataFrame, threshold: float, most: int) -> DataFrame:
    """``class_a, class_b`` of the candidates, by blocks."""
    spark, count, rows = classes.sparkSession, layout(threshold)[1], max(1, classes.count())
    each_round, met = max(-(-count // ROUNDS), DEALT // rows), []
    for first in range(0, count, each_round):
        blocks = range(first, min(first + each_round, count))
        parts = partitions_for(spark, rows * len(blocks), HELD)
        met.append(_kept(classes.mapInArrow(_deal(blocks, parts), PACKED).repartitionById(parts, "part").mapInArrow(_parts(threshold, most), MET)))
    whole = functools.reduce(DataFrame.unionByName, met)
    large = whole.where("members is not null").select("block", "members").toArrow()  # no more than rows * count / most
    if large.num_rows:  # every two parts of such a block meet in a cell of their own
        order = np.argsort(large["block"].to_numpy())
        members = large["members"].to_numpy()[order]
        cells = -(-members // (4 * most))
        parts = partitions_for(spark, int((members * cells).sum()), HELD)
        met.append(_kept(classes.mapInArrow(_split(count, large["block"].to_numpy()[order], cells, parts), PACKED).repartitionById(parts, "part").mapInArrow(_cells(threshold), MET)))
        whole = whole.where("members is null").unionByName(met[-1])
    close = _kept(whole.groupBy("class_a", "class_b").agg(F.count("*").alias("shared")).where(F.col("shared") >= LEAST_SHARED).select("class_a", "class_b"))
    for x in met:
        forget(x)
    return close


def _meeting(sets: DataFrame, threshold: float) -> DataFrame:
    """The same by the rarest n-grams, for ``sets(class_id, bits)``; loses nothing."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                x = [_unpack(r) for r in batch.column("bits").slice(at, 256).to_pylist()]
                size = np.array([len(r) for r in x], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("class_id").slice(at, 256).to_numpy(), size)), pa.array(np.repeat(size, size)), pa.array(np.concatenate(x).view(np.int64))], names=["class_id", "size", "gram"])

    one = _kept(sets.mapInArrow(spread, "class_id bigint, size bigint, gram bigint"))
    often = one.groupBy("gram").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("class_id").orderBy("n", "gram"))
    first = one.join(often, "gram").withColumn("place", place).where((F.col("place") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1) & (F.col("n") > 1))
    side = lambda s: first.select("gram", F.col("class_id").alias(f"class_{s}"), F.col("size").alias(f"size_{s}"))
    sizes = F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b") - 1e-9
    return side("a").join(side("b"), "gram").where((F.col("class_a") < F.col("class_b")) & sizes).select("class_a", "class_b").distinct()


def near_duplicates(texts: DataFrame, threshold: float = 0.8, n: int = 5, exact: bool = False, most_in_block: int = 4096) -> NearDuplicates:
    """``texts(key, text)``: classes of equal fingerprints and the close pairs between them."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = texts.select("key", F.coalesce("text", F.lit("")).alias("text")).where("key is not null")
    key_type = rows.schema["key"].dataType.simpleString()
    prints = _kept(_class_id(rows.mapInArrow(_fingerprints(n, threshold), f"key {key_type}, class_1 bigint, class_2 bigint, size int, print binary")).withColumnRenamed("id", "class_id"))
    members = prints.groupBy("key").agg(F.min(F.struct((F.col("size") == 0).alias("short"), "class_id"))["class_id"].alias("class_id"))  # the texts themselves are never shuffled
    full = prints.where("size > 0")
    if exact:
        need = full.groupBy("class_id").agg(F.min("key").alias("key"))
    else:
        # copies fold before the shuffle: all rows of a class are alike
        classes = _kept(full.groupBy("class_id").agg(F.first("size").alias("size"), F.first("print").alias("print")))
        close = _sharing(classes, threshold, most_in_block)
        forget(classes)
        need = close.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).distinct()
        need = full.select("class_id", "key").join(need, "class_id", "left_semi").groupBy("class_id").agg(F.min("key").alias("key"))
    sets = _class_id(rows.join(_kept(need), "key").mapInArrow(_sets(n), "class_id bigint, class_1 bigint, class_2 bigint, bits binary")).where("id = class_id").groupBy("class_id").agg(F.max("bits").alias("bits"))
    sets = _kept(sets)
    if exact:
        close = _meeting(sets, threshold)
    bits = lambda s: sets.select(F.col("class_id").alias(f"class_{s}"), F.col("bits").alias(f"bits_{s}"))
    pairs = close.join(bits("a"), "class_a").join(bits("b"), "class_b").mapInArrow(_verify(threshold), "class_a bigint, class_b bigint, common bigint, size_a bigint, size_b bigint")
    return NearDuplicates(members, pairs, full.select("class_id").distinct())


def near_pairs(found: NearDuplicates) -> DataFrame:
    """All pairs of keys, ``key_a < key_b``, expanded from the classes."""
    links = found.pairs.select("class_a", "class_b").unionByName(found.classes.select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b")))
    side = lambda s: found.members.select(F.col("key").alias(f"k{s}"), F.col("class_id").alias(f"class_{s}"))
    both = links.join(side("a"), "class_a").join(side("b"), "class_b").where("ka <> kb")
    return both.where((F.col("class_a") != F.col("class_b")) | (F.col("ka") < F.col("kb"))).select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))


def note_texts(notes: DataFrame) -> DataFrame:
    """path and the text that is compared: description if any, newline, body."""
    return notes.select(F.col("path").alias("key"), F.concat(F.coalesce(F.try_element_at("fields", F.lit("description")), F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))).alias("text"))
