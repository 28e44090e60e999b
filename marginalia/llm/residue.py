"""Template residue, error pages and notices (problem 9).

Rules (``residue_rules``) name what they are sure of: texts that hold nothing but
residue and frame are trusted residue, texts with several sentences that refer to something of their own (notes, tickets, names
in code) are trusted content, which nothing further in them could change. What is left is unknown, texts with code or with any number of other sentences too. All texts, trusted content too,
get a SimHash of their five-word shingles, all of them, in a normal form in which fills of one template agree; equal normal forms are one class. The hash is cut into blocks, one table for
each: a labelled class looks up its own value of every block and all values one bit away. Length, number of blocks and Hamming
radius come from the Jaccard similarity asked for (``layout``): a pair exactly at it is a candidate with probability 0.9995
(at 0.8: 41 blocks of 20 bits, radius 176 of 820), a closer one with more. Every vote of a shingle is a byte and not
a bit, so that small sets follow the same law. Candidates are verified by Hamming distance and then by the Jaccard
similarity of their shingles. From the trusted classes the label then spreads through the connected components of these
links: a class that is linked to a labelled one is labelled, until no more are, unless it is as similar to trusted content (an unknown text
with the normal form of trusted content is). Links between two labelled classes are never made; trusted content is never reported and passes no label on.

Defined results: a null text or id takes no part; an empty text, or one with nothing but frame, is unknown and so
not reported unless linked; repeated rows count once; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, materialize
from .residue_rules import MESSAGE, kind
from .words import MIX, each, gram_sets, grams, hashed_words

SHINGLE = 5
WIDTH = 20  # bits of a block
MISSED = 0.0005  # of the pairs exactly at the similarity
SEED = 20240417


def layout(similarity: float) -> tuple[int, int]:
    """Blocks, and the Hamming radius over all their bits. Sets of equal size are the worst case: their cosine is 2t / (1 + t)."""
    apart = float(np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi)  # the share of bits that differ
    hit = (1 - apart) ** WIDTH + WIDTH * apart * (1 - apart) ** (WIDTH - 1)  # no bit of a block differs, or one
    count = int(np.ceil(np.log(MISSED) / np.log(max(1 - hit, 1e-9))))
    bits = count * WIDTH
    return count, int(np.ceil(bits * apart + 5 * np.sqrt(bits * apart * (1 - apart))))


#: First bit and width of each block at the default similarity.
BLOCKS = tuple((i * WIDTH, WIDTH) for i in range(layout(0.8)[0]))


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each text, sorted, in one array, and where each begins; a shorter text is one shingle."""
    words, start = hashed_words(texts)
    sets, edge = gram_sets(words, start, SHINGLE)
    short = np.flatnonzero((np.diff(edge) == 0) & (np.diff(start) > 0))
    whole = [grams(words[start[i] : start[i + 1]], int(start[i + 1] - start[i]))[0] for i in short.tolist()]
    return np.insert(sets, edge[short], np.array(whole, np.uint64)), edge + np.concatenate([[0], np.cumsum(np.isin(np.arange(len(texts)), short))])


def simhashes(sets: np.ndarray, edge: np.ndarray, bits: int) -> np.ndarray:
    """The bits of the hash of each set, none of them empty. Each feature votes with one byte for each bit; a bit is set if its votes are
    above their mean. Bytes are added four at a time in the 16-bit lanes of a number, for at most 256 features, then those sums."""
    salt = np.random.default_rng(SEED).integers(0, 2**63, -(-bits // 8), dtype=np.uint64)
    out = np.empty((len(edge) - 1, len(salt), 8), bool)
    lanes, at = np.uint64(0x00FF00FF00FF00FF), 0
    while at < len(edge) - 1:  # as many sets at a time as the processor's cache holds
        end = max(at + 1, int(np.searchsorted(edge, edge[at] + 16_384)) - 1)
        part, first = sets[edge[at] : edge[end]], edge[at:end] - edge[at]
        size = edge[at + 1 : end + 1] - edge[at:end]
        runs = -(-size // 256)
        run_of = np.cumsum(runs) - runs  # the first run of each set
        starts = np.repeat(first, runs) + 256 * (np.arange(int(runs.sum())) - np.repeat(run_of, runs))
        with np.errstate(over="ignore"):
            for j, s in enumerate(salt):
                x = (part ^ s) * MIX
                x ^= x >> np.uint64(32)
                x *= np.uint64(0xD6E8FEB86659FD93)
                x ^= x >> np.uint64(32)
                votes = [np.add.reduceat(y & lanes, starts).view(np.uint16).reshape(-1, 4) for y in (x, x >> np.uint64(8))]
                for k, v in enumerate(votes):
                    out[at:end, j, k::2] = 2 * np.add.reduceat(v, run_of, axis=0, dtype=np.int64) > 255 * size[:, None]
        at = end
    return out.reshape(len(out), -1)[:, :bits]


def _read(message: re.Pattern):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, normals = zip(*(kind(x, message) for x in batch.column("text").to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kinds, pa.string()), pa.array(normals, pa.string())], names=["doc_id", "kind", "normal"])

    return run


def _shingles_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets([x.replace("¤", " slot ") for x in batch.column("normal").to_pylist()])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets, edge = _shingles_of(batch)
        yield pa.RecordBatch.from_arrays([batch.column("class_id"), pa.array([sets[a:b].tobytes() for a, b in each(edge)], pa.binary())], names=["class_id", "shingles_b"])


def _hash(bits: int):
    """Of trusted content, whose label is null, no shingles: they are made again where a link asks for them (``_shingles``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, edge = _shingles_of(batch)
            keep = np.flatnonzero(np.diff(edge))
            edge = edge[np.append(keep, len(edge) - 1)]  # no words, no hash
            at = pa.array(keep)
            marks = pa.array([x.tobytes() for x in np.packbits(simhashes(sets, edge, bits), axis=1)], pa.binary())
            sizes, labelled = pa.array(np.diff(edge).astype(np.int32)), batch.column("labelled").take(at)
            shingles = pa.array([sets[a:b].tobytes() if known else None for (a, b), known in zip(each(edge), labelled.is_valid().to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("class_id").take(at), labelled, sizes, marks, shingles], names=["class_id", "labelled", "size", "mark", "shingles"])

    return run


def blocks_of(marks: list[bytes], count: int) -> np.ndarray:
    """The key of each block of each hash: the table's number, then the block's bits."""
    bits = np.unpackbits(np.frombuffer(b"".join(marks), np.uint8).reshape(len(marks), -1), axis=1)[:, : count * WIDTH]
    return bits.reshape(len(marks), count, WIDTH) @ (np.int64(1) << np.arange(WIDTH)) + (np.arange(count) << WIDTH)


def _tables(count: int, probes: bool):
    """A row for each class and block; with ``probes`` also for each value one bit away."""
    flips = np.concatenate([[0], np.int64(1) << np.arange(WIDTH)]) if probes else np.zeros(1, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                keys = (blocks_of(batch.column("mark").to_pylist(), count)[:, :, None] ^ flips).reshape(batch.num_rows, -1)
                repeated = (np.repeat(batch.column(c).to_numpy(), keys.shape[1]) for c in ("class_id", "size"))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *map(pa.array, repeated)], names=["block", "class_id", "size"])

    return run


def _within(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("mark_a", "mark_b"))
                ok = pa.array(np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= radius)
                yield pa.RecordBatch.from_arrays([batch.column("class_id").filter(ok), batch.column("class_a").filter(ok)], names=["class_id", "class_a"])

    return run


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = np.zeros(batch.num_rows)
            for i, (a, b) in enumerate(zip(batch.column("shingles_a").to_pylist(), batch.column("shingles_b").to_pylist())):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                share[i] = common / (len(x) + len(y) - common)
            ok = pa.array(share >= least - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column("class_id").filter(ok), batch.column("class_a").filter(ok), pa.array(share).filter(ok)], names=["class_id", "class_a", "share"])

    return run


def _links(unknown: DataFrame, frontier: DataFrame, similarity: float, normals: DataFrame | None = None) -> DataFrame:
    """``class_id, class_a, share``: the classes of ``unknown`` that are similar to one of ``frontier``, to which, and their Jaccard similarity.
    With ``normals(class_id, normal)`` the shingles of ``unknown`` are made from these."""
    count, radius = layout(similarity)
    a = frontier.select("class_id", "size", "mark").mapInArrow(_tables(count, True), "block bigint, class_a bigint, size_a int")
    b = unknown.select("class_id", "size", "mark").mapInArrow(_tables(count, False), "block bigint, class_id bigint, size int")
    sizes = F.least("size", "size_a") >= similarity * F.greatest("size", "size_a") - 1e-9
    near = b.join(a, "block").where(sizes).select("class_id", "class_a").distinct()
    of = lambda c, side: (unknown.select("class_id", F.col(c).alias(f"{c}_b")) if side == "b" else frontier.select(F.col("class_id").alias("class_a"), F.col(c).alias(f"{c}_a")))
    near = near.join(of("mark", "b"), "class_id").join(of("mark", "a"), "class_a").select("class_id", "class_a", "mark_a", "mark_b").mapInArrow(_within(radius), "class_id bigint, class_a bigint")
    if normals is None:
        shingles = of("shingles", "b")
    else:
        near = materialize(near)
        asked = normals.join(near.select("class_id").distinct(), "class_id", "left_semi").groupBy("class_id").agg(F.min("normal").alias("normal"))
        shingles = asked.mapInArrow(_shingles, "class_id bigint, shingles_b binary")
    sides = near.join(shingles, "class_id").join(of("shingles", "a"), "class_a")
    return sides.select("class_id", "class_a", "shingles_a", "shingles_b").mapInArrow(_similar(similarity), "class_id bigint, class_a bigint, share double")


def _linked(unknown: DataFrame, frontier: DataFrame, similarity: float) -> DataFrame:
    """``class_id``: the classes of ``unknown`` that are similar to one of ``frontier``."""
    return _links(unknown, frontier, similarity).select("class_id").distinct()


def _reached(unknown: DataFrame, frontier: DataFrame, own: DataFrame, normals: DataFrame, similarity: float) -> DataFrame:
    """The classes of ``unknown`` that are more similar to one of ``frontier`` than to any of ``own``, whose texts ``normals`` has."""
    near = materialize(_links(unknown, frontier, similarity).groupBy("class_id").agg(F.max("share").alias("share")))
    if near.isEmpty():
        return unknown.limit(0)
    asked = materialize(unknown.join(near.select("class_id"), "class_id", "left_semi"))
    content = _links(own, asked, similarity, normals).groupBy(F.col("class_a").alias("class_id")).agg(F.max("share").alias("content"))
    return asked.join(near.join(content, "class_id", "left").where("content is null or share > content").select("class_id"), "class_id", "left_semi")


def residue(documents: DataFrame, similarity: float = 0.8, message: re.Pattern = MESSAGE) -> DataFrame:
    """``doc_id, reason``: the documents that are residue, by ``rule`` or by ``link`` to one that is. ``message`` is the rule for whole
    sentences; what a shorter list misses is left to the links."""
    rows = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    read = materialize(rows.mapInArrow(_read(message), "doc_id bigint, kind string, normal string").withColumn("class_id", F.xxhash64("normal")))
    # trusted content is neither labelled nor not: null
    label = F.when(F.max(F.col("kind") == "residue"), True).when(~F.max(F.col("kind") == "content"), False)
    classes = read.groupBy("class_id").agg(F.min("normal").alias("normal"), label.alias("labelled"))
    hashed = materialize(classes.mapInArrow(_hash(layout(similarity)[0] * WIDTH), "class_id bigint, labelled boolean, size int, mark binary, shingles binary"))
    labelled = read.where("kind = 'residue'").select("class_id").distinct()  # unknown texts may have the normal form of a residue
    frontier, unknown, own = (hashed.where(x).drop("labelled") for x in ("labelled", "not labelled", "labelled is null"))
    spent = None
    while True:  # each round takes classes from the unknown ones, or is the last
        new = materialize(_reached(unknown, frontier, own, read.where("kind = 'content'").select("class_id", "normal"), similarity))
        if new.isEmpty():
            break
        labelled = labelled.unionByName(new.select("class_id"))
        unknown = materialize(unknown.join(new.select("class_id"), "class_id", "left_anti"))
        frontier = new
        if spent is not None:
            forget(spent)  # nothing reads it any more
        spent = unknown
    in_component = read.where("kind <> 'content'").join(labelled, "class_id", "left_semi")
    return in_component.groupBy("doc_id").agg(F.max(F.when(F.col("kind") == "residue", "rule").otherwise("link")).alias("reason"))
