"""Vectors in Arrow batches: reading, scoring, normalising."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def usable_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions of the vectors of ``dim`` finite numbers that aren't all zero, and the numbers in double."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(sizes == dim)
    if not len(at):
        return at, np.zeros((0, dim))
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return at[ok], x[ok]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All cosines between two sets of rows; 0 where a norm is 0."""
    a, b = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (x @ y.T) / np.outer(a, b)
    return np.where(np.outer(a > 0, b > 0), s, 0.0)


def usable(column: str = "embedding", dim: int = 64):
    """The same test as a column, for filters beside other expressions."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(x) == dim) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def cosine(a, b):
    """The cosine of two array columns in double precision; numbers beyond the shorter one are ignored."""
    add = lambda s, v: s + v
    total = lambda x: F.aggregate(x, F.lit(0.0), add)
    dot = total(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))))
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v.cast("double"))))
    both = norm(a) * norm(b)
    return F.when(both > 0, dot / both).otherwise(F.lit(0.0))


def in_blocks(queries: DataFrame, most: int, ask: Callable[[DataFrame], DataFrame], key: str = "qid") -> DataFrame:
    """``ask`` of all queries at once if they are at most ``most``, else of blocks of them by a hash of their key, and the union of
    the answers: what one block sends to the executors stays bounded however many queries there are."""
    n = queries.count()
    if n <= most:
        return ask(queries)
    kept, blocks = materialize(queries), -(-n * 5 // (most * 4))  # blocks differ in size: a fifth is left free
    out = None
    for i in range(blocks):
        part = ask(kept.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i))
        out = part if out is None else out.unionByName(part)
    return out


def _gathered(queries: DataFrame, dim: int) -> tuple[list, np.ndarray]:
    """Ids and numbers of a block of queries."""
    few = queries.select("qid", "embedding").toArrow()
    at, q = usable_rows(few["embedding"].combine_chunks(), dim) if few.num_rows else (np.zeros(0, int), np.zeros((0, dim)))
    return few["qid"].take(pa.array(at, pa.int64())).to_pylist(), q


def score_against(vectors: DataFrame, queries: DataFrame, dim: int = 64, keep: int | None = None, most_queries: int = 65_536) -> DataFrame:
    """``qid, path, ordinal, question_no, score`` of the best vector of each note of a batch for each of
    ``queries(qid, embedding)``; with ``keep`` only of the batch's ``keep`` best notes, which is all that a ranking of that
    length can need. The queries go to the executors in blocks of at most ``most_queries``, and the vectors are scanned once for
    each block."""
    return in_blocks(queries, most_queries, lambda block: _score_block(vectors, block, dim, keep))


def _score_block(vectors: DataFrame, queries: DataFrame, dim: int, keep: int | None) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(_gathered(queries, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        ids = np.array(ids, np.int64)
        for batch in batches:
            at, x = usable_rows(batch.column("embedding"), dim)
            if not len(at) or not len(ids):
                continue
            rows = batch.take(pa.array(at))
            code = np.unique(rows.column("path").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
            ordinal, question = (np.asarray(rows.column(c).fill_null(-1)) for c in ("ordinal", "question_no"))
            order = np.lexsort((question, ordinal, code))
            start = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0]))
            size = np.diff(np.append(start, len(order)))
            for block in range(0, len(ids), 256):
                score = cosines(x[order], q[block : block + 256])
                best = np.maximum.reduceat(score, start, axis=0)
                hit = np.ones(best.shape, bool)
                if keep is not None and keep < len(start):
                    hit = best >= np.partition(best, -keep, axis=0)[-keep]
                j, note = np.nonzero(hit.T)
                # of each note's rows the first with the best score
                edge = np.cumsum(size[note]) - size[note]
                at = np.arange(int(size[note].sum())) - np.repeat(edge - start[note], size[note])
                first = np.minimum.reduceat(np.where(score[at, np.repeat(j, size[note])] == np.repeat(best[note, j], size[note]), at, len(order)), edge)
                take = pa.array(order[first])
                yield pa.RecordBatch.from_arrays([pa.array(ids[block + j]), rows.column("path").take(take), rows.column("ordinal").take(take), rows.column("question_no").take(take), pa.array(score[first, j])], names=["qid", "path", "ordinal", "question_no", "score"])

    kept = vectors.select("path", "ordinal", "question_no", "embedding").where("path is not null")
    return kept.mapInArrow(run, "qid bigint, path string, ordinal int, question_no int, score double")


def alike(rows: DataFrame, queries: DataFrame, least: float = -1.0, keep: int | None = None, dim: int = 64, most_queries: int = 65_536) -> DataFrame:
    """``key, qid, sim`` for each of ``rows(key, embedding)`` and each query whose cosine is at least ``least``; with
    ``keep`` only the ``keep`` best keys of each batch and query (and those equal to the last), all that a list of that length can need."""
    return in_blocks(queries, most_queries, lambda block: _alike_block(rows, block, least, keep, dim))


def _alike_block(rows: DataFrame, queries: DataFrame, least: float, keep: int | None, dim: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(_gathered(queries, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        ids = np.array(ids, np.int64)
        for batch in batches:
            at, x = usable_rows(batch.column("embedding"), dim)
            key = batch.column("key").take(pa.array(at))
            once = np.unique(key.to_numpy(zero_copy_only=False).astype(str), return_index=True)[1] if len(at) else at  # a repeated row counts once
            key, x = key.take(pa.array(once)), x[once]
            for block in range(0, len(ids) if len(once) else 0, 256):
                score = cosines(x, q[block : block + 256])
                hit = score >= least
                if keep is not None and keep < len(x):
                    hit &= score >= np.partition(score, -keep, axis=0)[-keep]
                i, j = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([key.take(pa.array(i)), pa.array(ids[block + j]), pa.array(score[i, j])], names=["key", "qid", "sim"])

    key = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "embedding").where("key is not null").mapInArrow(run, f"key {key}, qid bigint, sim double")
