"""The k most similar vectors for every vector, by collision counting (problem 2).

Every vector goes to the cell of its nearest centroid, and also to other cells nearly as near, so that the
cells overlap. Inside a cell the vectors are projected on single random directions, and for each direction
sorted. Around each query a window opens in every sorted array; a vector that lies in enough of a query's
windows (the collision threshold) is verified by its cosine in double precision. Queries are taken in the order of one more array, along the cell's widest
direction, where the window is as wide as the radius and so holds every vector within it: the others are skipped. A query whose k-th verified
neighbour isn't well inside the window's radius is asked again with the windows doubled (virtual rehashing:
the arrays stay, only the windows widen), until it is, or the windows hold the whole cell.

The centroids are fitted on a bounded sample (``sample_rows``, a documented parameter) by splitting it until
every leaf stands for about ``leaf`` rows, so dense regions get more cells. All rows are indexed and asked. A cell that comes out larger than
``most_rows`` all the same is cut into cells again where it is answered.
Only the ``k + 1`` smallest ids of a group of exact copies are needed as answers; the other copies get their
answers by one join, so a group of copies costs no more than its size.

Defined results: a vector is usable if it has exactly ``dim`` finite numbers, not all zero; others (and null ids
or vectors) neither ask nor answer; a repeated id counts once; equal scores go by the smaller id; fewer than k
others give fewer answers; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import usable
from ..session import materialize

SEED = 20240229
DIRECTIONS = 16
#: Windows that must hold a vector before it is verified, of DIRECTIONS.
THRESHOLD = 12
SCHEMA = "vec_a bigint, vec_b bigint, score double"


def as_matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows' positions and their numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(sizes == dim)
    if not len(at):
        return at, np.zeros((0, dim), np.float32)
    values = column.take(pa.array(at)).flatten()
    x = values.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)  # nulls become NaN
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return at[ok], x[ok]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def fit_cells(sample: np.ndarray, leaf_rows: int) -> np.ndarray:
    """Centroids of a tree of 2- to 16-means over the sample, each leaf at most leaf_rows of it. Each node is centred on its own mean, so
    that rows that differ little from each other are told apart too."""
    rng, leaves, open_ = np.random.default_rng(SEED), [], [sample.astype(np.float64)]
    while open_:
        rows = open_.pop()
        middle = rows.mean(axis=0)
        if len(rows) <= leaf_rows:
            leaves.append(middle)
            continue
        ways = int(np.clip(np.ceil(len(rows) / leaf_rows), 2, 16))
        near = rows - middle
        centre = near[rng.choice(len(near), ways, replace=False)]
        for _ in range(6):
            own = np.argmax(near @ centre.T - (centre**2).sum(axis=1) / 2, axis=1)
            centre = np.array([near[own == i].mean(axis=0) if (own == i).any() else near[rng.integers(len(near))] for i in range(ways)])
        own = np.argmax(near @ centre.T - (centre**2).sum(axis=1) / 2, axis=1)
        parts = [rows[own == i] for i in range(ways) if (own == i).any()]
        if len(parts) == 1:  # the rows are all alike
            leaves.append(middle)
        else:
            open_ += parts
    return np.array(leaves)


def cells_of(u: np.ndarray, centres: np.ndarray, slack: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, cells and the cell's place in the row's order, 0 for its nearest: the nearest cell and up to ``most`` in all whose squared distance is at most
    ``slack`` times the least. In blocks, so that the distances in memory stay bounded however many cells there are."""
    half, step = ((centres**2).sum(axis=1) / 2)[None, :], max(16, (1 << 21) // len(centres))
    for at in range(0, len(u), step):
        apart = 1 + 2 * (half - u[at : at + step] @ centres.T)  # squared distances
        row, col = np.nonzero(apart <= np.maximum(apart.min(axis=1, keepdims=True), 1e-14) * slack)
        by = np.lexsort((col, apart[row, col], row))
        row, col = row[by], col[by]
        size = np.bincount(row, minlength=len(apart))
        place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
        yield at + row[place < most], col[place < most], place[place < most]


def _assign(centres, dim: int, slack: float, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = as_matrix(batch.column("embedding"), dim)
            ids = batch.column("vec_id").take(pa.array(at)).to_numpy(zero_copy_only=False)
            for row, col, place in cells_of(unit(x), centres.value, slack, most):
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim * 4), len(row), [None, pa.py_buffer(np.ascontiguousarray(x[row]))])
                yield pa.RecordBatch.from_arrays([pa.array(col.astype(np.int32)), pa.array(place == 0), pa.array(ids[row]), raw.cast(pa.binary())], names=["cell", "asks", "vec_id", "raw"])

    return run


def collide(asked: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each asked row of x its k most similar other rows: positions asked and found, and scores.
    ids must be distinct; x holds the numbers as stored."""
    n, dim = x.shape
    u = unit(x)
    k = min(k, n - 1)
    if k <= 0:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    # The leading array is sorted along the direction in which the cell is widest. No row within the radius lies outside the window there, so
    # only the stretch between the windows of neighbouring queries is looked at.
    _, axes = np.linalg.eigh(np.cov(u.T))
    lead = u @ axes[:, -1]
    by_lead = np.argsort(lead, kind="stable")
    lead, u, ids = lead[by_lead], u[by_lead], ids[by_lead]
    place_of = np.empty(n, np.int64)
    place_of[by_lead] = np.arange(n)
    rng = np.random.default_rng(SEED)
    shadow = (u @ rng.standard_normal((dim, DIRECTIONS))).T.copy()  # one row for each direction
    order = np.argsort(shadow, axis=1, kind="stable")
    lines = np.take_along_axis(shadow, order, axis=1)  # the sorted arrays
    rank = np.empty_like(order, dtype=np.uint32)
    np.put_along_axis(rank, order, np.arange(n, dtype=np.uint32)[None, :].repeat(DIRECTIONS, 0), axis=1)
    probe = u[rng.choice(n, min(n, 48), replace=False)]
    near = np.sort(2 - 2 * probe @ u.T, axis=1)[:, k]
    radius = float(np.sqrt(max(np.median(near), 1e-14)))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    todo = np.sort(place_of[np.asarray(asked)])
    while len(todo):
        width, reach, again = 2.2 * radius, radius * (1 + 1e-6) + 1e-12, []
        for at in range(0, len(todo), block):
            q = todo[at : at + block]
            left, right = int(np.searchsorted(lead, lead[q[0]] - reach)), int(np.searchsorted(lead, lead[q[-1]] + reach, side="right"))
            count = np.zeros((len(q), right - left), np.uint8)
            whole = np.full(len(q), left == 0 and right == n)
            for j in range(DIRECTIONS):
                low = np.searchsorted(lines[j], shadow[j, q] - width).astype(np.uint32)
                high = np.searchsorted(lines[j], shadow[j, q] + width, side="right").astype(np.uint32)
                whole &= (low == 0) & (high == n)
                count += (rank[j][None, left:right] - low[:, None]) < (high - low)[:, None]  # wraps below the window
            hit = count >= THRESHOLD
            hit[whole] = True
            hit[np.arange(len(q)), q - left] = False
            if right - left > k and np.count_nonzero(hit) * 16 > hit.size:  # many: the best come from one product, within its error
                score = np.where(hit, u[q] @ u[left:right].T, -3.0)
                hit &= score >= np.partition(score, right - left - k, axis=1)[:, [right - left - k]] - 1e-12
            row, col = np.nonzero(hit)
            col += left
            score = np.einsum("ij,ij->i", u[q[row]], u[col])
            by = np.lexsort((ids[col], -score, row))
            row, col, score = row[by], col[by], score[by]
            size = np.bincount(row, minlength=len(q))
            start = np.cumsum(size) - size
            place = np.arange(len(row)) - start[row]
            kth = np.full(len(q), -2.0)
            enough = size >= k
            kth[enough] = score[(start + k - 1)[enough]]
            done = whole | (enough & (2 - 2 * kth <= radius**2))
            take = done[row] & (place < k)
            out.append((by_lead[q[row[take]]], by_lead[col[take]], score[take]))
            again.append(q[~done])
        todo, radius = np.concatenate(again), radius * 2
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def answer_cell(asked: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, leaf: int, slack: float, most_cells: int, most_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same for a cell of any size: one of more than ``most_rows`` is cut into cells of its own, which overlap too."""
    n = len(x)
    if n > most_rows:
        u = unit(x)
        sample = u[np.random.default_rng(SEED).choice(n, min(n, 16_384), replace=False)]
        centres = fit_cells(sample, max(1, round(leaf * len(sample) / n)))
        row, col, place = (np.concatenate(c) for c in zip(*cells_of(u, centres, slack, most_cells)))
        if (size := np.bincount(col)).max() < n:
            by = np.argsort(col, kind="stable")
            asks = np.zeros(n, bool)
            asks[asked] = True
            for at, rows in zip(np.cumsum(size) - size, size):
                if rows:
                    of = by[at : at + rows]
                    mine = row[of]
                    for a, b, score in answer_cell(np.flatnonzero(asks[mine] & (place[of] == 0)), x[mine], ids[mine], k, leaf, slack, most_cells, most_rows):
                        yield mine[a], mine[b], score
            return
    yield collide(asked, x, ids, k)


def _answer(dim: int, k: int, *bounds):
    def run(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        asks = table["asks"].to_numpy(zero_copy_only=False)
        first = np.lexsort((~asks, ids))  # a repeated id counts once
        first = first[np.concatenate([[True], ids[first][1:] != ids[first][:-1]])]
        raw = table["raw"].combine_chunks().take(pa.array(first))
        x = np.frombuffer(b"".join(raw.to_pylist()), np.float32).reshape(-1, dim)
        ids, asks = ids[first], asks[first]
        a, b, score = (np.concatenate(c) for c in zip(*answer_cell(np.flatnonzero(asks), x, ids, k, *bounds)))
        return pa.table([pa.array(ids[a]), pa.array(ids[b]), pa.array(score)], names=["vec_a", "vec_b", "score"])

    return run


def nearest_vectors(vectors: DataFrame, k: int = 5, dim: int = 64, leaf: int = 400, sample_rows: int = 131_072, slack: float = 1.35, most_cells: int = 4, most_rows: int = 8192) -> DataFrame:
    """``vectors(vec_id, embedding)``: for every usable vector its k most similar others, as
    ``vec_a`` (the one that asks), ``vec_b``, ``score``."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(dim=dim))
    n = rows.count()
    share = min(1.0, max(sample_rows, 1) * 0.9 / max(n, 1))
    picked = rows.select("embedding").where(F.rand(SEED) < share) if share < 1 else rows.select("embedding")
    sample = unit(as_matrix(picked.limit(sample_rows).toArrow()["embedding"], dim)[1]) if n else np.zeros((0, dim))
    centres = fit_cells(np.unique(sample, axis=0), max(1, round(leaf * len(sample) / max(n, 1)))) if len(sample) else np.zeros((1, dim))
    shared = spark.sparkContext.broadcast(centres)  # at most sample_rows rows

    # Exact copies: only the k + 1 smallest ids ask and answer in the cells. The ranking is cut before its shuffle.
    copies = rows.select(F.xxhash64("embedding").alias("copy"), "vec_id").distinct()
    spare = copies.groupBy("copy").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("copy")
    many = copies.join(spare, "copy", "left_semi")
    lead = many.select("copy", "vec_id", F.row_number().over(_by_copy()).alias("place")).where(F.col("place") <= k + 1).groupBy("copy").agg(F.max("vec_id").alias("last"), F.sort_array(F.collect_list("vec_id")).alias("first"))
    rest = materialize(many.join(lead, "copy").where("vec_id > last"))
    asked = rows if rest.isEmpty() else rows.join(rest.select("vec_id"), "vec_id", "left_anti")
    cells = asked.mapInArrow(_assign(shared, dim, slack, most_cells), "cell int, asks boolean, vec_id bigint, raw binary")
    found = cells.groupBy("cell").applyInArrow(_answer(dim, k, max(leaf, most_rows // 4), slack, most_cells, most_rows), SCHEMA)
    of_copies = rest.select(F.col("vec_id").alias("vec_a"), F.explode(F.slice("first", 1, k)).alias("vec_b"), F.lit(1.0).alias("score"))
    return found.unionByName(of_copies)


def _by_copy():
    from pyspark.sql import Window

    return Window.partitionBy("copy").orderBy("vec_id")


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """The pairs vec_a < vec_b of which at least one is among the answers of the other."""
    return found.select(F.least("vec_a", "vec_b").alias("vec_a"), F.greatest("vec_a", "vec_b").alias("vec_b")).distinct()
