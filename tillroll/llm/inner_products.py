"""Exact search for the largest inner products, longest vectors first.

Vectors are turned into whole numbers, ``floor(scale * x)``, equal rows are
counted, and the table is persisted in order of descending length.  The query
vectors come in blocks of a fixed size; a job takes a block past a range of
lengths, its tasks reading the vectors from the longest to the shortest:

* a vector whose length times the query's is under the k-th best score so far
  can't reach it, nor can any shorter one;
* the others are compared in a basis turned by an SVD, in which the first
  coordinates hold most of a vector.  Their partial sum and the lengths of the
  rest bound the score (Cauchy-Schwarz), at two depths;
* what is left is scored exactly.

Each query starts from the k-th best score among a bounded number of the
longest and of arbitrary vectors.  Ranges of lengths grow by a fixed factor,
and each starts from the best scores of those before, so that the tasks report
few vectors that are not among the best, however many tasks there are.

The SVD is fitted on ``FIT_ROWS`` rows at most.  It and the starting scores
only decide how much is computed; the result is that of scoring all pairs.

Defined results: vectors that are null, or hold a null or a value that isn't
finite, take no part.  A shorter vector is one with zeros at its end; an empty
one scores 0.  Rows with one ``vec_id``, or equal altogether, are vectors of
their own, queries too; a null ``vec_id`` is never a query and comes last in a
tie.  A score beyond a long counts as the nearest long, a component of 1e300
or more as 1e300.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.joins import join_lookup
from tillroll.session import stage

SCALE = 256
K = 5
FIT_ROWS = 4096
SEED_ROWS = 4096
GROWTH = 16
BLOCK_BYTES = 32 << 20
ROWS, QUERIES = 1024, 2048  # vectors and queries that are compared at once
EXACT = 2.0**53
LARGEST = np.iinfo(np.int64).max
NONE = np.iinfo(np.int64).min

VECTOR_SCHEMA = "vec_id long, is_query boolean, vec binary, norm double"
FOUND_SCHEMA = "q long, vec_id long, n long, score long"


def _whole_numbers(scale: float):
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            values = vectors.flatten()
            x = pc.fill_null(values, np.nan).to_numpy(zero_copy_only=False)
            bad = np.bincount(rows, ~np.isfinite(x), len(sizes)) > 0
            good = ~bad & vectors.is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                # Adding zero makes one zero of two.
                x = np.clip(np.floor(x * scale), -1e300, 1e300) + 0.0
                norm = np.sqrt(np.bincount(rows, np.where(good[rows], x * x, 0), len(sizes)))
            at = np.append(0, np.cumsum(8 * sizes[good])).astype(np.int32)
            buffers = [None, pa.py_buffer(at), pa.py_buffer(x[good[rows]])]
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": kept.column("vec_id"),
                    "is_query": kept.column("is_query"),
                    "vec": pa.Array.from_buffers(pa.binary(), int(good.sum()), buffers),
                    "norm": pa.array(norm[good]),
                }
            )

    return convert


def sorted_vectors(vectors: DataFrame, is_query: Column, scale: float = SCALE) -> DataFrame:
    """Every vector as whole numbers with its ``norm``, longest first; ``n`` equal rows are one."""
    given = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    rows = given.mapInArrow(_whole_numbers(scale), VECTOR_SCHEMA)
    rows = rows.groupBy("vec_id", "is_query", "vec", "norm").agg(F.count("*").alias("n"))
    ordered = rows.repartitionByRange(F.desc("norm"), "vec_id", "vec")
    ordered = ordered.sortWithinPartitions(F.desc("norm"), "vec_id", "vec")
    return stage(ordered.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    rows = [np.frombuffer(v.as_py(), np.float64) for v in column]
    if all(len(r) == width for r in rows):
        return np.concatenate(rows).reshape(len(rows), width) if rows else np.empty((0, width))
    return np.stack([np.pad(r, (0, width - len(r))) for r in rows])


def _whole_dot(a: np.ndarray, b: np.ndarray) -> int:
    score = sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist()))
    return max(-LARGEST, min(LARGEST, score))


def _scores(q: np.ndarray, v: np.ndarray, qn: np.ndarray, vn: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``q`` with all of ``v``."""
    with np.errstate(all="ignore"):
        # Doubles are exact where no sum of products can pass 53 bits.
        wide = ~(qn[:, None] * vn < EXACT)
        found = np.where(wide, 0, q @ v.T).astype(np.int64)
    for i, j in zip(*np.nonzero(wide)):
        found[i, j] = _whole_dot(q[i], v[j])
    return found


class _Block:
    """Queries in both bases."""

    def __init__(self, rows: pa.Table, basis: np.ndarray):
        self.q = rows.column("row").to_numpy()
        self.limit = rows.column("limit").to_numpy()
        self.norm = rows.column("norm").to_numpy()
        self.vec = _matrix(rows.column("vec"), len(basis))
        self.basis = basis
        self.turned, self.rest = _turned(self.vec, basis)


def _depths(width: int) -> tuple[int, int]:
    return max(1, width // 8), max(1, width // 2)


def _turned(vec: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The vectors in the other basis, and what is left of their length at each depth."""
    with np.errstate(all="ignore"):
        turned = vec @ basis
        return turned, [np.linalg.norm(turned[:, d:], axis=1) for d in _depths(len(basis))]


def _candidates(block: _Block, mine: slice | np.ndarray, limit, vec, norm) -> np.ndarray:
    """Scores of the pairs that may reach the limit; others have ``NONE``."""
    turned, rest = _turned(vec, block.basis)
    first, second = _depths(len(block.basis))
    with np.errstate(all="ignore"):
        slack = 1e-9 * block.norm[mine][:, None] * norm + 1e-6
        partial = block.turned[mine, :first] @ turned[:, :first].T
        bound = partial + block.rest[0][mine][:, None] * rest[0] + slack
        may = ~(bound < limit[:, None])
        i, j = np.nonzero(may)
        if len(i) * 8 < may.size:
            rows = mine[i]
            more = np.einsum("ij,ij->i", block.turned[rows, first:second], turned[j, first:second])
            bound = partial[i, j] + more + block.rest[1][rows] * rest[1][j] + slack[i, j]
            left = ~(bound < limit[i])
            i, j = i[left], j[left]
            scores = np.full(may.shape, NONE)
            rows = mine[i]
            wide = ~(block.norm[rows] * norm[j] < EXACT)
            scores[i, j] = np.where(wide, 0, np.einsum("ij,ij->i", block.vec[rows], vec[j])).astype(np.int64)
            for a, b in zip(i[wide], j[wide]):
                scores[a, b] = _whole_dot(block.vec[mine[a]], vec[b])
            return scores
    scores = _scores(block.vec[mine], vec, block.norm[mine], norm)
    scores[~may] = NONE
    return scores


def _best(found: list[np.ndarray], k: int) -> np.ndarray:
    """The first ``k`` rows (q, no id, vec_id, n, score) of each query."""
    rows = np.concatenate(found, axis=1)
    rows = rows[:, np.lexsort((rows[2], rows[1], -rows[4], rows[0]))]
    start = np.flatnonzero(np.diff(rows[0], prepend=rows[0, :1] - 1))
    place = np.arange(rows.shape[1]) - np.repeat(start, np.diff(np.append(start, rows.shape[1])))
    return rows[:, place < k]


def _searcher(shared: Broadcast, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(*shared.value)
        limit = block.limit.copy()
        top = np.full((len(limit), k), NONE)
        found: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                no_id = part.column("vec_id").is_null()
                ids = pc.fill_null(part.column("vec_id"), 0).to_numpy()
                no_id = no_id.to_numpy(zero_copy_only=False)
                order = np.lexsort((ids, no_id))
                ids, no_id = ids[order], no_id[order]
                vec = _matrix(part.column("vec"), len(block.basis))[order]
                norm, n, row = (part.column(c).to_numpy()[order] for c in ("norm", "n", "row"))
                with np.errstate(all="ignore"):
                    open_ = np.flatnonzero(~(block.norm * norm.max() * (1 + 1e-9) < limit))
                for at in range(0, len(open_), QUERIES):
                    mine = open_[at : at + QUERIES]
                    scores = _candidates(block, mine, limit[mine], vec, norm)
                    own = block.q[mine][:, None] == row
                    scores[own & (n < 2)] = NONE  # other copies of a query's own row are candidates
                    if scores.shape[1] > k:
                        kth = np.partition(scores, -k, axis=1)[:, -k]
                    else:
                        kth = np.full(len(mine), NONE)
                    least = np.maximum(kth, limit[mine])[:, None]
                    ties = (scores == least) & (scores != NONE)
                    keep = (scores > least) | ties & (np.cumsum(ties, axis=1) <= k)
                    i, j = np.nonzero(keep)
                    if not len(i):
                        continue
                    left = n[j] - own[i, j]
                    found.append(np.stack([block.q[mine[i]], no_id[j], ids[j], left, scores[i, j]]))
                    held += len(i)
                    merged = np.concatenate([top[mine], np.where(keep, scores, NONE)], axis=1)
                    top[mine] = np.partition(merged, -k, axis=1)[:, -k:]
                    limit[mine] = np.maximum(limit[mine], top[mine].min(axis=1))
                if held > 4 * k * len(limit) + 100_000:
                    found = [_best(found, k)]
                    held = found[0].shape[1]
        if found:
            q, no_id, ids, n, score = _best(found, k)
            vec_id = pa.array(ids, mask=no_id.astype(bool))
            yield pa.RecordBatch.from_pydict({"q": q, "vec_id": vec_id, "n": n, "score": score})

    return search


def _starter(shared: Broadcast, k: int):
    """Adds to each query the k-th best score among the seeds."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, width = shared.value
        seed_rows, norm, n = (seeds.column(c).to_numpy() for c in ("row", "norm", "n"))
        vec = _matrix(seeds.column("vec"), width)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = part.column("row").to_numpy()
                scores = _scores(_matrix(part.column("vec"), width), vec, part.column("norm").to_numpy(), norm)
                scores[(rows[:, None] == seed_rows) & (n < 2)] = NONE
                limit = np.partition(scores, -k, axis=1)[:, -k] if len(n) >= k else np.full(len(rows), NONE)
                yield part.append_column("limit", pa.array(limit))

    return start


def _basis(sample: np.ndarray) -> np.ndarray:
    """Directions in which the vectors extend most, first ones first."""
    width = sample.shape[1]
    usable = sample[(np.abs(sample) < 1e100).all(axis=1)]
    if not width or not len(usable):
        return np.eye(width)
    return np.linalg.svd(usable.T @ usable)[0]


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` vectors of each query, copies counted; ``before`` is how many come first."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    return found.withColumn("before", before).where(F.col("before") < k)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    scale: float = SCALE,
    *,
    seed_rows: int = SEED_ROWS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` vectors with the largest inner products for each query row.

    Returns query_id, rank (from 1), vec_id and score; ties go to the smaller
    ``vec_id``.  A query's own row isn't compared with it.
    """
    spark = vectors.sparkSession
    context = spark.sparkContext
    data = sorted_vectors(vectors, is_query, scale)
    count, width, n_queries = data.agg(
        F.count("*"), F.coalesce(F.max(F.octet_length("vec") / 8), F.lit(0)), F.count_if("is_query")
    ).first()
    width = int(width)

    # Bounded in number: the longest vectors and arbitrary ones.
    seeds_of_each = min(seed_rows, max(count // GROWTH, 16 * k))
    longest = data.orderBy(F.desc("norm"), "row").limit(seeds_of_each).toArrow()
    sample = data.orderBy(F.xxhash64("row"), "row").limit(FIT_ROWS).toArrow()
    seeds = {r: i for i, r in enumerate(longest.column("row").to_pylist())}
    extra = [i for i, r in enumerate(sample.column("row").to_pylist()) if r not in seeds][:seeds_of_each]
    basis = _basis(_matrix(sample.column("vec"), width))

    shared = context.broadcast((pa.concat_tables([longest, sample.take(pa.array(extra, pa.int64()))]), width))
    queries = data.where("is_query").select("row", "vec_id", "vec", "norm", "n")
    schema = "row long, vec_id long, vec binary, norm double, n long, limit long"
    queries = stage(queries.mapInArrow(_starter(shared, k), schema), "queries")
    shared.destroy()
    blocks = max(1, -(-n_queries * (16 * width + 64) // block_bytes))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))

    best = stage(spark.createDataFrame([], FOUND_SCHEMA), "best")
    for longer, shorter in _ranges(data, count, seeds_of_each):
        bounds = F.lit(True) if shorter is None else F.col("norm") >= shorter
        bounds = bounds if longer is None else bounds & (F.col("norm") < longer)
        wave = data.where(bounds).select("row", "vec_id", "vec", "norm", "n")
        full = best.groupBy("q").agg(F.sum("n").alias("_n"), F.min("score").alias("_kth")).where(F.col("_n") >= k)
        limits = join_lookup(queries, full.select(F.col("q").alias("row"), "_kth"), "row", "left")
        limits = limits.withColumn("limit", F.greatest("limit", "_kth"))
        found = [best]
        for number in range(blocks):
            rows = limits.where(F.col("block") == number).select("row", "limit", "vec", "norm").toArrow()
            if rows.num_rows:
                shared = context.broadcast((rows, basis))
                found.append(stage(wave.mapInArrow(_searcher(shared, k), FOUND_SCHEMA), "found"))
                shared.destroy()
        best = stage(_merged(reduce(DataFrame.unionByName, found), k).drop("before"), "best")

    last = F.least("n", F.lit(k) - F.col("before"))
    ranks = _merged(best, k).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), last)))
    owners = queries.select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), F.col("n").alias("copies"))
    ranked = join_lookup(ranks, owners, "q")
    ranked = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return ranked.select("query_id", (F.col("before") + F.col("i")).cast("int").alias("rank"), "vec_id", "score")


def _ranges(data: DataFrame, count: int, first: int) -> list[tuple[float | None, float | None]]:
    """Ranges of lengths, from and below, that hold ever more vectors; ``None`` is no limit."""
    shares = []
    size = first * GROWTH
    while size < count:
        shares.append(1 - size / count)
        size *= GROWTH
    cuts = data.select(F.percentile_approx("norm", shares)).first()[0] if shares else []
    cuts = sorted(set(cuts or []), reverse=True)
    return list(zip([None, *cuts], [*cuts, None]))
