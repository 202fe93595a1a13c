"""Top inner products against the scores of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import inner_products as ip

SCHEMA = "vec_id long, embedding array<double>, label int, row int, n string, score int"


def brute_force(rows, is_query, k=5, scale=256):
    vectors = []
    for vec_id, x in rows:
        if x is not None and all(v is not None and math.isfinite(v) for v in x):
            vectors.append((vec_id, [math.floor(scale * v) for v in x]))
    result = []
    for i, (query_id, q) in enumerate(vectors):
        if not is_query(query_id):
            continue
        scores = []
        for j, (vec_id, v) in enumerate(vectors):
            if i != j:
                score = sum(a * b for a, b in zip(q, v))
                score = max(-(2**63) + 1, min(2**63 - 1, score))
                scores.append((-score, vec_id is None, vec_id or 0))
        for rank, (score, none, vec_id) in enumerate(sorted(scores)[:k], 1):
            result.append((query_id, rank, None if none else vec_id, -score))
    return sorted(result, key=repr)


def searched(spark, rows, every=50, **options):
    frame = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA)
    found = ip.top_k(frame, F.col("vec_id") % every == 0, **options)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()), key=repr)


def by(every):
    return lambda vec_id: vec_id is not None and vec_id % every == 0


def clustered(seed, n, width=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width)) * rng.uniform(0.1, 2, (6, 1))
    rows = centres[rng.integers(0, 6, n)] + 0.1 * rng.normal(size=(n, width))
    return [(i, row.tolist()) for i, row in enumerate(rows)]


@pytest.mark.parametrize("options", [{}, {"seed_rows": 8, "block_bytes": 16_000}, {"k": 1}, {"k": 40}])
def test_all_pairs(spark, options):
    rows = clustered(1, 1500)
    expected = brute_force(rows, by(20), options.get("k", 5))
    assert searched(spark, rows, 20, **options) == expected


def test_ties_copies_and_hot_vectors(spark):
    pick = random.Random(2)
    same = [0.5, -0.25, 1.0]
    rows = [(pick.randrange(400), same if pick.random() < 0.4 else [pick.choice((-1.0, 0.0, 0.5)) for _ in "abc"]) for _ in range(900)]
    rows += [(50, same)] * 9 + [(None, same)] * 3 + [(100, [9.0, 9.0, 9.0])] * 2
    assert searched(spark, rows, 25, seed_rows=4) == brute_force(rows, by(25))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, []), (100, None), (150, [1.0, None]), (200, [nan, 1.0]),
        (250, [1.0, -inf]), (300, [1.0, 2.0, 3.0]), (-50, [-0.0, 0.001]), (None, [5.0, 5.0]), (7, [-1.0, -0.001]),
        (350, [2.0**40, 3.0]), (8, [2.0**41 + 0.5, -2.0**39, 7.0]), (400, [1e200, 1.0]), (9, [-1e180, 1e300]),
    ]
    assert searched(spark, rows) == brute_force(rows, by(50))
    assert searched(spark, rows, seed_rows=1, block_bytes=300) == brute_force(rows, by(50))
    assert searched(spark, []) == []
    assert searched(spark, [(0, [1.0])]) == []
    assert searched(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert searched(spark, [(None, None), (50, None)]) == []


def test_short_vectors_are_pruned(spark):
    """With one very long vector in five, no task scores the rest."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.uniform(0.5, 1, 16) * (1 if i % 5 else 1000)).tolist()) for i in range(1000)]
    data = ip.sorted_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(False))
    norms = [r.norm for r in data.collect()]
    assert norms == sorted(norms, reverse=True)
    vec = np.floor(256 * np.array([r[1] for r in rows]))
    basis = ip._basis(vec)
    norm = np.linalg.norm(vec, axis=1)
    import pyarrow as pa

    query = pa.table({"row": [0], "limit": [int(np.sort(vec @ vec[0])[-5])], "vec": [vec[0].tobytes()], "norm": norm[:1]})
    block = ip._Block(query, basis)
    scores = ip._candidates(block, np.array([0]), block.limit, vec, norm)
    exact = (vec @ vec[0]).astype(np.int64)
    reach = exact >= block.limit[0]
    assert (scores[0][reach] == exact[reach]).all()
    assert (scores[0] != ip.NONE).sum() < 100


def test_ranges_cover_all_lengths(spark):
    data = ip.sorted_vectors(spark.createDataFrame(clustered(3, 2000), "vec_id long, embedding array<double>"), F.lit(False))
    ranges = ip._ranges(data, 2000, 4)
    assert len(ranges) == 3 and ranges[0][0] is None and ranges[-1][1] is None
    assert [r[1] for r in ranges[:-1]] == [r[0] for r in ranges[1:]]
