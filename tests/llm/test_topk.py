import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import topk


def brute(rows, k, every):
    """Python integers all the way; (query, rank, id, score or None beyond a long)."""
    dim = max((len(v) for _, v in rows), default=0)
    full = [(i, [math.floor(64 * float(np.float32(x))) for x in v] + [0] * (dim - len(v))) for i, v in rows]
    out = []
    for qi, q in full:
        if qi % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, d)), i) for i, d in full if i != qi)[:k]
            out += [(qi, r + 1, i, -v if -(2**63) <= -v < 2**63 else None) for r, (v, i) in enumerate(s)]
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({n: F.lit("clash") for n in ("score", "cell", "at", "v", "group", "block", "r", "norm2")})
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 5 == 0, **options).collect()), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] * (1 + i % 3) + rng.normal(size=8) * 0.1).tolist()) for i in range(300)]
    rows += [(1000 + i, centres[0].tolist()) for i in range(150)]  # a hot vector, ties across blocks
    want = brute(rows, 7, 5)
    assert run(spark, rows, k=7, pivots=9, group=16, block=50, probes=8) == want
    assert run(spark, rows, k=7, pivots=1, group=1000, block=1000, probes=3) == want
    assert run(spark, rows, k=7) == want


def test_rows_that_cannot_matter_stay_away(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (np.eye(8)[i % 8] * 10 + rng.normal(size=8) * 0.01).tolist()) for i in range(800)]
    assert run(spark, rows, k=3, pivots=16, group=8, block=64) == brute(rows, 3, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert topk.replication(df, F.col("vec_id") % 5 == 0, k=3, pivots=16, group=8) < 0.3


def test_odd_rows(spark):
    good = [(5, [1.0, 2.0]), (6, [0.5]), (7, []), (8, [-1.0, -1.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0])]
    odd = [(10, None), (15, [1.0, None]), (20, [float("nan"), 1.0]), (25, [float("inf"), 1.0]), (25, [float("-inf")]), (None, [9.0, 9.0])]
    assert run(spark, good + odd, k=3) == brute(good, 3, 5)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []
    assert run(spark, [(5, [1.0])]) == []


def test_repeated_ids_are_rows(spark):
    rows = [(0, [1.0]), (1, [2.0]), (1, [5.0]), (5, [3.0]), (5, [-3.0])]
    got = run(spark, rows, k=4)
    assert got == brute(rows, 4, 5) and (0, 1, 1, 20480) in got and (0, 3, 1, 8192) in got


def test_large_values(spark):
    rows = [(0, [1.0]), (1, [3e6]), (2, [2.0])]
    assert run(spark, rows, k=2) == brute(rows, 2, 5)
    rows = [(i, [float(2**19 + i), float(i)]) for i in range(20)]
    assert run(spark, rows, k=4) == brute(rows, 4, 5)
    rows = [(i, [float(2**28 + 64 * i), float(-i)]) for i in range(20)] + [(40, [1.0, 2.0]), (41, [1e9, -1e9])]
    assert run(spark, rows, k=6) == brute(rows, 6, 5)


def test_scores_beyond_a_long_keep_their_rank(spark):
    rows = [(0, [1.0, 1.0]), (1, [3e38, 1.0]), (2, [2e38, 1.0]), (3, [-3e38, 0.0]), (4, [1.0, 0.0]), (5, [3e38, 2e38]), (6, [7e30, 7e30])]
    got = run(spark, rows, k=6)
    assert got == brute(rows, 6, 5) and any(r[3] is None for r in got)


@pytest.mark.parametrize("size", [2.0**20, 2.0**24, 2.0**28, 2.0**31])
def test_large_and_near_vectors(spark, size):
    rng = np.random.default_rng(7)
    near = [(i, (size + rng.integers(-3, 4, 64)).tolist()) for i in range(150)]
    centres = size / 2 * rng.normal(size=(10, 64)).round()
    clustered = [(i, (centres[i % 10] + rng.integers(-3, 4, 64)).tolist()) for i in range(200)]
    for rows in (near, clustered):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        want = [(a, b, c, d) for a, b, c, d in brute_double(rows, 5, 5)]
        for options in ({}, {"pivots": 40, "group": 8, "block": 64}):
            assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 5 == 0, k=5, scale=1.0, **options).collect()), key=str) == want
    assert topk.replication(spark.createDataFrame(clustered, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0, k=5, scale=1.0, pivots=40, group=4) < 0.9


def brute_double(rows, k, every):
    out = []
    for qi, q in rows:
        if qi % every == 0:
            s = sorted((-sum(int(a) * int(b) for a, b in zip(q, d)), i) for i, d in rows if i != qi)[:k]
            out += [(qi, r + 1, i, -v if -(2**63) <= -v < 2**63 else None) for r, (v, i) in enumerate(s)]
    return sorted(out, key=str)
