import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import quantizer as q


def brute(rows, parts, entries, rounds, scale):
    """Lloyd's method with Python integers; (codes, errors) in the order of the rows, and the books."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    dim = max((len(r[1]) for r in kept), default=0)
    width = -(-dim // parts)
    full = [[math.floor(scale * x) for x in r[1]] + [0] * (parts * width - len(r[1])) for r in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, [scale * x for x in kept[k][1]]))[:entries]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in full]
    books = [[list(cut[k][p]) for k in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda j: (far(v[p], books[p][j]), j)) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [v[p] for v, c in zip(cut, codes) if c[p] == j]
                if mine:
                    books[p][j] = [sum(x) // len(mine) for x in zip(*mine)]
    codes = assign()
    return kept, codes, [sum(far(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(cut, codes)], books


def check(spark, rows, kind="float", **options):
    o = {"parts": 8, "entries": 16, "rounds": 6, "scale": 4096.0} | options
    if kind == "float":
        rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3).withColumns({c: F.lit("clash") for c in ("v", "codes", "upper", "lower", "sums", "error", "carried")})
    made = q.compress(df, **options)
    kept, codes, errors, books = brute(rows, **o)
    assert made.books == books
    want = sorted((str(r[0]), c, e if e < 1 << 63 else None) for r, c, e in zip(kept, codes, errors))
    assert sorted((str(r.vec_id), r.codes, r.error) for r in made.table.collect()) == want
    return made


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 24))
    rows = [(i, (centres[i % 20] + rng.normal(size=24) * 0.05).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # a hot vector
    rows += [(None, rows[1][1]), (None, rows[2][1]), (7, rows[9][1]), (7, rows[9][1]), (2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 24), (2003, [float("inf")] * 24), (2004, []), (2005, [0.5] * 5)]
    made = check(spark, rows)
    assert made.scans[0] > made.scans[1] > made.scans[-1]  # bounds spare most of the work


def test_ties_and_unused_entries(spark):
    rows = [(i, [float(x) for x in np.array([i % 3, i % 2] * 8) / 4096]) for i in range(60)]  # few values: equal entries, ties everywhere
    check(spark, rows)
    check(spark, [(i, [0.0] * 16) for i in range(40)])
    check(spark, [(i, [i / 7] * 8) for i in range(5)])  # fewer rows than entries
    rng = np.random.default_rng(4)
    check(spark, [(i, rng.integers(-3, 4, 16).astype(float).tolist()) for i in range(300)], entries=7, rounds=3, parts=4, scale=1.0)


@pytest.mark.parametrize("size", [2.0**10, 2.0**22, 2.0**40])
def test_large_values(spark, size):
    rng = np.random.default_rng(2)
    check(spark, [(i, (size * (1 + rng.normal(size=16) * 1e-4)).tolist()) for i in range(60)])
    check(spark, [(i, (size * rng.normal(size=16)).tolist()) for i in range(60)], kind="double", entries=4)


def test_empty(spark):
    made = q.compress(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert made.table.count() == 0 and made.books == [[] for _ in range(8)]
    made = q.compress(spark.createDataFrame([(1, []), (2, [])], "vec_id long, embedding array<float>"))
    assert sorted((r.vec_id, r.codes, r.error) for r in made.table.collect()) == [(1, [0] * 8, 0), (2, [0] * 8, 0)]


def test_query(spark, tmp_path):
    rows = [(i, [float(i % 5), 1.0] * 8, i % 2 if i % 3 else None) for i in range(50)] + [(99, [3e36] * 16, 7), (98, None, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in q.op13_vector_codes(spark, str(tmp_path)).collect()}
    kept, codes, errors, books = brute([(i, v if v is None else [float(np.float32(x)) for x in v]) for i, v, _ in rows], 8, 16, 6, 4096.0)
    label = {r[0]: r[2] for r in rows}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert len(got) == 51 and {r.codebooks_sha256 for r in got.values()} == {digest}
    for (i, _), c, e in zip(kept, codes, errors):
        total = sum(x for (j, _), x in zip(kept, errors) if label[j] == label[i])
        assert (got[i].code, got[i].error, got[i].label_error) == ("".join(f"{j:02x}" for j in c), *(x if x < 1 << 63 else None for x in (e, total)))


def test_decoded(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(16)]
    made = q.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert all(abs(a - b) <= 1 / 4096 for r in q.decoded(made).collect() for a, b in zip(r.embedding, dict(rows)[r.vec_id]))
