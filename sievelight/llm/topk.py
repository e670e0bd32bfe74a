"""Exact top-k search by inner product: a Voronoi k-nearest-neighbour join.

Pivots divide the space into cells; of each cell the number of rows and the ranges of
their distances to the pivot and of their norms are kept. Queries of neighbouring cells
form groups. Distances come from differences, not from products, so that they hold for
vectors that are large and near to each other. First every query meets a few known rows of the cells it is nearest to, which
gives a score that its k-th row reaches at least. An inner product is
(|q|^2 + |x|^2 - |q - x|^2) / 2 and |q - x| is no less than |d(q, p) - d(x, p)|, so a row at
distance r from its pivot is of use to a group only if

    |x|^2 >= min(2 s - |q|^2) + dist(r, [d_low, d_high])^2   and   |x| >= min(s / |q|)
    and max(q.p - s) + max|q| r >= 0

over the group's queries q with bounds s. Only such rows are replicated to the group; they
meet its queries in blocks of bounded size, which a matrix product solves exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_kept, materialize, release, table

#: Bytes of a score beyond a long, as an ordered key; holds the product of any two doubles.
WIDE = 288


def quantized(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id and v = floor(scale * x) as whole doubles, of rows with an id and without null or non-finite components."""
    finite = lambda e: F.coalesce((e.cast("double") > float("-inf")) & (e.cast("double") < float("inf")), F.lit(False))  # noqa: E731  NaN is above all
    scaled = lambda e: e.cast("double") * F.lit(float(scale))
    whole = F.transform("embedding", lambda e: F.when(F.abs(scaled(e)) < F.lit(2.0**52), F.floor(scaled(e)).cast("double")).otherwise(scaled(e)))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda e: finite(e) & finite(scaled(e)))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones filled up with zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(flat), dim))
    out[np.arange(dim)[None] < lengths[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def distances(v: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Distances of rows to one point, or each to its own, from differences: right to a relative 1e-13 however near and large they are."""
    return np.sqrt(((v - to) ** 2).sum(axis=1))


def nearest(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each row a pivot that is about the nearest; which one it is affects speed only."""
    middle = pivots.mean(axis=0)
    v, pivots = v - middle, pivots - middle
    with np.errstate(invalid="ignore", over="ignore"):
        return ((pivots * pivots).sum(1)[None] - 2 * v @ pivots.T).argmin(1)


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors: doubles where all sums stay below 2^53, longs below 2^63, else Python integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * max(1, q.shape[1])
    if top < 2.0**53:
        return q @ d.T
    if top < 2.0**62:
        return q.astype(np.int64) @ d.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return np.asarray(whole(q), dtype=object) @ np.asarray(whole(d), dtype=object).T


def narrow(v: np.ndarray) -> np.ndarray:
    """Rows whose products with each other are exact in doubles."""
    return np.abs(v).max(axis=1, initial=0) < math.floor(math.sqrt(2.0**53 / max(1, v.shape[1])))


def best_of_block(q_id: np.ndarray, q: np.ndarray, least: np.ndarray, d_id: np.ndarray, d: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query position, id, score) of the k best rows of a block for each query, ties to smaller ids; rows of the query's id are left out."""
    order = np.argsort(d_id, kind="stable")
    d_id, d = d_id[order], d[order]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    few_q, few_d = narrow(q), narrow(d)
    for qs, ds in ((few_q, few_d), (few_q, ~few_d), (~few_q, np.ones(len(d), bool))):
        rows, cols = np.flatnonzero(qs), np.flatnonzero(ds)
        for i in range(0, len(rows) if len(cols) else 0, 256):
            some = rows[i : i + 256]
            s = products(q[some], d[cols])
            open_to = (q_id[some][:, None] != d_id[cols][None]) & (s >= least[some][:, None])
            if len(cols) > k and s.dtype != object:
                masked = np.where(open_to, s, np.finfo(np.float64).min if s.dtype == np.float64 else np.iinfo(np.int64).min)
                open_to &= s >= np.partition(masked, len(cols) - k, axis=1)[:, len(cols) - k][:, None]
            at, to = np.nonzero(open_to)
            found.append((some[at], cols[to], s[at, to]))
    out = []
    best: dict[int, list[tuple[int, int]]] = {}
    for at, to, s in found:
        if s.dtype != object:  # the k best of each query, before they become Python numbers
            s = s.astype(np.int64)
            place = np.lexsort((to, -s, at))
            at, to, s = at[place], to[place], s[place]
            first = np.arange(len(at)) - np.searchsorted(at, at) < k
            at, to, s = at[first], to[first], s[first]
        for a, t, x in zip(at.tolist(), to.tolist(), s.tolist(), strict=True):
            best.setdefault(a, []).append((-x, t))
    for a, rows in best.items():
        out += [(a, int(d_id[t]), -x) for x, t in sorted(rows)[:k]]
    return out


def chain(p: np.ndarray) -> np.ndarray:
    """An order of the pivots in which each is followed by the nearest of those left."""
    order, left = [0], np.ones(len(p), bool)
    left[0] = False
    while left.any():
        order.append(int(np.where(left, distances(p, p[order[-1]]), np.inf).argmin()))
        left[order[-1]] = False
    return np.array(order)


def grouped(counts: list[tuple[int, int]], group: int) -> list[tuple[int, int, int]]:
    """(cell, first group, groups): small neighbours share a group, large cells are dealt over several."""
    out, last, filled = [], -1, group
    for cell, n in counts:
        of = -(-n // group)
        if of > 1 or filled + n > group:
            last, filled = last + of, 0
        filled = group if of > 1 else filled + n
        out.append((cell, last - of + 1, of))
    return out


def joined(vectors: DataFrame, is_query: Column, *, k: int, scale: float, pivots: int | None, group: int, block: int, probes: int) -> tuple[DataFrame, dict]:
    """``top_k`` as written tables, with what was replicated: rows, queries, groups, and rows sent to groups."""
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    rows = materialize(quantized(vectors, scale).withColumn("at", F.monotonically_increasing_id()))
    whole = rows.agg(F.max(F.size("v")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    nothing = spark.createDataFrame([], schema), {"rows": whole.n, "queries": 0, "groups": 0, "sent": 0}
    if not whole.n:
        return nothing
    dim = whole.dim
    chosen = rows.orderBy(F.xxhash64("vec_id", "at"), "at").limit(pivots or max(16, min(8192, math.isqrt(whole.n)))).select("v").toArrow()
    p = np.unique(matrix(chosen.column("v"), dim), axis=0)
    p = p[chain(p)]

    def assign(batches):
        drop_kept()
        for b in batches:
            v = matrix(b.column("v"), dim)
            cell = nearest(v, p)
            columns = [b.column("vec_id"), b.column("at"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(distances(v, p[cell])), pa.array((v * v).sum(1))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "at", "v", "cell", "r", "norm2"])

    data = materialize(rows.mapInArrow(assign, "vec_id bigint, at bigint, v array<double>, cell int, r double, norm2 double"))
    release(rows)
    summary = data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r_low"), F.max("r").alias("r_high"), F.max("norm2").alias("norm2"), F.sum(F.when(is_query, 1).otherwise(0)).alias("asked")).orderBy("cell").collect()  # one row per pivot
    if not sum(s.asked for s in summary):
        return nothing
    # of each cell a few rows of large norm: any rows bound the k-th score, these bound it well
    known = data.withColumn("place", F.row_number().over(W.partitionBy("cell").orderBy(F.desc("norm2"), "at"))).where(F.col("place") <= probes).select("cell", "vec_id", "v").toArrow()
    of_cell, probe_id, probe = known.column("cell").to_numpy(), known.column("vec_id").to_numpy(), matrix(known.column("v"), dim)
    cells = {s.cell: s for s in summary}
    filled = np.array(sorted(cells))
    deal = spark.createDataFrame(grouped([(s.cell, s.asked) for s in summary if s.asked], group), "cell int, first int, parts int")

    def bound(batches):
        drop_kept()
        for b in batches:
            q, ids = matrix(b.column("v"), dim), b.column("vec_id").to_numpy()
            least = np.full(len(q), -np.inf)
            near = filled[np.argsort(-(q @ p[filled].T), axis=1, kind="stable")[:, :4]]
            for cell in np.unique(near[:, 0]):
                mine = np.flatnonzero(near[:, 0] == cell)
                at = np.flatnonzero(np.isin(of_cell, near[mine]))
                s = np.where(probe_id[at][None] == ids[mine][:, None], -np.inf, q[mine] @ probe[at].T)
                if len(at) >= k:
                    least[mine] = np.partition(s, len(at) - k, axis=1)[:, len(at) - k]
            with np.errstate(invalid="ignore", over="ignore"):
                least = least - 1e-9 * (1 + np.sqrt((q * q).sum(1)) * math.sqrt(max(s.norm2 for s in summary)))
            least[~np.isfinite(least)] = -np.inf  # beyond doubles there is no bound
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("at"), b.column("v"), pa.array(least), b.column("group")], ["q_id", "q_at", "q", "least", "group"])

    asked = data.where(is_query).join(F.broadcast(deal), "cell")  # one row per pivot
    asked = asked.withColumn("group", F.col("first") + F.pmod(F.xxhash64("at"), "parts").cast("int")).select("vec_id", "at", "v", "group")
    queries = materialize(asked.mapInArrow(bound, "q_id bigint, q_at bigint, q array<double>, least double, group int"))

    def reach(t: pa.Table) -> pa.Table:
        q, least = matrix(t.column("q"), dim), t.column("least").to_numpy()
        own = (q * q).sum(1)
        size = math.sqrt(own.max())
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            need = float((2 * least - own).min())
            length = float(np.where(least > 0, least / np.sqrt(own), 0).min())
        rows = []
        for c in filled.tolist():
            with np.errstate(invalid="ignore", over="ignore"):
                far, over = distances(q, p[c]), float((q @ p[c] - least).max())
            low, high = float(far.min()), float(far.max())
            s = cells[c]
            if not all(map(math.isfinite, (low, high, over, need, length, size, s.r_high, s.norm2))):
                rows.append((c, -math.inf, math.inf, math.inf, s.n))  # no bound: all of the cell goes
                continue
            gap = max(0.0, s.r_low - high, low - s.r_high)
            if not (s.norm2 * (1 + 1e-9) < need + gap * gap * (1 - 1e-9) or math.sqrt(s.norm2) * (1 + 1e-9) < length or over + size * s.r_high * (1 + 1e-9) < 0):
                rows.append((c, low, high, over, s.n))
        blocks = max(1, -(-sum(r[4] for r in rows) // block))
        c, low, high, over, _ = zip(*rows, strict=True) if rows else ((),) * 5
        n = len(rows)
        return pa.table({"group": pa.array([t.column("group")[0].as_py()] * n, pa.int32()), "cell": pa.array(c, pa.int32()), "low": pa.array(low, pa.float64()), "high": pa.array(high, pa.float64()), "over": pa.array(over, pa.float64()), "need": pa.array([need if math.isfinite(need) else -math.inf] * n, pa.float64()), "length2": pa.array([length * length if math.isfinite(length * length) else 0.0] * n, pa.float64()), "size": pa.array([size] * n, pa.float64()), "blocks": pa.array([blocks] * n, pa.int32())})

    ranges = materialize(queries.select("group", "q", "least").groupBy("group").applyInArrow(reach, "group int, cell int, low double, high double, over double, need double, length2 double, size double, blocks int"))
    gap = F.greatest(F.lit(0.0), F.col("r") - F.col("high"), F.col("low") - F.col("r"))
    more, less = F.lit(1 + 1e-9), F.lit(1 - 1e-9)
    of_use = ~((F.col("norm2") * more < F.col("need") + gap * gap * less) | (F.col("norm2") * more < F.col("length2") * less) | (F.col("over") + F.col("size") * F.col("r") * more < 0))
    of_use = of_use | (F.col("over") == float("inf"))
    sent = data.join(ranges, "cell").where(of_use).select("group", F.pmod(F.xxhash64("at"), F.col("blocks")).cast("int").alias("block"), "vec_id", "v")
    in_blocks = ranges.groupBy("group").agg(F.max("blocks").alias("blocks"))
    dealt = queries.join(in_blocks, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "q_id", "q_at", "q", "least")

    def solve(q: pa.Table, d: pa.Table) -> pa.Table:
        got = best_of_block(q.column("q_id").to_numpy(), matrix(q.column("q"), dim), q.column("least").to_numpy(), d.column("vec_id").to_numpy(), matrix(d.column("v"), dim), k) if len(q) and len(d) else []
        ids, ats = q.column("q_id").to_pylist(), q.column("q_at").to_pylist()
        beyond = [(s >= 1 << 63) - (s < -(1 << 63)) for _, _, s in got]
        return pa.table({
            "query_id": pa.array([ids[a] for a, _, _ in got], pa.int64()), "q_at": pa.array([ats[a] for a, _, _ in got], pa.int64()), "vec_id": pa.array([i for _, i, _ in got], pa.int64()),
            "beyond": pa.array(beyond, pa.int32()), "score": pa.array([None if x else s for x, (_, _, s) in zip(beyond, got, strict=True)], pa.int64()),
            "wide": pa.array([(s + (1 << (8 * WIDE - 1))).to_bytes(WIDE, "big") if x else None for x, (_, _, s) in zip(beyond, got, strict=True)], pa.binary()),
        })

    found = dealt.groupBy("group", "block").cogroup(sent.groupBy("group", "block")).applyInArrow(solve, "query_id bigint, q_at bigint, vec_id bigint, beyond int, score bigint, wide binary")
    rank = F.row_number().over(W.partitionBy("q_at").orderBy(F.desc("beyond"), F.desc("score"), F.desc("wide"), "vec_id"))
    out = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return out, {"rows": whole.n, "queries": queries, "groups": ranges, "sent": sent}


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 20, scale: float = 64.0, pivots: int | None = None, group: int = 2048, block: int = 16_384, probes: int = 32) -> DataFrame:
    """The ``k`` rows of highest inner product for every query, exactly: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id. Each
    query row ranks all rows but those of its own id (all, if fewer than ``k``), ties to
    smaller ids. Rows are rows: those that repeat an id are candidates one by one, and
    queries one by one. Vectors that are null or hold null or non-finite components take no
    part, nor do null ids. Shorter vectors count as filled up with zeros. Products are whole
    numbers of any size; a score that no long holds is null, its rank exact. Other columns
    are ignored. Without a row or a query the result is empty.

    ``pivots`` (the square root of the number of rows, 16 to 8192) are the rows of smallest
    hash, and ``probes`` rows a cell give the first bounds: both affect speed only. A
    cell of any size is dealt over many blocks.
    """
    return joined(vectors, is_query, k=k, scale=scale, pivots=pivots, group=group, block=block, probes=probes)[0]


def replication(vectors: DataFrame, is_query: Column, **options) -> float:
    """Share of (row, group of queries) pairs for which the row is sent to the group."""
    defaults = {"k": 20, "scale": 64.0, "pivots": None, "group": 2048, "block": 16_384, "probes": 32}
    _, made = joined(vectors, is_query, **defaults | options)
    if not made["rows"] or isinstance(made["queries"], int):
        return 0.0
    return made["sent"].count() / (made["rows"] * made["queries"].select("group").distinct().count())


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score of the 20 best rows for each row of ``embeddings`` whose vec_id is divisible by 20.

    Null, empty or non-finite vectors, null and repeated ids, ties, scores beyond a long and
    an empty table: see ``top_k``. Columns other than vec_id and embedding are not read.
    """
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


OP1_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.place, q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, TRY_CAST(score AS BIGINT) AS score FROM r WHERE rank <= 20
"""
