"""Vector codes by product quantization with Hamerly's form of Lloyd's method, in whole numbers.

Vectors are cut into parts, and every part position has a codebook. A table holds, for every
part of every vector, its entry, one upper bound on the distance to that entry and one lower
bound on the distance to the second-nearest. When entries move, the bounds move with them; a
part whose upper bound lies strictly below the lower one, or below half the distance from its
entry to the next, keeps its entry unseen. Only the others are compared with all entries, in
whole numbers, ties to the lower index. Each pass over the table writes the next one, and
each task adds one row with the sums that make the next codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_kept, materialize, release, table

#: Room for what rounding adds to a bound.
UP, DOWN = 1 + 1e-12, 1 - 1e-12
#: Bits of the digits in which sums of large components are added.
DIGIT = 30


def whole_vectors(vectors: DataFrame, scale: float) -> tuple[Column, Column]:
    """floor(scale * x) of every component as whole doubles, and whether the vector has no null and no component beyond a double."""
    scaled = lambda e: e.cast("double") * F.lit(float(scale))
    fine = lambda e: F.coalesce((scaled(e) > float("-inf")) & (scaled(e) < float("inf")), F.lit(False))  # noqa: E731  NaN is above all
    whole = F.transform("embedding", lambda e: F.when(F.abs(scaled(e)) < F.lit(2.0**52), F.floor(scaled(e)).cast("double")).otherwise(scaled(e)))
    return whole, F.coalesce(F.col("embedding").isNotNull() & F.forall("embedding", fine), F.lit(False))


def as_parts(column: pa.Array, parts: int, width: int, wide: bool) -> np.ndarray:
    """Vectors as (row, part, component), shorter ones filled up with zeros: doubles, or Python integers if ``wide``."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), parts * width))
    out[np.arange(parts * width)[None] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    out = out.reshape(len(column), parts, width)
    return np.frompyfunc(int, 1, 1)(out) if wide and out.size else out.astype(object) if wide else out


def square_distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries; exact for Python integers, and for doubles whose squares add up to less than 2^53."""
    if x.dtype == object:
        return ((x[:, None, :] - book[None]) ** 2).sum(axis=2) if x.shape[1] else np.zeros((len(x), len(book)), object)
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None]


@dataclass
class Moves:
    """How the entries of one codebook moved, and half the distance from each to its neighbour."""

    own: np.ndarray
    others: np.ndarray
    half: np.ndarray


def moves(before: np.ndarray, now: np.ndarray) -> Moves:
    own = np.sqrt(((now - before) ** 2).sum(1)) * UP
    others = np.array([np.delete(own, j).max(initial=0.0) for j in range(len(own))])
    apart = square_distances(now, now)
    np.fill_diagonal(apart, np.inf)
    return Moves(own, others, np.sqrt(apart.min(1)) / 2 * DOWN)


def scanned(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entries (ties to the lower index), and bounds on the distances to them and to the second-nearest."""
    far = square_distances(x, book)
    code = far.argmin(1) if len(x) else np.zeros(0, np.int64)
    if far.dtype == object:
        return code, np.full(len(x), np.inf), np.zeros(len(x))
    rows = np.arange(len(x))
    upper = np.sqrt(far[rows, code]) * UP
    far[rows, code] = np.inf
    return code, upper, np.sqrt(far.min(1)) * DOWN if far.shape[1] > 1 else np.full(len(x), np.inf)


def reassigned(x: np.ndarray, book: np.ndarray, moved: Moves, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``scanned``, of rows with a code and bounds that held before the entries moved; the number of rows that were scanned."""
    upper, lower = (upper + moved.own[code]) * UP, (lower - moved.others[code]) - np.abs(lower) * 1e-12
    least = np.maximum(lower, moved.half[code])
    open_ = np.flatnonzero(~(upper < least))
    upper[open_] = np.sqrt(((x[open_] - book[code[open_]]) ** 2).sum(1)) * UP
    open_ = open_[~(upper[open_] < least[open_])]
    code = code.copy()
    code[open_], upper[open_], lower[open_] = scanned(x[open_], book)
    return code, upper, lower, len(open_)


def digits(sums: np.ndarray, count: int) -> list[int]:
    """Integers as ``count`` digits each, the last of any size and sign."""
    if count == 1:
        return [int(x) for x in sums.ravel()]
    return [int(x >> (DIGIT * k)) & ((1 << DIGIT) - 1) if k < count - 1 else int(x >> (DIGIT * k)) for x in sums.ravel() for k in range(count)]


def entry_sums(x: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """Per entry the sums of its rows' components, and their number."""
    if x.dtype == object:
        out = np.zeros((entries, x.shape[1] + 1), object)
        for row, j in zip(x, code.tolist(), strict=True):
            out[j, :-1] += row
            out[j, -1] += 1
        return out
    one = (code[None] == np.arange(entries)[:, None]).astype(np.float64)
    return np.c_[one @ x, one.sum(1)].astype(np.int64)


STATE = "codes array<int>, upper array<double>, lower array<double>, sums array<bigint>"


@dataclass
class Compressed:
    """What ``compress`` makes. table: vec_id, the carried columns as one struct ``carried``, codes (entries in part order) and error (null beyond a long); books: per part the entries' components; scans: parts compared with all entries, by pass."""

    table: DataFrame
    books: list[list[list[int]]]
    scans: list[int]
    scale: float


def compress(vectors: DataFrame, *, carry: tuple[str, ...] = (), parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0) -> Compressed:
    """Codes of all rows of ``vectors`` (vec_id, embedding) under codebooks that ``rounds`` of Lloyd's method give.

    Rows whose vector is null, or holds a null, a non-finite component or one that scaled is
    beyond a double, are left out. Components become floor(scale * x). Vectors are filled up
    with zeros to the longest one's length and to a multiple of ``parts``, and cut into equal
    parts. Codebooks begin with the parts of the rows of the ``entries`` smallest ids (all, if
    there are fewer), null ids last, rows of one id by their vectors. A round gives each part its
    nearest entry, ties to the lower index, and makes each entry the floor of its parts' mean;
    entries without a part stay. After the rounds, parts get their nearest entries again.
    Repeated rows are rows of their own. ``carry`` names columns that go along; others, whatever
    their names, are not read. Without rows the table is empty and the books have no entries.

    Values are exact at any magnitude: where squares of distances pass 2^53, parts are compared
    as Python integers, without bounds.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    whole, fine = whole_vectors(vectors, scale)
    kept = vectors.where(fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.struct(F.lit(0).alias("carried_"), *carry).alias("carried"), whole.alias("v"))
    now = materialize(kept)
    size = now.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim"), F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0.0)).alias("top")).first()
    width = -(-size.dim // parts)
    wide = 4 * max(1, width) * size.top**2 >= 2.0**52
    count = 1 if not wide else (int(size.top).bit_length() + 64) // DIGIT + 1
    first = now.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow()
    start = as_parts(first.column("v").combine_chunks(), parts, width, wide)
    books = [start[:, p].copy() for p in range(parts)]
    used = len(start)
    carried = now.schema["carried"]
    schema = T.StructType([now.schema["vec_id"], carried, now.schema["v"], *T.StructType.fromDDL(STATE).fields])
    names = schema.names
    kinds = {"codes": pa.list_(pa.int32()), "upper": pa.list_(pa.float64()), "lower": pa.list_(pa.float64()), "sums": pa.list_(pa.int64())}
    flat = lambda x, kind: pa.array(list(x), pa.list_(kind))

    def one_pass(before: list[np.ndarray] | None, books: list[np.ndarray]):
        moved = [moves(b, c) for b, c in zip(before, books, strict=True)] if before and not wide else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            drop_kept()
            total, scans, like = [np.zeros((used, width + 1), object if wide else np.int64) for _ in books], 0, None
            for b in batches:
                x = as_parts(b.column("v"), parts, width, wide)
                code, upper, lower = np.zeros((len(x), parts), np.int32), np.zeros((len(x), parts)), np.zeros((len(x), parts))
                if moved:
                    code, upper, lower = (np.array(b.column(c).flatten().to_numpy(zero_copy_only=False)).reshape(len(x), parts) for c in ("codes", "upper", "lower"))
                for p, book in enumerate(books):
                    if moved:
                        code[:, p], upper[:, p], lower[:, p], n = reassigned(x[:, p], book, moved[p], code[:, p], upper[:, p], lower[:, p])
                    else:
                        (code[:, p], upper[:, p], lower[:, p]), n = scanned(x[:, p], book), len(x)
                    scans += n
                    total[p] += entry_sums(x[:, p], code[:, p], used)
                like = b.schema.field("carried").type
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("carried"), b.column("v"), flat(code, pa.int32()), flat(upper, pa.float64()), flat(lower, pa.float64()), pa.nulls(len(x), kinds["sums"])], names)
            if like is not None:
                row = [*(d for t in total for d in digits(t, count)), scans]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, like), pa.nulls(1, pa.list_(pa.float64())), *(pa.nulls(1, kinds[c]) for c in ("codes", "upper", "lower")), pa.array([row], kinds["sums"])], names)

        return run

    before, scans = None, []
    for k in range(rounds + 1):
        then = materialize(now.select(*names[:3], *(names[3:6] if k else ())).where("v is not null").mapInArrow(one_pass(before, books), schema))
        release(now)
        now = then
        sums = now.where("sums is not null").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).orderBy("i").collect()  # as many as the codebooks have components
        if not sums:
            scans.append(0)
            continue
        numbers = [int(r.x) for r in sums]
        scans.append(numbers.pop())
        if k == rounds:
            break
        whole_sums = np.array([sum(d << (DIGIT * i) for i, d in enumerate(numbers[at : at + count])) for at in range(0, len(numbers), count)], object).reshape(parts, used, width + 1)
        before = books
        books = [np.array([[s // n for s in sums_of] if (n := int(c)) else list(old) for *sums_of, c, old in ((*row, old) for row, old in zip(whole_sums[p].tolist(), books[p].tolist(), strict=True))], object if wide else np.float64).reshape(used, width) for p in range(parts)]

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for b in batches:
            x = as_parts(b.column("v"), parts, width, wide)
            code = b.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(len(x), parts)
            error = [0] * len(x)
            for p, book in enumerate(books):
                off = ((x[:, p] - book[code[:, p]]) ** 2).sum(1)
                error = [e + int(d) for e, d in zip(error, off.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("carried"), b.column("codes"), pa.array([e if e < 1 << 63 else None for e in error], pa.int64())], ["vec_id", "carried", "codes", "error"])

    done = T.StructType([*schema.fields[:2], schema["codes"], T.StructField("error", T.LongType())])
    out = materialize(now.where("v is not null").select("vec_id", "carried", "v", "codes").mapInArrow(errors, done))
    release(now)
    return Compressed(out, [[[int(c) for c in e] for e in b.tolist()] for b in books], scans, scale)


def decoded(made: Compressed) -> DataFrame:
    """vec_id and ``embedding``, the vector that the codes stand for: the middles of the entries' unit cells, scaled back."""
    books = [[[(c + 0.5) / made.scale for c in e] for e in b] for b in made.books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[c for p, j in enumerate(codes) for c in books[p][j]] for codes in b.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(rows, pa.list_(pa.float64()))], ["vec_id", "embedding"])

    return made.table.select("vec_id", "codes").mapInArrow(run, "vec_id bigint, embedding array<double>")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row of ``embeddings`` with a whole vector.

    Eight parts, sixteen entries, six rounds, components times 4096. Nulls, non-finite components,
    ties, repeated rows and ids, vectors of other lengths, an empty table: see ``compress``. Null labels
    are one label. An error, or a sum of errors, that no long holds is null. Other columns are not read.
    """
    made = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), carry=("label",))
    digest = hashlib.sha256(",".join(str(c) for b in made.books for e in b for c in e).encode()).hexdigest()
    rows = made.table.select("vec_id", F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"), "error", F.col("carried.label").alias("label"))
    total = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)")))
    sums = rows.groupBy("label").agg(total.alias("total")).select(F.col("label").alias("of_label"), F.when(F.col("total") < F.lit(str(1 << 63)).cast("decimal(38,0)"), F.col("total")).cast("bigint").alias("label_error"))
    return rows.join(sums, rows["label"].eqNullSafe(sums["of_label"])).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def lloyd_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same in SQL, each round a few common table expressions; all sums are whole and below 2^53."""
    far = "list_dot_product(x.x, x.x) - 2 * list_dot_product(x.x, b.c) + list_dot_product(b.c, b.c)"
    out = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT row_id, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM kept, (SELECT unnest(range({parts})) AS p)),
first AS (SELECT row_id, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept),
b0 AS MATERIALIZED (SELECT p, e, x AS c FROM x JOIN first USING (row_id) WHERE e < {entries}),"""
    for k in range(rounds + 1):
        out += f"""
a{k} AS MATERIALIZED (SELECT row_id, x.p, min({{'d': {far}, 'e': b.e}}) AS near FROM x JOIN b{k} b ON b.p = x.p GROUP BY row_id, x.p),"""
        if k < rounds:
            out += f"""
s{k} AS (
  SELECT p, e, i, sum(c)::BIGINT AS s, count(*) AS n FROM (SELECT x.p, near.e AS e, unnest(range(len(x.x))) AS i, unnest(x.x)::BIGINT AS c FROM x JOIN a{k} a ON a.row_id = x.row_id AND a.p = x.p) GROUP BY p, e, i),
m{k} AS (SELECT p, e, list((CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END)::DOUBLE ORDER BY i) AS c FROM s{k} GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e),"""
    return out + f"""
code AS (SELECT row_id, string_agg(printf('%02x', near.e), '' ORDER BY p) AS code, sum(near.d)::BIGINT AS error FROM a{rounds} GROUP BY row_id),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN code USING (row_id), books
"""


OP13_SQL = lloyd_sql()
