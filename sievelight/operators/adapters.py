"""Models as adapters: embeddings and relevance scores, made once a worker and checked on return."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ledger import RETRY

#: A model: texts in, one vector for each out. A function makes it in the worker, where it stays between batches and tasks.
Model = Callable[[list[str]], np.ndarray]
_made: dict[str, object] = {}


class AdapterError(Exception):
    """A failure that an adapter names itself, by a kind of the retry table."""

    def __init__(self, kind: str, message: str = ""):
        if kind not in {k for k, *_ in RETRY}:
            raise ValueError(f"unknown kind of error: {kind}")
        super().__init__(message or kind)
        self.kind = kind

    def __reduce__(self):
        return AdapterError, (self.kind, str(self))


@dataclass(frozen=True)
class Profile:
    """What a model gives and takes: its name and version, vector width, and the most texts and characters of a call and of a text."""

    name: str
    dimensions: int
    most_texts: int = 64
    most_chars: int = 100_000
    longest: int = 20_000


def made_once(name: str, make: Callable[[], object]):
    """In a worker: what ``make`` gave for a name; one model is kept at a time."""
    if name not in _made:
        _made.clear()
        _made[name] = make()
    return _made[name]


def calls(texts: list[str | None], profile: Profile) -> Iterator[list[int]]:
    """Positions of the texts of each call: no more texts and characters than allowed, without null and overlong ones."""
    now, size = [], 0
    for i, t in enumerate(texts):
        if t is None or len(t) > profile.longest:
            continue
        if now and (len(now) >= profile.most_texts or size + len(t) > profile.most_chars):
            yield now
            now, size = [], 0
        now.append(i)
        size += len(t)
    if now:
        yield now


def sound(vectors: object, n: int, dimensions: int) -> list[list[float] | None]:
    """The vectors of a call, null for those that are not of the width, not finite or of norm zero; all null if there are not ``n``."""
    try:
        rows = np.asarray(vectors, dtype=np.float32)
    except (TypeError, ValueError):
        return [None] * n
    if rows.shape != (n, dimensions):
        return [None] * n
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
    return [r.tolist() if math.isfinite(x) and x > 0 else None for r, x in zip(rows, norms.tolist(), strict=True)]


def embedded(rows: DataFrame, make: Callable[[], Model], profile: Profile, *, text: str = "text") -> DataFrame:
    """``rows`` with vector and error: what the model gives for each text, or why it gives none.

    error is a kind of the retry table: invalid_input for null and overlong texts,
    contract_violation for vectors of another number or width, not finite or of norm zero, and what an
    AdapterError names; any other exception of a model is network_error. A failed call fails its texts
    alone. Repeated texts are asked for once a batch.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = made_once(profile.name, make)
        for b in batches:
            values = b.column(text).to_pylist()
            texts = list(dict.fromkeys(values))
            found: dict[str | None, tuple[list[float] | None, str | None]] = {t: (None, "invalid_input") for t in texts}
            for call in calls(texts, profile):
                asked = [texts[i] for i in call]
                try:
                    got = [(v, None if v else "contract_violation") for v in sound(model(asked), len(asked), profile.dimensions)]
                except AdapterError as e:
                    got = [(None, e.kind)] * len(asked)
                except Exception:
                    got = [(None, "network_error")] * len(asked)
                found.update(zip(asked, got, strict=True))
            vectors, errors = zip(*(found[t] for t in values), strict=True) if values else ((), ())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], [*names, "vector", "error"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())]))


def rescored(candidates: DataFrame, make: Callable[[], Callable[[str, list[str]], list[float]]], profile: Profile) -> DataFrame:
    """candidates(query_id, query, rank, text, ...) ranked anew by a model that scores texts against a query: new_rank and failed.

    It only reorders: each query keeps its rows. Ties keep their order. Where the model fails, or returns another number of
    scores or one that is not finite, the query keeps its order, marked failed. The rows of one query are a
    bounded number (a cut of the lanes) and meet in one group; texts are cut to ``longest`` characters.
    """
    names = candidates.columns
    schema = T.StructType([*candidates.schema.fields, T.StructField("new_rank", T.IntegerType()), T.StructField("failed", T.BooleanType())])

    def rank(t: pa.Table) -> pa.Table:
        model = made_once(profile.name, make)
        t = t.sort_by("rank")
        texts = [(x or "")[: profile.longest] for x in t.column("text").to_pylist()]
        scores: list[float] = []
        try:
            for i in range(0, len(texts), profile.most_texts):
                part = texts[i : i + profile.most_texts]
                got = [float(s) for s in model(t.column("query")[0].as_py(), part)]
                if len(got) != len(part) or not all(map(math.isfinite, got)):
                    raise AdapterError("contract_violation")
                scores += got
            failed = False
        except Exception:
            scores, failed = [0.0] * len(texts), True
        order = sorted(range(len(texts)), key=lambda i: -scores[i])
        new = [0] * len(texts)
        for place, i in enumerate(order, 1):
            new[i] = place
        return t.select(names).append_column("new_rank", pa.array(new, pa.int32())).append_column("failed", pa.array([failed] * len(texts), pa.bool_()))

    return candidates.groupBy(F.col("query_id")).applyInArrow(rank, schema)
