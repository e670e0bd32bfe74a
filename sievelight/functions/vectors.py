"""Vectors: cosines in double precision, truncation, and an offline token embedding."""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def finite_vector(a: Column) -> Column:
    return a.isNotNull() & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


@F.pandas_udf(T.BinaryType())
def encoded(vectors: pd.Series) -> pd.Series:
    """A vector as little-endian single floats; null where it is null or has a null or non-finite component."""

    def one(v) -> bytes | None:
        if v is None or any(x is None for x in v):
            return None
        a = np.asarray(v, dtype="<f4")
        return a.tobytes() if np.isfinite(a).all() else None

    return vectors.map(one)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decoded(data: pd.Series) -> pd.Series:
    """The vector of little-endian single floats; null where the bytes are no whole number of finite ones."""

    def one(b) -> np.ndarray | None:
        if b is None or len(b) % 4:
            return None
        a = np.frombuffer(b, dtype="<f4")
        return a.astype(np.float32) if np.isfinite(a).all() else None

    return data.map(one)


def rank_cosine(a: Column, b: Column) -> Column:
    """Cosine for ranking: null (the row is dropped) where widths differ, a norm is zero or the value is not finite."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & finite_vector(a) & (n > 0), dot(a, b) / n)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine for diversifying: zero where a norm is zero."""
    n = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / n if n > 0 else 0.0


def truncated(a: Column, dimensions: int) -> Column:
    """The first ``dimensions`` components at unit length; null where there are fewer or all are zero."""
    head = F.slice(a, 1, dimensions)
    n = norm(head)
    return F.when((F.size(a) >= dimensions) & (n > 0), F.transform(head, lambda x: (x.cast("double") / n).cast("float")))


def token_embedding(text: str, dimensions: int = 768, anchor: bytes = b"reference-anchor\0") -> np.ndarray:
    """A deterministic embedding of lower-case ASCII tokens.

    Each adds four signed features taken from its SHA-256; the first token of twelve
    hexadecimal digits adds 64 more of weight 16, hashed behind ``anchor``. A text
    without tokens is hashed whole.
    """
    tokens = [t.lower().encode() for t in re.findall(r"[A-Za-z0-9]+", text)]
    v = np.zeros(dimensions, dtype=np.float32)

    def add(data: bytes, count: int, weight: float) -> None:
        for i in range(count):
            d = hashlib.sha256(data + struct.pack("<I", i)).digest()
            v[int.from_bytes(d[:2], "little") % dimensions] += -weight if d[2] & 1 else weight

    first = next((i for i, t in enumerate(tokens) if re.fullmatch(rb"[0-9a-f]{12}", t)), None)
    for i, t in enumerate(tokens or [text.encode()]):
        add(t, 4, 1.0)
        if i == first:
            add(anchor + t, 64, 16.0)
    n = np.sqrt((v * v).sum())
    return v / n if n > 0 else v


@F.pandas_udf(T.ArrayType(T.FloatType()))
def token_embedding_col(s: pd.Series) -> pd.Series:
    return s.map(lambda t: token_embedding(t).tolist(), na_action="ignore")
