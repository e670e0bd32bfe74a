"""Evidence pointers: self-contained citations, their URIs, and whether they still hold."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import canonical_hash, canonical_json

SCHEME = "evidence"
_HASH = re.compile(r"sha256:[0-9a-f]{64}")


@dataclass(frozen=True)
class Pointer:
    scope_id: str
    commit_hash: str
    raw_hash: str
    chunk_id: str
    path: str
    byte_start: int
    byte_end: int

    def check(self) -> Pointer:
        for name in ("commit_hash", "raw_hash", "chunk_id"):
            if not _HASH.fullmatch(getattr(self, name)):
                raise ValueError(f"{name} is no hash")
        if not self.scope_id or "/" in self.scope_id or not 0 <= self.byte_start <= self.byte_end:
            raise ValueError("not a pointer")
        return self


def pointer_uri(p: Pointer, scheme: str = SCHEME) -> str:
    p.check()
    return f"{scheme}://{p.scope_id}/commit/{p.commit_hash}/chunk/{p.chunk_id}?raw={p.raw_hash}&bytes={p.byte_start}-{p.byte_end}&path={quote(p.path)}"


def parse_pointer(uri: str, scheme: str = SCHEME) -> Pointer:
    m = re.fullmatch(rf"{re.escape(scheme)}://([^/]+)/commit/([^/]+)/chunk/([^?]+)\?raw=([^&]+)&bytes=(\d+)-(\d+)&path=(.*)", uri)
    if not m:
        raise ValueError("not a pointer URI")
    return Pointer(m[1], m[2], m[4], m[3], unquote(m[7]), int(m[5]), int(m[6])).check()


def pointer_column(scope_id: Column, commit_hash: Column, chunk_id: Column, raw_hash: Column, byte_start: Column, byte_end: Column, path: Column, scheme: str = SCHEME) -> Column:
    """``pointer_uri`` of columns, without Python."""
    return F.concat(F.lit(f"{scheme}://"), scope_id, F.lit("/commit/"), commit_hash, F.lit("/chunk/"), chunk_id, F.lit("?raw="), raw_hash, F.lit("&bytes="), byte_start.cast("string"), F.lit("-"), byte_end.cast("string"), F.lit("&path="), F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")))


def verify(pointers: DataFrame, scopes: DataFrame, commits: DataFrame, entries: DataFrame, chunks: DataFrame, events: DataFrame) -> DataFrame:
    """Status of every pointer (pointer_id, scope_id, commit_hash, raw_hash, chunk_id).

    In this order: registry_duplicate where the scope is registered twice,
    scope_unreachable where it is not or not reachable, tombstoned where the last event
    of the raw hash (raw_hash, event) purged or erased it, not_found where the commit is
    unknown or its tree lacks the raw hash, unverifiable where the chunk is gone, else alive.
    """
    s = scopes.groupBy("scope_id").agg(F.count(F.lit(1)).alias("_scopes"), F.max(F.col("reachable").cast("int")).alias("_reach"))
    flag = lambda df, key, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    p = pointers.join(s, "scope_id", "left")
    p = p.join(flag(events.where("event in ('purged', 'erased')"), ["raw_hash"], "_gone"), "raw_hash", "left")
    p = p.join(flag(commits, ["commit_hash"], "_commit"), "commit_hash", "left")
    p = p.join(flag(entries, ["commit_hash", "raw_hash"], "_entry"), ["commit_hash", "raw_hash"], "left")
    p = p.join(flag(chunks, ["chunk_id", "raw_hash"], "_chunk"), ["chunk_id", "raw_hash"], "left")
    status = (
        F.when(F.col("_scopes") > 1, "registry_duplicate")
        .when(F.coalesce(F.col("_reach"), F.lit(0)) == 0, "scope_unreachable")
        .when(F.col("_gone"), "tombstoned")
        .when(F.col("_commit").isNull() | F.col("_entry").isNull(), "not_found")
        .when(F.col("_chunk").isNull(), "unverifiable")
        .otherwise("alive")
    )
    return p.select(*pointers.columns, status.alias("status"))


def retarget(pointers: DataFrame, chunks: DataFrame, most: int = 4096) -> DataFrame:
    """For each pointer the live chunks with the same text hash, if they are ``most`` or fewer: candidates and their number."""
    c = chunks.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first"))
    rows = pointers.join(c, "text_hash", "left")
    return rows.select(*pointers.columns, F.coalesce("n", F.lit(0)).alias("candidates"), F.when(F.col("n") == 1, F.col("first")).alias("target"), (F.coalesce("n", F.lit(0)) > most).alias("overflow"))


def query_hash(query: str, scopes: list[dict], *, cap: int = 3, depth: int = 100, lam: float = 0.7, **options) -> str:
    """Identity of a request: scopes sorted and unique, one configuration each; absent options left out."""
    ordered = sorted(scopes, key=lambda s: s["scope_id"])
    if len({s["scope_id"] for s in ordered}) != len(ordered):
        raise ValueError("a scope is named twice")
    body = {"query": query, "scopes": ordered, "max_per_raw_hash": cap, "mmr_depth": depth, "mmr_lambda": lam} | {k: v for k, v in options.items() if v is not None}
    return canonical_hash(body)


def encode_cursor(payload: dict, key: bytes) -> str:
    """A signed token: canonical JSON and its HMAC-SHA256, in URL-safe base64."""
    body = canonical_json({"version": 2} | payload).encode()
    pack = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    return f"{pack(body)}.{pack(hmac.new(key, body, hashlib.sha256).digest())}"


def decode_cursor(token: str, key: bytes, expect_query: str) -> dict:
    """The payload of a token, if signature, version and query are right."""
    unpack = lambda s: base64.urlsafe_b64decode(s + "=" * (-len(s) % 4))
    try:
        body, sign = map(unpack, token.split("."))
    except ValueError as e:
        raise ValueError("not a cursor") from e
    if not hmac.compare_digest(sign, hmac.new(key, body, hashlib.sha256).digest()):
        raise ValueError("the cursor's signature is wrong")
    payload = json.loads(body)
    if payload.get("version") != 2 or payload.get("query_hash") != expect_query or not isinstance(payload.get("consumed"), int) or payload["consumed"] < 0:
        raise ValueError("the cursor is of another query")
    return payload
