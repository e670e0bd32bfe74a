"""Content identity: prefixed SHA-256, canonical JSON, and the ids made of them."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH = r"^sha256:[0-9a-f]{64}$"


def content_hash(column: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(column, 256))


def hash_bytes(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def _number(x: float) -> str:
    """A double as ECMAScript writes it."""
    if not math.isfinite(x):
        raise ValueError("canonical JSON has finite numbers only")
    if x == 0:
        return "0"
    digits, _, exp = f"{abs(x):.17e}".partition("e")
    for p in range(17):
        digits, _, exp = f"{abs(x):.{p}e}".partition("e")
        if float(f"{digits}e{exp}") == abs(x):
            break
    d, e = digits.replace(".", "").rstrip("0") or "0", int(exp)
    if 0 <= e < 21:
        s = d[: e + 1].ljust(e + 1, "0") + (f".{d[e + 1 :]}" if len(d) > e + 1 else "")
    elif -7 < e < 0:
        s = "0." + "0" * (-e - 1) + d
    else:
        s = d[0] + (f".{d[1:]}" if len(d) > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return ("-" if x < 0 else "") + s


def canonical_json(value) -> str:
    """RFC 8785: keys in UTF-16 order, no white space, ECMAScript numbers."""
    if isinstance(value, dict):
        items = sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be"))
        return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(v)}" for k, v in items) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def canonical_hash(value) -> str:
    return hash_bytes(canonical_json(value).encode())


def chunk_id(*, raw_hash: str, tool_profile_hash: str, gen: int, unit_key: str, unit_content_hash: str, heading_path: list[str], byte_start: int, byte_end: int, section_id: str | None = None) -> str:
    """Identity of a chunk; an absent or empty section id is left out."""
    body = {"spec_version": 1, "raw_hash": raw_hash, "tool_profile_hash": tool_profile_hash, "gen": gen, "unit_key": unit_key, "unit_content_hash": unit_content_hash, "heading_path": list(heading_path), "byte_start": byte_start, "byte_end": byte_end}
    return canonical_hash(body | ({"section_id": section_id} if section_id else {}))


def embedding_id(*, target_type: str, target_hash: str, dimensions: int, distance: str, modality: str, profile_hash: str, context: str | None = None) -> str:
    """Identity of an embedding by content; an absent context is left out."""
    body = {"dimensions": dimensions, "distance": distance, "modality": modality, "profile_hash": profile_hash, "spec_version": 1, "target_hash": target_hash, "target_type": target_type}
    return canonical_hash(body | ({} if context is None else {"context": context}))


def chunking_config_hash(max_chars: int = 6000, strategy: str = "heading") -> str:
    return canonical_hash({"max_chars": max_chars, "spec_version": 1, "strategy": strategy})


def json_struct(**fields: Column) -> Column:
    """Canonical JSON of strings and integers in Spark: keys in order, null fields left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "true"})


def chunk_id_column(raw_hash: Column, tool_profile_hash: Column, gen: Column, unit_key: Column, unit_content_hash: Column, heading_path: Column, byte_start: Column, byte_end: Column, section_id: Column) -> Column:
    """``chunk_id`` without Python; equal to it while no string has a character that JSON writers escape differently."""
    body = json_struct(raw_hash=raw_hash, tool_profile_hash=tool_profile_hash, gen=gen, unit_key=unit_key, unit_content_hash=unit_content_hash, heading_path=heading_path, byte_start=byte_start, byte_end=byte_end, section_id=F.nullif(section_id, F.lit("")), spec_version=F.lit(1))
    return content_hash(body)


def embedding_id_column(target_type: Column, target_hash: Column, dimensions: Column, distance: Column, modality: Column, profile_hash: Column, context: Column) -> Column:
    """``embedding_id`` without Python, under the same condition."""
    return content_hash(json_struct(target_type=target_type, target_hash=target_hash, dimensions=dimensions, distance=distance, modality=modality, profile_hash=profile_hash, context=context, spec_version=F.lit(1)))


def chunking_config_column(max_chars: Column, strategy: Column) -> Column:
    return content_hash(json_struct(max_chars=max_chars, strategy=strategy, spec_version=F.lit(1)))


def tool_profile_column(tool: Column, version: Column, options: Column) -> Column:
    """Identity of a tool with its version and options; absent options are left out."""
    return content_hash(json_struct(tool=tool, version=version, options=options, spec_version=F.lit(1)))


def fingerprint_column(text_layer: Column, prepared: Column) -> Column:
    """text_hash of the text layer, and of the prepared bytes the perceptual and the visual hash, which are one."""
    whole = content_hash(prepared)
    return F.struct(content_hash(text_layer).alias("text_hash"), whole.alias("perceptual_hash"), whole.alias("visual_hash"))


@F.pandas_udf(T.StringType())
def input_hash(query: pd.Series) -> pd.Series:
    """Hash of a query's NFC form: the query itself is never stored."""
    return query.map(lambda q: None if q is None else hash_bytes(unicodedata.normalize("NFC", q).encode()))


def unit_ref(unit_key: Column) -> Column:
    return F.substring(F.sha2(unit_key, 256), 1, 16)


def idempotency_key(input_hash: Column, profile: Column) -> Column:
    return content_hash(F.concat(input_hash, F.lit("\0"), profile))


def prompt_hash(template: str) -> str:
    """Hash of a prompt template in NFC with LF line ends, without trailing blanks and trailing empty lines."""
    lines = [x.rstrip(" \t") for x in template.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    while lines and not lines[-1]:
        lines.pop()
    return hash_bytes(unicodedata.normalize("NFC", "\n".join(lines)).encode())
