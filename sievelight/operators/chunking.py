"""Heading-scoped chunks with content-derived ids."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.hashing import chunk_id, hash_bytes
from ..functions.text import WHITE_SPACE, is_fence, slugify

_HEADING = re.compile(f"(#{{1,6}})[{re.escape(WHITE_SPACE)}](.*)", re.S)


def headings(lines: list[str]) -> list[tuple[int, int, str]]:
    """(line number, level, text) of # headings outside fences; empty ones are none."""
    out, fenced = [], False
    for i, line in enumerate(lines):
        if is_fence(line):
            fenced = not fenced
        if not fenced and (m := _HEADING.fullmatch(line.removesuffix("\n").removesuffix("\r"))):
            text = m[2].strip(WHITE_SPACE).rstrip("#").strip(WHITE_SPACE)
            if text:
                out.append((i, len(m[1]), text))
    return out


def sections(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, heading path) in characters; what stands before the first heading has the path []."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    found = headings(lines)
    if not found:
        return [(0, len(text), [])]
    out = [(0, starts[found[0][0]], [])] if found[0][0] else []
    path: list[str] = []
    for k, (i, level, title) in enumerate(found):
        path = [*path[: level - 1], title]
        out.append((starts[i], starts[found[k + 1][0]] if k + 1 < len(found) else len(text), path))
    return out


_BLANK_LINES = re.compile(f"\n[{re.escape(WHITE_SPACE)}]*\n")


def pieces(text: str, start: int, end: int, max_chars: int) -> Iterator[tuple[int, int]]:
    """A section cut to at most ``max_chars`` characters: just after the last blank line of the window, else hard."""
    while end - start > max_chars:
        window = text[start : start + max_chars]
        last = None
        for m in _BLANK_LINES.finditer(window):
            last = m.end()
        cut = start + (last or max_chars)
        yield start, cut
        start = cut
        while start < end and text[start] in WHITE_SPACE:
            start += 1
    if start < end:
        yield start, end


def chunk_unit(unit: dict, max_chars: int = 6000) -> Iterator[dict]:
    """Chunks of one unit: raw_hash, tool_profile_hash, gen, unit_key and text.

    Pieces of white space only are dropped. A heading slug that repeats within the unit
    gets #2, #3, ... in order. Spans are bytes of the unit's UTF-8 text.
    """
    text = unit["text"] or ""
    content = hash_bytes(text.encode())
    seen: dict[str, int] = {}
    told, place = 0, 0  # characters passed so far, and their bytes
    for start, end, path in sections(text):
        slug = "/".join(map(slugify, path))
        section = None
        if path:
            seen[slug] = seen.get(slug, 0) + 1
            section = slug if seen[slug] == 1 else f"{slug}#{seen[slug]}"
        for a, b in pieces(text, start, end, max_chars):
            body = text[a:b]
            if not body.strip(WHITE_SPACE):
                continue
            place += len(text[told:a].encode())
            told, at = a, place
            raw = body.encode()
            identity = {"raw_hash": unit["raw_hash"], "tool_profile_hash": unit["tool_profile_hash"], "gen": int(unit["gen"]), "unit_key": unit["unit_key"], "unit_content_hash": content, "heading_path": path, "byte_start": at, "byte_end": at + len(raw), "section_id": section}
            yield identity | {"chunk_id": chunk_id(**identity), "text_hash": hash_bytes(raw), "text": body}


#: Bytes of chunks that are handed over at once, and what a chunk takes besides its text.
BATCH_BYTES, ROW_BYTES = 4 << 20, 1 << 10
CHUNKS = "chunk_id string, raw_hash string, tool_profile_hash string, gen long, unit_key string, unit_content_hash string, heading_path array<string>, section_id string, byte_start long, byte_end long, text_hash string, text string"


def chunk(units: DataFrame, max_chars: int = 6000) -> DataFrame:
    """Chunks of every unit; units are independent, so no shuffle. A task holds BATCH_BYTES of chunks at once, and those of one unit."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    given = ["raw_hash", "tool_profile_hash", "gen", "unit_key", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, held = [], 0
            for u in zip(*(b[c] for c in given), strict=True):
                for c in chunk_unit(dict(zip(given, u, strict=True)), max_chars):
                    rows.append(c)
                    held += ROW_BYTES + len(c["text"])
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    return units.select(*given).mapInPandas(run, CHUNKS)
