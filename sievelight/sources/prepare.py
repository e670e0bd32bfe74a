"""Files to units of normalized Markdown, through adapters that can be added to."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.hashing import canonical_hash, hash_bytes
from ..functions.text import fence_code, normalize_markdown, real_text
from .office import document_markdown, slides
from .pdf import pdf_pages
from .sheets import read_sheets, sheet_markdown

#: An adapter gives (unit key, Markdown) pairs for a file's name and bytes.
Adapter = Callable[[str, bytes], Iterator[tuple[str, str]]]

#: Extensions of source code and the names of their fences.
CODE = {"py": "python", "rs": "rust", "go": "go", "js": "javascript", "ts": "typescript", "java": "java", "c": "c", "cpp": "cpp", "sh": "sh", "sql": "sql", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml"}


def looks_like_text(data: bytes) -> bool:
    """No NUL anywhere, UTF-8 throughout, and real text."""
    if b"\0" in data:
        return False
    try:
        return real_text(data.decode())
    except UnicodeDecodeError:
        return False


def as_text(name: str, data: bytes) -> Iterator[tuple[str, str]]:
    yield "file", data.decode("utf-8", "replace")


def as_code(name: str, data: bytes) -> Iterator[tuple[str, str]]:
    yield "file", fence_code(data.decode("utf-8", "replace"), CODE[name.rsplit(".", 1)[-1].lower()])


def as_sheets(name: str, data: bytes) -> Iterator[tuple[str, str]]:
    seen: dict[str, int] = {}
    for sheet, rows in read_sheets(data):
        key = sheet.replace("#", "##")
        seen[key] = seen.get(key, 0) + 1
        yield f"sheet:{key}" + (f"#{seen[key]}" if seen[key] > 1 else ""), sheet_markdown(rows)


def as_pages(name: str, data: bytes) -> Iterator[tuple[str, str]]:
    for i, text in enumerate(pdf_pages(data), 1):
        yield f"page:{i}", text


def as_document(name: str, data: bytes) -> Iterator[tuple[str, str]]:
    yield "file", document_markdown(data)


def as_slides(name: str, data: bytes) -> Iterator[tuple[str, str]]:
    yield from slides(data)


ADAPTERS: dict[str, Adapter] = {"docx": as_document, "pptx": as_slides, "md": as_text, "txt": as_text, "markdown": as_text, "xlsx": as_sheets, "pdf": as_pages, **dict.fromkeys(CODE, as_code)}

UNITS = "path string, raw_hash string, tool_profile_hash string, gen long, unit_key string, text string, error string"


def prepare(files: DataFrame, adapters: dict[str, Adapter] | None = None, gen: int = 1) -> DataFrame:
    """Units of every file (path, content): what its adapter gives, normalized, under the hash of the adapter's name.

    ``adapters`` adds or replaces some by extension: one for office files may call a
    converter, one for images a recognizer. A file of unknown kind is read as text if
    it looks like text. A file that fails, or has no adapter, gives one row with an
    error and no text.
    """
    chosen = ADAPTERS | (adapters or {})
    names = [c.split()[0] for c in UNITS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path, data in zip(b["path"], b["content"], strict=True):
                name, data = path.rsplit("/", 1)[-1], bytes(data)
                adapter = chosen.get(name.rsplit(".", 1)[-1].lower() if "." in name else "") or (as_text if looks_like_text(data) else None)
                raw = hash_bytes(data)
                if adapter is None:
                    rows.append((path, raw, None, gen, None, None, "unsupported"))
                    continue
                profile = canonical_hash({"adapter": adapter.__name__, "spec_version": 1})
                try:
                    rows += [(path, raw, profile, gen, key, normalize_markdown(text), None) for key, text in adapter(name, data)]
                except Exception as e:  # one broken file must not end the scan of a folder
                    rows.append((path, raw, profile, gen, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, UNITS)
