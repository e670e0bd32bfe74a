"""Text of word-processor and slide files, straight from their XML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

MOST_BYTES = 256 << 20


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def part(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if z.getinfo(name).file_size > MOST_BYTES:
        raise ValueError(f"a part is too large: {name}")
    return ElementTree.fromstring(z.read(name))


def paragraph(p: ElementTree.Element) -> str:
    out = []
    for e in p.iter():
        if (kind := local(e.tag)) == "t":
            out.append(e.text or "")
        elif kind == "tab":
            out.append("\t")
        elif kind in ("br", "cr"):
            out.append("\n")
    return "".join(out).strip()


def document_markdown(data: bytes) -> str:
    """Paragraphs and tables of a word-processor file; styles named Heading n become headings."""
    from .sheets import markdown_table

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(e for e in part(z, "word/document.xml").iter() if local(e.tag) == "body")
    out = []
    for e in body:
        if local(e.tag) == "tbl":
            rows = [[" ".join(filter(None, (paragraph(p) for p in c.iter() if local(p.tag) == "p"))) for c in r if local(c.tag) == "tc"] for r in e if local(r.tag) == "tr"]
            out.append(markdown_table(rows))
        elif local(e.tag) == "p" and (text := paragraph(e)):
            style = next((v for s in e.iter() if local(s.tag) == "pStyle" for k, v in s.attrib.items() if local(k) == "val"), "")
            level = re.fullmatch(r"(?i)heading\s*([1-6])", style)
            out.append(f"{'#' * int(level[1])} {text}" if level else text)
    return "\n\n".join(out) + "\n"


def slides(data: bytes) -> Iterator[tuple[str, str]]:
    """(unit key, text) of every slide in the order of their numbers; the first paragraph is the heading."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        numbers = sorted(int(m[1]) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for k in numbers:
            texts = [t for p in part(z, f"ppt/slides/slide{k}.xml").iter() if local(p.tag) == "p" and (t := paragraph(p))]
            yield f"slide:{k}", "\n\n".join(["# " + texts[0], *texts[1:]]) + "\n" if texts else ""
