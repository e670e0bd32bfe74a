"""Text of PDF pages: objects and object streams, Flate streams, text operators, ToUnicode maps.

Enough for text that programs write. Encrypted files and other stream filters give an
error or an empty page, never wrong text.
"""

from __future__ import annotations

import re
import zlib

MOST_PAGES, MOST_BYTES = 2_000, 64 << 20

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_STREAM = re.compile(rb"stream\r?\n")
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
#: Characters that a backslash names in a string.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Pdf:
    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF-"):
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\b", data):
            raise ValueError("the file is encrypted")
        self.objects: dict[int, bytes] = {}
        starts = list(_OBJECT.finditer(data))
        for m in starts:
            end = data.find(b"endobj", m.end())
            self.objects[int(m[1])] = data[m.end() : end if end >= 0 else len(data)]
        for body in list(self.objects.values()):
            if b"/ObjStm" in body.partition(b"stream")[0]:
                packed, head = self.stream(body), body.partition(b"stream")[0]
                first, count = (int(re.search(rb"/" + k + rb"\s+(\d+)", head)[1]) for k in (b"First", b"N"))
                numbers = list(map(int, packed[:first].split()))[: 2 * count]
                places = [*numbers[1::2], len(packed) - first]
                for number, a, b in zip(numbers[::2], places, places[1:], strict=False):
                    self.objects.setdefault(number, packed[first + a : first + b])

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        raw, head = body[m.end() :].rpartition(b"endstream")[0], body[: m.start()]
        filters = re.findall(rb"/(\w+Decode)\b", head)
        if not filters:
            return raw
        if filters != [b"FlateDecode"] or re.search(rb"/Predictor\s+([2-9]|1\d)", head):
            raise ValueError("a stream has a filter that is not read")
        out = zlib.decompressobj().decompress(raw, MOST_BYTES)
        if len(out) >= MOST_BYTES:
            raise ValueError("a stream is too large")
        return out

    def entry(self, body: bytes, key: bytes) -> bytes:
        """The value of a key: what a reference names, or the text that follows."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*", body)
        if not m:
            return b""
        if ref := _REF.match(body, m.end()):
            return self.objects.get(int(ref[1]), b"")
        return body[m.end() :]

    def pages(self) -> list[bytes]:
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        out: list[bytes] = []

        def walk(node: bytes, seen: frozenset[bytes]) -> None:
            if node in seen:
                return
            if len(out) >= MOST_PAGES:
                raise ValueError(f"more than {MOST_PAGES} pages")
            kids = re.search(rb"/Kids\s*\[(.*?)\]", node, re.S)
            if kids:
                for ref in _REF.findall(kids[1]):
                    walk(self.objects.get(int(ref), b""), seen | {node})
            elif re.search(rb"/Type\s*/Page\b", node):
                out.append(node)

        walk(self.entry(root, b"Pages"), frozenset())
        return out

    def maps(self, page: bytes) -> dict[bytes, dict[bytes, str]]:
        """Font name -> character codes to text, of fonts with a ToUnicode map."""
        fonts = self.entry(self.entry(page, b"Resources") or page, b"Font")
        out = {}
        for name, ref in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", fonts.partition(b">>")[0]):
            cmap = self.stream(self.entry(self.objects.get(int(ref), b""), b"ToUnicode"))
            if cmap:
                out[name] = code_map(cmap)
        return out

    def text(self, page: bytes) -> str:
        found = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        content = b"\n".join(self.stream(self.objects.get(int(r), b"")) for r in _REF.findall(found[1])) if found else b""
        maps, font, parts, stack = self.maps(page), {}, [], []
        for m in _TOKEN.finditer(content):
            t = m[0]
            if t[:1] in b"(<[]/" or t[:1] in b"+-.0123456789":
                stack.append(t)
                continue
            if t == b"Tf":
                names = [x for x in stack if x[:1] == b"/"]
                font = maps.get(names[-1][1:], {}) if names else {}
            elif t in (b"Tj", b"TJ", b"'", b'"'):
                if t in (b"'", b'"'):
                    parts.append("\n")
                for x in stack:
                    if x[:1] in b"(<":
                        parts.append(decode(x, font))
                    elif t == b"TJ" and x[:1] not in b"[]/" and float(x) < -200:
                        parts.append(" ")
            elif t in (b"T*", b"Td", b"TD", b"Tm", b"ET"):
                parts.append("\n")
            stack.clear()
        lines = (re.sub(r"[ \t]+", " ", x).strip() for x in "".join(parts).split("\n"))
        return "\n".join(x for x in lines if x)


def string_bytes(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def one(m: re.Match) -> bytes:
        x = m[1]
        if x[:1] in b"01234567":
            return bytes([int(x, 8) & 255])
        return _ESCAPES.get(x, b"" if x in (b"\n", b"\r\n") else x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)


def decode(token: bytes, codes: dict[bytes, str]) -> str:
    raw = string_bytes(token)
    if not codes:
        return raw.decode("cp1252", "replace")
    width = max(map(len, codes))
    return "".join(codes.get(raw[i : i + width], "") for i in range(0, len(raw), width))


def code_map(cmap: bytes) -> dict[bytes, str]:
    out: dict[bytes, str] = {}
    as_text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[bytes.fromhex(a.decode())] = as_text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            low, high, base = int(a, 16), int(b, 16), int(c, 16)
            for k in range(low, min(high, low + 65_535) + 1):
                out[k.to_bytes(len(a) // 2, "big")] = (base + k - low).to_bytes(len(c) // 2, "big").decode("utf-16-be", "replace")
    return out


def pdf_pages(data: bytes) -> list[str]:
    """The text of every page, in order."""
    p = Pdf(data)
    return [p.text(page) for page in p.pages()]
