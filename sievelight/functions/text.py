"""Text rules that need a loop over characters or lines, in plain Python, and their Arrow columns.

Unicode white space follows the White_Space property, which leaves out U+001C to
U+001F, so ``str.isspace`` and ``str.split()`` are not used where that matters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points with the White_Space property.
WHITE_SPACE = "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
FENCES = ("```", "~~~")
#: The blocks whose characters a slug keeps (hiragana, katakana, unified ideographs).
SLUG_BLOCKS = "\u3040-\u309f\u30a0-\u30ff\u4e00-\u9fff"

_SLUG_DROP = re.compile(f"[^a-z0-9_{SLUG_BLOCKS}-]+")
_SLUG_DASH = re.compile(f"[{re.escape(WHITE_SPACE)}-]+")
_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def is_fence(line: str) -> bool:
    """A line that begins or ends fenced code: three back quotes or tildes after white space."""
    return line.lstrip(WHITE_SPACE).startswith(FENCES)


def slugify(heading: str) -> str:
    """NFC, ASCII lower case, white space and dashes to single dashes, other characters outside the alphabet dropped."""
    s = unicodedata.normalize("NFC", heading).translate(_ASCII_LOWER)
    s = _SLUG_DROP.sub("", _SLUG_DASH.sub("-", s))
    return re.sub("-+", "-", s).strip("-")


def normalize_markdown(text: str) -> str:
    """BOM dropped, LF line ends, NFC, trailing blanks of lines stripped, underlined headings to # outside fences, one final LF."""
    text = unicodedata.normalize("NFC", text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n"))
    lines, out, fence = [line.rstrip(" \t") for line in text.split("\n")], [], None
    for line in lines:
        mark = line.lstrip(" ")[:3]
        if mark in FENCES and (fence is None or mark == fence):
            fence = None if fence else mark
            out.append(line)
        elif fence is None and out and re.fullmatch(r" {0,3}(=+|-{2,})", line) and out[-1].strip() and not re.match(r" {0,3}([#>|]|[-*+] |\d+[.)] )", out[-1]) and out[-1].lstrip(" ")[:3] not in FENCES:
            out[-1] = ("# " if "=" in line else "## ") + out[-1].strip()
        else:
            out.append(line)
    return "\n".join(out).rstrip("\n") + "\n"


def fence_code(text: str, language: str = "") -> str:
    """Code as one fenced block, with a fence longer than any run of back quotes in it."""
    run = max([2, *map(len, re.findall("`+", text))])
    mark = "`" * max(3, run + 1)
    return f"{mark}{language}\n{text.rstrip(chr(10))}\n{mark}\n"


_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])|&(lt|gt|amp);")
_ENTITY = {"lt": "<", "gt": ">", "amp": "&"}
_CODE_SPAN = re.compile(r"(`+)(?!`)(.*?)(?<!`)\1(?!`)", re.S)


def _unescape(part: str) -> str:
    return _ESCAPE.sub(lambda m: m[1] or _ENTITY[m[2]], part)


def search_projection(text: str) -> str:
    """NFC without NUL, Markdown escapes and entities resolved outside fenced code and code spans."""
    out, fence, prose = [], False, []

    def flush() -> None:
        joined, at = "".join(prose), 0
        for m in _CODE_SPAN.finditer(joined):
            if joined[: m.start()].endswith("\\"):
                continue
            out.extend((_unescape(joined[at : m.start()]), m[0]))
            at = m.end()
        out.append(_unescape(joined[at:]))
        prose.clear()

    for line in unicodedata.normalize("NFC", text.replace("\0", "")).splitlines(keepends=True):
        if is_fence(line):
            flush()
            fence = not fence
            out.append(line)
        elif fence:
            out.append(line)
        else:
            prose.append(line)
    flush()
    return "".join(out)


def escape_source(text: str) -> str:
    """Inverse of the projection: a backslash before ASCII punctuation, entities for & < >."""
    return "".join({"&": "&amp;", "<": "&lt;", ">": "&gt;"}.get(c) or (f"\\{c}" if "!" <= c <= "~" and not c.isalnum() else c) for c in text)


def collision_key(name: str) -> str:
    """Names with one key cannot stand side by side on a file system that folds case."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", name).casefold())


def script_of(c: str) -> str:
    if "\u3040" <= c <= "\u309f":
        return "hiragana"
    if "\u30a0" <= c <= "\u30ff":
        return "katakana"
    if "\u4e00" <= c <= "\u9fff" or c in "\u3005\u3007":
        return "kanji"
    return "word" if c.isalnum() else ""


def query_units(query: str) -> list[str]:
    """Tokens of a query and their pieces between script borders, without repeats, in order.

    A point or comma between digits belongs to the number.
    """
    out: dict[str, None] = {}
    for token in re.split(f"[{re.escape(WHITE_SPACE)}]+", unicodedata.normalize("NFC", query)):
        if not token:
            continue
        out[token] = None
        piece, last = "", ""
        for i, c in enumerate(token):
            kind = script_of(c)
            if c in ".," and 0 < i < len(token) - 1 and token[i - 1].isdigit() and token[i + 1].isdigit():
                kind = "word"
            if kind != last and piece:
                out[piece] = None
                piece = ""
            piece, last = piece + c if kind else "", kind
        if piece:
            out[piece] = None
    return list(out)


def number_forms(token: str) -> list[str]:
    """A number of four or more digits with and without thousands separators; any other token alone."""
    if re.fullmatch(r"\d{4,}", token):
        return [token, f"{int(token):,}"] if not token.startswith("0") else [token]
    if re.fullmatch(r"\d{1,3}(,\d{3})+", token):
        return [token, token.replace(",", "")]
    return [token]


def match_plan(query: str) -> tuple[list[str], list[list[str]]]:
    """(phrases to match, forms of short tokens): phrases have three characters or more; short tokens count only if there is no phrase.

    A query without a token is an error.
    """
    units = query_units(query)
    if not units:
        raise ValueError("the query has no token")
    phrases = [f for u in units for f in number_forms(u) if len(f) >= 3]
    return (list(dict.fromkeys(phrases)), []) if phrases else ([], [number_forms(u) for u in units])


_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def duration_seconds(value: str) -> int:
    """Seconds of ``<n><s|m|h|d|w>``; zero and anything else is an error."""
    m = re.fullmatch(r"(\d+)([smhdw])", value)
    if not m or int(m[1]) == 0:
        raise ValueError(f"not a duration: {value}")
    return int(m[1]) * _UNITS[m[2]]


def text_column(fn, kind: T.DataType = T.StringType()):
    """A function of one string as an Arrow-batched column function; null stays null."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action="ignore")

    return run


#: Bytes of strings that ``computed`` works on at once.
SLICE_BYTES = 4 << 20


def computed(df: DataFrame, columns: dict[str, tuple[Callable[[str], str], str]]) -> DataFrame:
    """``df`` with columns that are each a function of a string column, one of ``df`` or one before it; null stays null.

    All are made in one pass and handed over in slices, so that a task holds few of the long ones.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, min(1000, SLICE_BYTES * whole.num_rows // max(1, whole.nbytes)))
            for k in range(0, whole.num_rows, step):
                b = whole.slice(k, step)
                made: dict[str, list] = {}
                for name, (fn, source) in columns.items():
                    made[name] = [None if s is None else fn(s) for s in (made[source] if source in made else b.column(source).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(m, pa.string()) for m in made.values())], [*names, *made])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(name, T.StringType()) for name in columns)]))


slugify_col = text_column(slugify)
normalize_markdown_col = text_column(normalize_markdown)
search_projection_col = text_column(search_projection)
collision_key_col = text_column(collision_key)
nfc_col = text_column(lambda s: unicodedata.normalize("NFC", s))


def filename_context(path: Column) -> Column:
    """Words of a file's stem: dashes and underscores to spaces, camel case split; null without a letter or digit."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    words = F.regexp_replace(F.regexp_replace(stem, "[-_]+", " "), r"(?<=[a-z0-9])(?=[A-Z])", " ")
    words = F.trim(F.regexp_replace(words, r"\s+", " "))
    return F.when(words.rlike(r"[\p{L}\p{N}]"), words)


def related_images(markdown: Column, scheme: str) -> Column:
    """Hashes of images that the text cites as ``![..](<scheme>://<scope>/object/image/<hash>)``, once each, in order."""
    found = F.regexp_extract_all(markdown, F.lit(rf"!\[[^\]]*\]\({scheme}://[^/)\s]+/object/image/(sha256:[0-9a-f]{{64}})\)"), F.lit(1))
    return F.array_distinct(found)


def leaf_section(section_id: Column, heading_slug: Column) -> Column:
    """Last part of the section id, or the slug of the last heading where the id is null or empty."""
    return F.coalesce(F.nullif(F.element_at(F.split(section_id, "/"), -1), F.lit("")), heading_slug)


def real_text(text: str, percent: int = 85) -> bool:
    """At least ``percent`` % of the characters, those around the text's ends left aside, are printable or white space."""
    body = text.strip()
    printable = sum(c != "\ufffd" and (unicodedata.category(c) != "Cc" or c.isspace()) for c in body)
    return bool(body) and printable * 100 >= len(body) * percent


def is_real_text(text: Column, percent: int = 85) -> Column:
    """At least ``percent`` % of the characters are printable (or tab and line ends)."""
    printable = F.length(F.regexp_replace(text, r"[\p{Cc}\p{Cs}\p{Co}\p{Cn}\uFFFD&&[^\t\n\r]]", ""))
    return (F.length(text) > 0) & (printable * 100 >= F.length(text) * percent)


def duration_column(value: Column) -> Column:
    """Seconds of a duration; null where it is none."""
    n = F.regexp_extract(value, r"^(\d+)([smhdw])$", 1)
    unit = F.regexp_extract(value, r"^(\d+)([smhdw])$", 2)
    factor = F.create_map(*[F.lit(x) for kv in _UNITS.items() for x in kv])
    return F.when(n != "", n.cast("bigint") * F.element_at(factor, unit))


def occurrences(lowered: Column, phrase: str) -> Column:
    """Places where a phrase starts in a lower-case text (overlapping ones count), without regard to case."""
    quoted = re.sub(r"([^\w\s])", r"\\\1", phrase.lower())
    return F.when(F.contains(lowered, F.lit(phrase.lower())), F.regexp_count(lowered, F.lit(f"(?={quoted})"))).otherwise(F.lit(0))
