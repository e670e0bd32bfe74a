"""Language identification by prediction by partial matching.

For every language a byte context tree of variable order, up to ``ORDER`` bytes, is learned:
a context that occurred T times with D different successors gives a successor that occurred
c times c / (T + D), and leaves D / (T + D) to the shorter context (escape method C), where
the successors already seen are excluded. Once learned the statistics are frozen, so the
code length of a byte depends on the bytes before it only. The tree is kept as one hash
table a depth: a row per path that any language has seen, with the bits of its last byte
after the others in every language, and a row per context with the bits of its escape.
A byte's code length is found on the longest path known, plus the escapes above it; every
path and every byte of the rows learned from is in the tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_kept, fold, materialize, release, slices, table, unit_interval

LETTER = re.compile(r"[^\W\d_]")
#: Bytes that are scored, and that are counted, in one step; bounds the temporaries.
STEP, COUNTED = 1 << 18, 1 << 21
#: Bytes of the longest context; a path has one more and fits a long.
ORDER = 5
PAD = b" " * ORDER
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Rows:
    """A hash table of paths with a row of numbers each."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(codes)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        place = self.places(codes)
        order = np.argsort(place, kind="stable")
        self.codes, self.values = codes[order], values[order]
        self.starts = np.searchsorted(place[order], np.arange((1 << bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.starts).max(initial=0))

    def places(self, codes: np.ndarray) -> np.ndarray:
        mixed = codes * SPREAD
        mixed ^= mixed >> np.uint64(29)
        mixed *= SPREAD
        return mixed >> self.shift

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The row of every path, -1 where there is none."""
        place = self.places(codes).astype(np.int64)
        at, end = self.starts[place], self.starts[place + 1]
        out = np.full(len(codes), -1, dtype=np.int64)
        todo = np.flatnonzero(at < end)
        for _ in range(self.longest):
            if not len(todo):
                break
            hit = self.codes[at[todo]] == codes[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out


@dataclass
class Model:
    langs: list[str]
    paths: list[Rows]  # by depth: bits of the last byte
    escapes: list[Rows]  # by depth: bits of leaving the context


def codes_of(text: bytes) -> np.ndarray:
    """Of every byte from the one at ``ORDER`` on, it and the bytes before it as one number."""
    x = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    out = x[: len(x) - ORDER].copy()
    for i in range(1, ORDER + 1):
        out <<= np.uint64(8)
        out |= x[i : len(x) - ORDER + i]
    return out


def joined(parts: list[bytes], step: int) -> Iterator[bytes]:
    """The parts joined to pieces of about ``step`` bytes; where a long part is cut, pieces share the context."""
    now, size = [], 0
    for p in parts:
        for i in range(0, max(1, len(p) - ORDER), step):
            now.append(p[i : i + step + ORDER])
            size += len(now[-1])
            if size >= step:
                yield b"".join(now)
                now, size = [], 0
    if size:
        yield b"".join(now)


def path_counts(rows: DataFrame) -> DataFrame:
    """(lang, path, n): how often each run of ``ORDER`` + 1 bytes occurs, counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for b in slices(batches):
            texts: dict[int, list[bytes]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.large_binary()), strict=True):
                texts.setdefault(lang, []).append(PAD + text.as_py())
            for lang, some in texts.items():
                for part in joined(some, COUNTED):
                    codes, n = np.unique(codes_of(part), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), lang, np.int32)), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "path", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang int, path bigint, n bigint").groupBy("lang", "path").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, *, per_lang: int = 2_000, cells: int = 1 << 27) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) with neither text nor lang null.

    Bound: about ``per_lang`` texts of each language and ``cells`` / languages^2 bytes of it,
    drawn by a hash of the id, longer texts left out; so paths x languages, which the model has a number for,
    are ``cells`` at each depth at most, whatever the number of languages and the length of
    texts. Of what is drawn every byte and every context counts.
    """
    rows = docs.where("text is not null and lang is not null")
    sizes = {r.lang: r for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], [], [])
    room = max(1, cells // len(langs) ** 2)
    share = docs.sparkSession.createDataFrame([(x, i, min(1.0, per_lang / sizes[x].n, room / max(1, sizes[x].size))) for i, x in enumerate(langs)], "of string, number int, share double")
    drawn = rows.select("doc_id", "text", "lang").where(F.octet_length("text") <= room).join(share, F.col("lang") == F.col("of")).where(unit_interval("lang", F.col("doc_id")) < F.col("share"))
    counts = materialize(path_counts(drawn.select(F.col("number").alias("lang"), "text")))
    found = counts.toArrow()
    release(counts)
    return build(langs, found.column("lang").to_numpy(), found.column("path").to_numpy().astype(np.uint64), found.column("n").to_numpy().astype(np.float64))


def build(langs: list[str], lang: np.ndarray, path: np.ndarray, n: np.ndarray) -> Model:
    """The tree of code lengths from counts of the longest paths."""
    paths, escapes = [], []
    shorter: tuple[np.ndarray, np.ndarray] | None = None  # paths of the depth above, sorted, and their bits
    own_shorter: list[tuple[np.ndarray, np.ndarray]] = []  # of each language its own paths there, and their probabilities
    for depth in range(ORDER + 1):
        kept = path & np.uint64((1 << (8 * (depth + 1))) - 1)
        every = np.unique(kept)
        contexts = np.unique(every >> np.uint64(8))
        bits = np.full((len(every), len(langs)), 8.0)
        if shorter is not None:
            bits = shorter[1][np.searchsorted(shorter[0], every & np.uint64((1 << (8 * depth)) - 1))]
        leave, own = np.zeros((len(contexts), len(langs))), []
        for k in range(len(langs)):
            mine, back = np.unique(kept[lang == k], return_inverse=True)
            c = np.bincount(back, weights=n[lang == k], minlength=len(mine))
            context, of = np.unique(mine >> np.uint64(8), return_inverse=True)
            total, distinct = np.bincount(of, weights=c), np.bincount(of).astype(float)
            if depth:
                lower = own_shorter[k][1][np.searchsorted(own_shorter[k][0], mine & np.uint64((1 << (8 * depth)) - 1))]
            else:
                lower = np.full(len(mine), 1 / 256)
            free = 1 - np.bincount(of, weights=lower, minlength=len(context))
            closed = (distinct >= 256) | (free <= 1e-12)  # nothing is left to escape to
            p = c / np.where(closed, total, total + distinct)[of] if len(mine) else c
            with np.errstate(divide="ignore", invalid="ignore"):
                away = -np.log2(distinct / (total + distinct) / free)
            own.append((mine, p))
            leave[np.searchsorted(contexts, context), k] = np.where(closed, 60.0, away)
        bits = bits + leave[np.searchsorted(contexts, every >> np.uint64(8))]
        for k, (mine, p) in enumerate(own):
            bits[np.searchsorted(every, mine), k] = -np.log2(p)
        paths.append(Rows(every, bits.astype(np.float32)))
        escapes.append(Rows(contexts, leave.astype(np.float32)))
        shorter, own_shorter = (every, bits), own
    return Model(langs, paths, escapes)


def bits_of(model: Model, codes: np.ndarray) -> np.ndarray:
    """Bits of every path's last byte in every language."""
    row = model.paths[ORDER].find(codes)
    out = model.paths[ORDER].values[row]
    left = np.flatnonzero(row < 0)
    out[left] = 0
    for depth in range(ORDER, -1, -1):  # the paths that no language has seen so far
        if not len(left):
            break
        here = codes[left] & np.uint64((1 << (8 * (depth + 1))) - 1)
        if depth < ORDER:
            row = model.paths[depth].find(here)
            known = row >= 0
            out[left[known]] += model.paths[depth].values[row[known]]
            left, here = left[~known], here[~known]
        context = model.escapes[depth].find(here >> np.uint64(8))
        out[left[context >= 0]] += model.escapes[depth].values[context[context >= 0]]
    out[left] += 8
    return out


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of every text in every language."""
    out = np.zeros((len(texts), len(model.langs)))
    parts, owner, size = [], [], 0

    def score() -> None:
        bits = bits_of(model, codes_of(b"".join(parts)))
        lengths = np.array([len(p) for p in parts])
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        ends = starts + lengths - ORDER  # what follows is the next part's context
        sums = np.add.reduceat(np.r_[bits, np.zeros((1, bits.shape[1]), np.float32)], np.c_[starts, ends].ravel(), axis=0, dtype=np.float64)[::2]
        np.add.at(out, owner, sums)

    for i, text in enumerate(texts):
        for j in range(0, len(text), STEP):
            parts.append((text[max(0, j - ORDER) : j] if j else PAD) + text[j : j + STEP])
            owner.append(i)
            size += len(parts[-1])
            if size >= STEP:
                score()
                parts, owner, size = [], [], 0
    if parts:
        score()
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text).

    The language of the shortest code, the first by name where codes are equal; score
    is its probability if all languages were equally likely before. Null texts, texts
    without a letter, and all texts where nothing was learned: ``und`` with score 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the paths of a bounded number of texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        m = sent.value
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            lettered = [t is not None and bool(m.langs) and LETTER.search(t) is not None for t in texts]
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            at = [i for i, x in enumerate(lettered) if x]
            if at:
                bits = code_lengths(m, [texts[i].encode() for i in at])
                best = bits.argmin(axis=1)
                sure = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                for i, k, s in zip(at, best.tolist(), sure.tolist(), strict=True):
                    pred[i], score[i] = m.langs[k], s
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(pred), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held, "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """Learn from the documents that are not held out and predict the language of all.

    Returns doc_id, held_out, lang_pred and score per row of ``docs`` (doc_id, text,
    lang). lang is read in learning alone; rows with a null id, text or lang are not
    learned from. Repeated rows are predicted alike; other columns are ignored.
    """
    model = learn(docs.where(fold(F.col("doc_id")) != 0), **bounds)
    return predict(docs, model)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``documents``; learned from rows that are not held out.

    Null texts and texts without a letter are ``und``; texts of any length are read whole;
    repeated rows are predicted alike; with nothing to learn all are ``und``; an empty table
    gives no rows.
    """
    return identify(table(spark, sf_dir, "documents"))
