"""Repeated runs of lines, by a suffix array over line ids.

The corpus is one sequence of line ids, cut between documents. Prefix doubling names
its suffixes by their first 1, 2, 4, ... lines: from the names of length L, those of
length 2 L are the pairs (name here, name L lines on). Only suffixes whose prefix occurs
elsewhere go on to the next round, until none is left.

Suffixes that share their first n lines are an interval of the suffix array. Two names of
the largest power of two within n, at the first line and so that the last line is met,
identify it, and its earliest member is the copy that stays. A run counts from
``min_words`` words. Every line of such a run lies in a run of just enough lines to reach
``min_words`` forward or backward, so the intervals of those are looked up. Where such a run
does not go on one that stands a line before, it opens a maximal run, whose length is the
longest common prefix with the earliest copy: from the longest names down, both suffixes
move on by 2^k lines while their names agree. Later copies of maximal runs are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_kept, materialize, release, slices, table, unused

LINES = "last int, doc bigint, twin bigint, i int, a bigint, b bigint, fore int, back int"
#: A document: whether its id is null (such come last), the id (0 if null), the text's hash.
DOC = ["last", "doc", "twin"]
#: Place in the corpus: documents by id (null last), then by text hash, then by line.
PLACE = "struct(last, doc, twin, i)"


def enough(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines from each line on, and back from it, to reach ``least`` words (0: not reached)."""
    total = np.r_[0, np.cumsum(words)]
    end = np.searchsorted(total, total[:-1] + least, side="left")
    fore = np.where(end < len(total), end - np.arange(len(words)), 0)
    start = np.searchsorted(total, total[1:] - least, side="right") - 1
    return fore, np.where(total[1:] >= least, np.arange(len(words)) - start + 1, 0)


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """One row per line with a word: document, number among such lines, its 128-bit id, needed lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in slices(batches):
            out: list[list[np.ndarray]] = [[] for _ in range(8)]
            for doc, twin, value in zip(batch.column("doc_id").to_pylist(), batch.column("twin").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                found = [(line, n) for line in (value.as_py() or b"").split(b"\n") if (n := len(line.split()))]
                if not found:
                    continue
                fore, back = enough(np.array([n for _, n in found]), min_words)
                ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(line) for line, _ in found), dtype=">i8").reshape(-1, 2).astype(np.int64)
                k = len(found)
                for column, values in zip(out, (np.full(k, doc is None), np.full(k, doc or 0), np.full(k, twin), np.arange(k), ids[:, 0], ids[:, 1], fore, back), strict=True):
                    column.append(values)
            names, kinds = zip(*(x.split() for x in LINES.split(", ")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *c]).astype(np.int64 if k == "bigint" else np.int32)) for c, k in zip(out, kinds, strict=True)], list(names))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("twin"), "text").mapInArrow(run, LINES)


def repeated(suffixes: DataFrame, *keys: str) -> DataFrame:
    """``suffixes`` whose keys occur at more than one place, with a name r of the keys.

    Names rise with the keys over range partitions, so that no task sees all of them;
    places are counted before the shuffle, and frequent keys meet their name in a join
    that the adaptive planner splits.
    """
    names = suffixes.groupBy(*keys).agg(F.min(F.expr(PLACE)).alias("low"), F.max(F.expr(PLACE)).alias("high")).where("low < high").select(*keys)
    names = materialize(names.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("named", F.monotonically_increasing_id()))
    return suffixes.join(names, list(keys)).drop(*keys).withColumnRenamed("named", "r")


def doubled(lines: DataFrame) -> list[DataFrame]:
    """By k, the suffixes (DOC, i) whose first 2^k lines occur elsewhere, with a name r of these lines."""
    levels = [materialize(repeated(lines.select(*DOC, "i", "a", "b"), "a", "b").dropDuplicates([*DOC, "i"]))]
    while not levels[-1].isEmpty():
        half = 1 << (len(levels) - 1)
        after = levels[-1].select(*DOC, (F.col("i") - half).alias("i"), F.col("r").alias("s"))
        levels.append(materialize(repeated(levels[-1].join(after, [*DOC, "i"]), "r", "s")))
    return levels[:-1]


RUN = [*DOC, "i", "n", "first"]


def copies(lines: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Runs of just enough lines (DOC, i, n) that stand earlier too, and the place where they first stand. Written."""
    starts = lines.where("fore > 0").select(*DOC, "i", F.col("fore").alias("n")).unionByName(lines.where("back > 0").select(*DOC, (F.col("i") - F.col("back") + 1).alias("i"), F.col("back").alias("n")))
    # what does not repeat in its first line needs no more rounds
    starts = materialize(starts.join(levels[0].select(*DOC, "i"), [*DOC, "i"], "left_semi").dropDuplicates([*DOC, "i", "n"]))
    longest, found = starts.agg(F.max("n")).first()[0] or 0, []
    for k, level in enumerate(levels):
        if 1 << k > longest:
            break
        here = starts.where((F.col("n") >= 1 << k) & (F.col("n") < 2 << k))
        second = level.select(*DOC, F.col("i").alias("j"), F.col("r").alias("s"))
        both = materialize(here.join(level, [*DOC, "i"]).withColumn("j", F.col("i") + F.col("n") - (1 << k)).join(second, [*DOC, "j"]).drop("j"))
        first = materialize(both.groupBy("n", "r", "s").agg(F.min(F.expr(PLACE)).alias("first")))  # so that the join below can be split at a frequent run
        found.append(materialize(both.join(first, ["n", "r", "s"]).where(F.expr(f"first < {PLACE}")).select(*RUN)))
        release(both, first)
    release(starts)
    if not found:  # lines repeat, but no run of them has enough words
        return lines.limit(0).select(*DOC, "i", F.col("i").alias("n"), F.expr(PLACE).alias("first"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def common_prefixes(runs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``runs`` made as long as the longest common prefix of the suffixes at DOC, i and at first. Written."""
    there = ["first_last", "first_doc", "first_twin"]
    now = runs.select(*DOC, "i", "n", *[F.col(f"first.{c}").alias(t) for c, t in zip(DOC, there, strict=True)], F.col("first.i").alias("first_i"))
    for k in reversed(range(len(levels))):
        names = levels[k].select(*DOC, F.col("i").alias("j"), F.col("r").alias("s"))
        at_first = levels[k].select(*[F.col(c).alias(t) for c, t in zip(DOC, there, strict=True)], F.col("i").alias("first_j"), F.col("r").alias("t"))
        moved = now.withColumns({"j": F.col("i") + F.col("n"), "first_j": F.col("first_i") + F.col("n")})
        moved = moved.join(names, [*DOC, "j"], "left").join(at_first, [*there, "first_j"], "left")
        then = materialize(moved.withColumn("n", F.col("n") + F.when(F.col("s") == F.col("t"), 1 << k).otherwise(0)).select(*now.columns))
        if k + 1 < len(levels):
            release(now)
        now = then
    return now.select(*DOC, "i", "n", F.struct(*[F.col(t).alias(c) for c, t in zip(DOC, there, strict=True)], F.col("first_i").alias("i")).alias("first"))


def maximal_runs(docs: DataFrame, *, min_words: int = 10) -> DataFrame:
    """Maximal repeated runs of ``min_words`` words or more, where they are not the first: last, doc, twin, i, n lines, and the place ``first`` of the earliest copy.

    The run agrees with that copy in n lines and in no more; a run that goes on another
    one a line earlier, at the same distance from its copy, is part of it and is not listed.
    Written.
    """
    lines = materialize(line_table(docs, min_words))
    levels = doubled(lines)
    if not levels:
        return lines.limit(0).select(*DOC, "i", F.col("i").alias("n"), F.expr(PLACE).alias("first"))
    found = copies(lines, levels).groupBy(*DOC, "i", "first").agg(F.min("n").alias("n"))
    found = materialize(found)
    same = F.struct(*[F.col(f"first.{c}").alias(c) for c in DOC], (F.col("first.i") + 1).alias("i"))
    goes_on = found.select(*DOC, (F.col("i") + 1).alias("i"), same.alias("first"))
    out = common_prefixes(found.join(goes_on, [*DOC, "i", "first"], "left_anti"), levels)
    release(lines, *levels)
    return out


def deleted_lines(docs: DataFrame, *, min_words: int = 10) -> DataFrame:
    """DOC and the sorted numbers (among lines with a word) of the lines to delete."""
    covered = maximal_runs(docs, min_words=min_words).groupBy(*DOC, "i").agg(F.max("n").alias("n"))
    # runs of one document may overlap: only what a run adds to those before it is spelled out
    covered = covered.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("i", (F.col("i") + F.col("n")).alias("end")))).alias("runs"))
    begin = F.struct(F.lit(0).alias("to"), F.array().cast("array<int>").alias("gone"))
    add = lambda s, x: F.when(x["end"] <= s["to"], s).otherwise(F.struct(x["end"].alias("to"), F.concat(s["gone"], F.sequence(F.greatest(x["i"], s["to"]), x["end"] - 1)).alias("gone")))
    return covered.select(*DOC, F.aggregate("runs", begin, add, lambda s: s["gone"]).alias("gone"))


def without(text: bytes, gone: set[int]) -> tuple[bytes, int, int]:
    """The text without the given lines; how many lines with a word it had, and how many of them are left."""
    out, k = [], 0
    for line in text.split(b"\n"):
        if line.split():
            if k not in gone:
                out.append(line)
            k += 1
        else:
            out.append(line)
    return b"\n".join(out), k, k - len(gone)


def deduplicated(docs: DataFrame, *, min_words: int = 10, lines_as: str = "lines", left_as: str = "kept_lines") -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) without later copies of repeated runs of lines, and in two more columns the numbers of lines with a word before and after.

    A run is a sequence of whole lines within one document with ``min_words`` words or
    more in all; lines without a word are no part of it and stay. The copy that comes
    first, by id and then by line, stays, even where copies overlap. Null texts stay
    null. Null ids come last. Rows that repeat id and text are one document and are cut
    alike; rows that repeat an id with another text are documents of their own. Other
    columns pass through; the new columns get an underscore at the end where ``docs`` has
    their names.
    """
    last, doc, twin, gone_, lines_, left_ = unused(docs, "is_last", "of_doc", "of_twin", "gone", lines_as, left_as)
    g = deleted_lines(docs, min_words=min_words).toDF(last, doc, twin, gone_)
    own = docs["doc_id"].cast("bigint")
    same = (own.isNull().cast("int") == g[last]) & (F.coalesce(own, F.lit(0)) == g[doc]) & (F.xxhash64(docs["text"]) == g[twin])
    joined = docs.join(g, same, "left").drop(last, doc, twin)

    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for b in slices(batches):
            texts, lines, left = [], [], []
            for t, gone in zip(b.column("text").cast(pa.large_binary()), b.column(gone_).to_pylist(), strict=True):
                text, n, kept = without(t.as_py() or b"", set(gone or ()))
                texts.append(text if t.is_valid else None)
                lines.append(n)
                left.append(kept)
            columns = {n: b.column(n) for n in names} | {"text": pa.array(texts, pa.binary()).cast(pa.string()), lines_: pa.array(lines, pa.int32()), left_: pa.array(left, pa.int32())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return joined.mapInArrow(cut, T.StructType([*docs.schema.fields, T.StructField(lines_, T.IntegerType()), T.StructField(left_, T.IntegerType())]))


def kept_documents(docs: DataFrame, *, min_words: int = 10) -> DataFrame:
    """``deduplicated`` with n_chars, where there is such a column, set anew, without the documents of which no line is left.

    Texts that had no line with a word, null ones among them, stay.
    """
    lines, left = unused(docs, "lines", "kept_lines")
    cut = deduplicated(docs, min_words=min_words, lines_as=lines, left_as=left).where((F.col(left) > 0) | (F.col(lines) == 0))
    kinds = dict(docs.dtypes)
    if "n_chars" in kinds:
        cut = cut.withColumn("n_chars", F.length("text").cast(kinds["n_chars"]))
    return cut.select(*docs.columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the lines (with a word) it had and has, and length and hash of the text that is left.

    Null texts stay null; null and repeated ids, repeated rows, very long texts and an empty
    table: see ``deduplicated``. Columns other than doc_id and text are not read.
    """
    cut = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "lines", "kept_lines", F.length("text").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
