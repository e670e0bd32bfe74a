"""Phrase collocations by sorting packed n-grams.

Words that occur often enough get an id in a dictionary; every other word breaks a piece
of text, since no phrase that holds it can be frequent. A position of the text becomes a
key of 128 bits, the ids of the word there and of the next three, zeros after the end of
the piece. Tasks sort blocks of keys by radix and count equal ones, cut the sorted blocks
at the bounds of ranges, and pack what falls into each range. A task per range sorts again
and counts runs: keys that share their first 64, 96 or 128 bits are the occurrences of one
phrase of two, three or four words. A phrase that a bound cuts is put together afterwards.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_kept, keep, materialize, release, slices, table

#: Distinct words that a task counts before it passes them on; positions of a block that is sorted at once.
FLUSH, BLOCK = 200_000, 1 << 19
#: Marks the end of a piece; cannot be part of a word.
BREAK = b"."
#: Lower case of A-Z, and one mark for all that ends a piece.
FOLDED = bytes(ord(BREAK) if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens_of(text: bytes) -> list[bytes]:
    """The words of a text in lower case, and a mark wherever a piece ends."""
    return text.translate(FOLDED).replace(BREAK, b" . ").split()


def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Each language of the batch with the tokens of all its texts, a mark after every text."""
    texts = defaultdict(list)
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
        texts[lang].append(text.as_py() or b"")
    for lang, found in texts.items():
        yield lang, tokens_of(BREAK.join([*found, b""]))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        counts: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items() if w != BREAK]
            counts.clear()
            lang, word, n = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

        for b in slices(batches):
            for lang, tokens in by_lang(b):
                counts[lang].update(tokens)
            if sum(map(len, counts.values())) > FLUSH:
                yield out()
        yield out()

    return docs.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("f"))


def numbered(words: DataFrame) -> DataFrame:
    """``words`` with ids from 1 on, the most frequent first, each partition after the one before. Written."""
    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("f"), "lang", "word"]
    place = F.monotonically_increasing_id()  # the partition above bit 33, the place in it below
    placed = materialize(words.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"part": F.shiftright(place, 33), "place": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = {r.part: r.n for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per partition
    begins, total = [], 1
    for p in sorted(sizes):
        begins.append((p, total))
        total += sizes[p]
    if total > 1 << 31:
        raise ValueError("more frequent words than ids of 31 bits")
    begin = spark.createDataFrame(begins, "part bigint, begin bigint")
    out = materialize(placed.join(F.broadcast(begin), "part").select("lang", "word", "f", (F.col("begin") + F.col("place")).alias("id")))
    release(placed)
    return out


def radix_order(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The order of 128-bit keys, by stable counting sorts of their 16-bit digits from the lowest; digits that are all alike are skipped."""
    order = None
    for column in (lo, hi):
        for shift in (0, 16, 32, 48):
            digit = (column >> shift).astype(np.uint16)
            if len(digit) and digit.min() < digit.max():
                order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(hi)) if order is None else order


def summed(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts: sorted by radix, runs added up."""
    order = radix_order(hi, lo)
    hi, lo, n = hi[order], lo[order], n[order]
    first = np.flatnonzero(np.r_[len(hi) > 0, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])][: len(hi)])
    return hi[first], lo[first], np.add.reduceat(n, first) if len(first) else n[:0]


def keys_at(ids: np.ndarray, upto: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the positions (before ``upto``) of a sequence of ids, 0 where it breaks, at which two words or more follow each other."""
    a, b, c, d = (np.r_[ids[k:], np.zeros(min(k, len(ids)), np.int64)] for k in range(4))
    c = np.where(b > 0, c, 0)
    d = np.where(c > 0, d, 0)
    at = (a > 0) & (b > 0)
    at[len(ids) if upto is None else upto :] = False
    return (a << 32 | b)[at], (c << 32 | d)[at]


def packed(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys and their counts in bytes: differences of the upper halves, byte planes, compressed."""
    planes = [np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T) for x in (np.diff(hi, prepend=0), lo, n)]
    raw = np.stack(planes).tobytes()
    return len(hi).to_bytes(4, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    raw = pa.Codec("zstd").decompress(data[4:], decompressed_size=24 * n, asbytes=True)
    hi, lo, count = (np.ascontiguousarray(x.T).view("<i8").ravel() for x in np.frombuffer(raw, np.uint8).reshape(3, 8, n))
    return np.cumsum(hi), lo, count


Keys = tuple[np.ndarray, np.ndarray]


def key_blocks(keys: Iterator[Keys], block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys in sorted blocks of about ``block`` positions, each distinct key once with its count."""
    held: list[Keys] = []
    size = 0
    for k in keys:
        held.append(k)
        size += len(k[0])
        if size >= block:
            hi, lo = (np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
            yield summed(hi, lo, np.ones(len(hi), np.int64))
    if held:
        hi, lo = (np.concatenate(x) for x in zip(*held, strict=True))
        yield summed(hi, lo, np.ones(len(hi), np.int64))


def in_ranges(keys: Iterator[Keys], bounds: list[tuple[int, int]], block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of keys cut at the bounds of ranges: (range, packed keys)."""
    b_hi, b_lo = np.array([b[0] for b in bounds], np.int64), np.array([b[1] for b in bounds], np.int64)
    for hi, lo, n in key_blocks(keys, block):
        low, high = np.searchsorted(hi, b_hi, "left"), np.searchsorted(hi, b_hi, "right")
        cuts = np.array([s + np.searchsorted(lo[s:e], x, "left") for s, e, x in zip(low.tolist(), high.tolist(), b_lo.tolist(), strict=True)], np.int64)
        edges = np.r_[0, cuts, len(hi)]
        filled = np.flatnonzero(edges[1:] > edges[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array([packed(*(x[edges[i] : edges[i + 1]] for x in (hi, lo, n))) for i in filled.tolist()], pa.binary())], ["range", "packed"])


def phrases_in(parts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases (as keys) of one range with their counts: those with ``least`` or more, and those that may go on in another range."""
    hi, lo, n = summed(*(np.concatenate(x) for x in zip(*map(unpacked, parts), strict=True)))
    out = []
    for mask, here in ((0, hi > 0), (-1 << 32, lo > 0), (-1, lo & 0xFFFFFFFF > 0)):
        h, low, c = hi[here], lo[here] & mask, n[here]
        if not len(h):
            continue
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (low[1:] != low[:-1])])
        c = np.add.reduceat(c, first)
        keep_it = c >= least
        keep_it[[0, -1]] = True
        out.append((h[first][keep_it], low[first][keep_it], c[keep_it]))
    hi, lo, n = (np.concatenate(x) for x in zip(*out, strict=True))
    return hi, lo, n


class Dictionary(dict):
    """word -> id, 0 for any other."""

    def __missing__(self, word: bytes) -> int:
        return 0


def sent_encoder(words: DataFrame) -> Callable[[DataFrame, Callable[[Iterator[Keys]], Iterator[pa.RecordBatch]], str], DataFrame]:
    """Applies a function of keys to a table of texts; every task has the whole dictionary, whose size the caller has checked."""
    found = words.select("lang", "word", "id").toArrow()
    sent, name = words.sparkSession.sparkContext.broadcast(found), uuid.uuid4().hex

    def dictionaries() -> dict[str, Dictionary]:
        out: dict[str, Dictionary] = defaultdict(Dictionary)
        t = sent.value
        for lang, word, i in zip(t.column("lang").to_pylist(), t.column("word").cast(pa.binary()).to_pylist(), t.column("id").to_pylist(), strict=True):
            out[lang][word] = i
        return out

    def encode(docs: DataFrame, work, schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = keep(("collocations", name), dictionaries)
            keys = (keys_at(np.fromiter(map(known[lang].__getitem__, tokens), np.int64, len(tokens))) for b in slices(batches) for lang, tokens in by_lang(b) if lang in known)
            return work(keys)

        return docs.mapInArrow(run, schema)

    return encode


def joined_encoder(words: DataFrame) -> Callable[[DataFrame, Callable[[Iterator[Keys]], Iterator[pa.RecordBatch]], str], DataFrame]:
    """The same for a dictionary of any size: words of texts meet their ids in a join, which the adaptive planner splits at frequent words."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for b in slices(batches):
            for row, lang, text in zip(b.column("row").to_pylist(), b.column("lang").to_pylist(), b.column("text").cast(pa.large_binary()), strict=True):
                tokens = tokens_of(text.as_py() or b"")
                for i in range(0, len(tokens), FLUSH):
                    at = [(t, k) for k, t in enumerate(tokens[i : i + FLUSH], i) if t != BREAK]
                    word, place = zip(*at, strict=True) if at else ((), ())
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(at), pa.int64()), pa.array(place, pa.int64()), pa.array([lang] * len(at), pa.string()), pa.array(word, pa.binary()).cast(pa.string())], ["row", "place", "lang", "word"])

    def encode(docs: DataFrame, work, schema: str) -> DataFrame:
        rows = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(places, "row bigint, place bigint, lang string, word string")
        found = rows.join(words.select("lang", "word", "id"), ["lang", "word"]).select("row", "place", "id")

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[Keys]:
            left = np.zeros((0, 3), np.int64)  # the last three words: their keys may need what comes next
            for b in batches:
                now = np.concatenate([left, np.stack([b.column(c).to_numpy() for c in ("row", "place", "id")], axis=1)])
                gaps = np.flatnonzero((now[1:, 0] != now[:-1, 0]) | (now[1:, 1] != now[:-1, 1] + 1)) + 1
                held = max(0, len(now) - 3)
                left = now[held:]
                yield keys_at(np.insert(now[:, 2], gaps, 0), held + int(np.searchsorted(gaps, held, "right")))
            gaps = np.flatnonzero((left[1:, 0] != left[:-1, 0]) | (left[1:, 1] != left[:-1, 1] + 1)) + 1
            yield keys_at(np.insert(left[:, 2], gaps, 0))

        return found.repartition("row").sortWithinPartitions("row", "place").mapInArrow(lambda batches: work(keys(batches)), schema)

    return encode


def bounds_of(docs: DataFrame, encode, total: int, ranges: int) -> list[tuple[int, int]]:
    """Keys that cut all keys into about even ranges, from a sample of texts; they decide where work is done, never what is counted."""
    if ranges < 2:
        return []
    wanted = 200 * ranges

    def some(keys: Iterator[Keys]) -> Iterator[pa.RecordBatch]:
        every = 0.02
        for k, (hi, lo) in enumerate(keys):
            here = np.random.default_rng(k).random(len(hi)) < every
            yield pa.RecordBatch.from_arrays([pa.array(hi[here]), pa.array(lo[here])], ["hi", "lo"])

    texts = docs.sample(min(1.0, 50 * wanted / max(1, total)), 7)
    found = encode(texts, some, "hi bigint, lo bigint").distinct().orderBy("hi", "lo").toArrow()  # about ``wanted`` keys
    step = [len(found) * k // ranges for k in range(1, ranges)]
    hi, lo = found.column("hi").to_pylist(), found.column("lo").to_pylist()
    return sorted({(hi[i], lo[i]) for i in step}) if len(found) else []


def phrase_counts(docs: DataFrame, words: DataFrame, total: int, *, least: int, most_words: int, per_range: int, block: int) -> DataFrame:
    """hi, lo and a of every phrase of two to four words that occurs ``least`` times or more. ``total`` words, of which ``words`` are frequent."""
    size = words.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("word") + F.octet_length("lang")), F.lit(0)).alias("bytes")).first()
    encode = (sent_encoder if size.n <= most_words and size.bytes <= 16 * most_words else joined_encoder)(words)
    bounds = bounds_of(docs, encode, total, max(1, -(-total // per_range)))
    dealt = encode(docs, lambda keys: in_ranges(keys, bounds, block), "range int, packed binary")

    def solve(t: pa.Table) -> pa.Table:
        hi, lo, n = phrases_in(t.column("packed").to_pylist(), least)
        return pa.table({"hi": pa.array(hi), "lo": pa.array(lo), "a": pa.array(n)})

    found = dealt.groupBy("range").applyInArrow(solve, "hi bigint, lo bigint, a bigint")
    return materialize(found.groupBy("hi", "lo").agg(F.sum("a").alias("a")).where(F.col("a") >= least))


def part(first: int, last: int) -> tuple[Column, Column]:
    """The key of the words ``first`` to ``last`` (from 0) of the phrase with the key hi, lo."""
    word = [F.shiftrightunsigned("hi", 32), F.col("hi").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("lo", 32), F.col("lo").bitwiseAND(F.lit(0xFFFFFFFF))]
    take = [word[i] if i <= last else F.lit(0).cast("bigint") for i in range(first, first + 4)]
    return F.shiftleft(take[0], 32).bitwiseOR(take[1]), F.shiftleft(take[2], 32).bitwiseOR(take[3])


def by_size(rows: dict[int, list[Column]]) -> Column:
    """One of several lists, by the number of words."""
    out = F.array(*rows[2])
    return F.when(F.col("size") == 4, F.array(*rows[4])).when(F.col("size") == 3, F.array(*rows[3])).otherwise(out)


def scored(phrases: DataFrame, words: DataFrame, factor: int) -> DataFrame:
    """lang, l, r and score of the lowest-scoring cut of each phrase (hi, lo, a, size).

    Parts of a frequent phrase are frequent themselves, so every one is found in one join.
    """
    known = phrases.select(F.col("hi").alias("p_hi"), F.col("lo").alias("p_lo"), F.col("a").alias("f"), F.lit(None).cast("string").alias("lang"))
    known = known.unionByName(words.select(F.shiftleft("id", 32).alias("p_hi"), F.lit(0).cast("bigint").alias("p_lo"), "f", "lang"))
    piece = lambda k, side, first, last: F.struct(F.lit(2 * k + side).alias("slot"), *(c.alias(n) for c, n in zip(part(first, last), ("p_hi", "p_lo"), strict=True)))
    cuts = {n: [piece(k, side, *((0, k - 1) if not side else (k, n - 1))) for k in range(1, n) for side in (0, 1)] for n in (2, 3, 4)}
    parts = phrases.select("hi", "lo", "a", F.inline(by_size(cuts))).join(known, ["p_hi", "p_lo"])
    slots = parts.groupBy("hi", "lo", "a").agg(F.max(F.when(F.col("slot") == 2, F.col("lang"))).alias("lang"), *[F.max(F.when(F.col("slot") == s, F.col("f"))).alias(f"f{s}") for s in range(2, 8)])
    cut = lambda k: F.when(F.col(f"f{2 * k}").isNotNull(), F.struct(F.expr(f"cast({factor} as decimal(38,0)) * a div (cast(f{2 * k} as decimal(38,0)) + f{2 * k + 1})").alias("score"), F.lit(k).alias("k"), F.col(f"f{2 * k}").alias("l"), F.col(f"f{2 * k + 1}").alias("r")))
    return slots.withColumn("cut", F.array_min(F.filter(F.array(cut(1), cut(2), cut(3)), lambda x: x.isNotNull()))).select("hi", "lo", "a", "lang", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, *, least: int = 30, top: int = 2000, inside: int = 80, factor: int = 2_000_000, most_words: int = 1_000_000, per_range: int = 1 << 20, block: int = BLOCK) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z only and cut into pieces at ``.,;:!?`` and at line ends,
    pieces into words at spaces and tabs. A phrase is two to four words that follow each
    other in a piece and occur ``least`` times or more in their language, overlaps counted.
    Its score is floor(factor * a / (l + r)) at the cut where that is lowest (ties: the
    first), l and r being the counts of both parts. Phrases that lie in a longer one with at
    least ``inside`` per cent of their count are left out. Ties go to the larger count, then
    to the smaller phrase in bytes. n is the number of words of the language.

    Null and empty texts have no words; a null language is ``und``; repeated rows count each;
    texts of any length are read whole; other columns, whatever their names, are not read;
    an empty table gives no rows. Every frequent word and phrase is counted exactly: up to
    ``most_words`` words (and 16 bytes for each) are sent to all tasks, more are joined.
    ``per_range`` keys on average are counted in one task.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counts = materialize(word_counts(texts))
    sizes = materialize(counts.groupBy("lang").agg(F.sum("f").alias("n")))
    words = numbered(counts.where(F.col("f") >= least))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    phrases = phrase_counts(texts, words, total, least=least, most_words=most_words, per_range=per_range, block=block)
    size = F.when(F.col("lo") == 0, 2).when(F.col("lo").bitwiseAND(F.lit(0xFFFFFFFF)) == 0, 3).otherwise(4)
    phrases = phrases.withColumn("size", size)
    within = lambda n: [F.struct(*(c.alias(x) for c, x in zip(part(i, i + m - 1), ("hi", "lo"), strict=True))) for m in range(2, n) for i in range(n - m + 1)]
    longer = phrases.where("size > 2").select(F.col("a").alias("longer"), F.inline(F.when(F.col("size") == 4, F.array(*within(4))).otherwise(F.array(*within(3))))).groupBy("hi", "lo").agg(F.max("longer").alias("longer"))
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    own = phrases.join(longer, ["hi", "lo"], "left").where(F.col("longer").isNull() | (whole("longer") * 100 < whole("a") * inside)).select("hi", "lo")
    ranked = scored(phrases, words, factor).join(own, ["hi", "lo"])
    # before words are looked up and a language comes to one task: the best of sixteen shares, ties included
    share = W.partitionBy("lang", F.pmod(F.xxhash64("hi", "lo"), F.lit(16))).orderBy(F.desc("score"), F.desc("a"))
    best = materialize(ranked.withColumn("place", F.rank().over(share)).where(F.col("place") <= top).drop("place"))
    ids = [F.shiftrightunsigned("hi", 32), F.col("hi").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("lo", 32), F.col("lo").bitwiseAND(F.lit(0xFFFFFFFF))]
    spelled = best.select("hi", "lo", F.posexplode(F.array(*ids)).alias("i", "id")).where("id > 0").join(words.select("id", "word"), "id")
    spelled = spelled.groupBy("hi", "lo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    first = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = best.join(spelled, ["hi", "lo"]).withColumn("rank", F.row_number().over(first).cast("bigint")).where(F.col("rank") <= top)
    release(counts)
    return out.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of ``documents``: phrases of two to four words that occur 30 times or more.

    Nulls, empty and very long texts, ties, repeated rows, an empty table and other columns: see ``collocations``.
    """
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS w FROM pieces),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p
  FROM w, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, array_to_string(p, ' ') AS p, any_value(p) AS w, count(*) AS f FROM g GROUP BY lang, k, array_to_string(p, ' ')),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
known AS MATERIALIZED (SELECT * FROM f WHERE f >= 30),
c AS MATERIALIZED (SELECT * FROM known WHERE k > 1),
cut_at AS MATERIALIZED (
  SELECT lang, p, f AS a, cut, array_to_string(w[1:cut], ' ') AS l_p, array_to_string(w[cut + 1:k], ' ') AS r_p
  FROM c, (VALUES (1), (2), (3)) AS places(cut) WHERE cut < k),
cuts AS (
  SELECT t.lang, t.p, a, cut, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score
  FROM cut_at t JOIN known l ON l.lang = t.lang AND l.p = t.l_p JOIN known r ON r.lang = t.lang AND r.p = t.r_p),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) AS place FROM cuts),
inner_parts AS (
  SELECT lang, f AS longer, array_to_string(unnest(CASE k WHEN 3 THEN [w[1:2], w[2:3]] ELSE [w[1:2], w[2:3], w[3:4], w[1:3], w[2:4]] END), ' ') AS p FROM c WHERE k > 2),
gone AS (SELECT c.lang, c.p FROM c JOIN inner_parts USING (lang, p) GROUP BY c.lang, c.p, c.f HAVING 100 * max(longer) >= 80 * c.f),
ranked AS (
  SELECT lang, p AS phrase, a, l, r, score FROM lowest WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.lang = lowest.lang AND gone.p = lowest.p)),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked)
SELECT lang, rank, phrase, a, l, r, n.n, score FROM placed JOIN n USING (lang) WHERE rank <= 2000
"""
