"""Toxic passages as maximum-scoring segments.

Tokens are scored by the log-odds of toxic against clean documents under a Dirichlet
prior; a token that tells nothing costs a little. A word that is too rare to be scored by
itself is scored by its longest beginning that tells something, so that inflected and
compound forms of a known stem count too. One linear scan finds all maximal
segments of a text (Ruzzo and Tompa). By extreme-value theory a clean text of n tokens
holds K n exp(-lambda S) segments of score S or more, so lambda S - ln(K n) says how
far beyond chance a segment lies. A document's evidence is the sum of these excesses,
turned into a probability by a logistic curve fitted on the documents learned from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_kept, fold, materialize, release, slices, table

TOKEN = re.compile(r"[^\W_]+")
#: Distinct keys that a task counts before it passes them on; words whose scores it remembers.
FLUSH, KNOWN = 100_000, 200_000
#: Lengths of the beginnings of words that are keys too; a star marks them.
STEMS = range(4, 10)


def keys_of(word: str) -> list[str]:
    """The word and those of its beginnings that are keys, the longest first."""
    return [word, *(word[:n] + "*" for n in reversed(STEMS) if n < len(word))]


class Scores(dict):
    """word -> its log-odds in a lexicon of keys, 0 where it has none; emptied when full."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) >= KNOWN:
            self.clear()
        found = self[word] = next((self.lexicon[k] for k in keys_of(word) if k in self.lexicon), 0.0)
        return found


@dataclass
class Model:
    lexicon: dict[str, float]
    drift: float  # of a token outside the lexicon
    lam: float
    k: float
    slope: float
    offset: float

    def evidence(self, segments: list[tuple[int, int, float]], tokens: int) -> float:
        return sum(max(0.0, self.excess(s, tokens)) for _, _, s in segments)

    def excess(self, score: float, tokens: int) -> float:
        return self.lam * score - math.log(max(self.k * tokens, 1e-12))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.offset + self.slope * evidence))))


def maximal_segments(scores: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of scored, adjoining spans (start, end, score), in linear time."""
    kept: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, start, end, the last one that began lower
    total = 0.0
    for start, end, s in scores:
        before, total = total, total + s
        if s <= 0:
            continue
        low, at = before, start
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= total:
                kept.append((low, total, at, end, j))
                break
            low, at = kept[j][0], kept[j][2]
            del kept[j:]
    return [(s, e, high - low) for low, high, s, e, _ in kept]


def segments(tokens: list[str], scores: Scores, drift: float) -> list[tuple[int, int, float]]:
    """Maximal segments of a text as token spans; runs without a score are one span."""
    scored, last = [], 0
    for i, s in [(i, s) for i, t in enumerate(tokens) if (s := scores[t])]:
        if i > last:
            scored.append((last, i, -drift * (i - last)))
        scored.append((i, i + 1, s))
        last = i + 1
    return maximal_segments(scored)


def log_odds(toxic: np.ndarray, clean: np.ndarray, totals: tuple[float, float], share: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each token and their standard error, under a Dirichlet prior of ``share`` times both classes' counts together."""
    alpha, prior = share * (toxic + clean), share * sum(totals)
    alpha = np.maximum(alpha, 1e-9)
    odds = lambda y, n: np.log((y + alpha) / np.maximum(n + prior - y - alpha, 1e-9))
    return odds(toxic, totals[0]) - odds(clean, totals[1]), np.sqrt(1 / (toxic + alpha) + 1 / (clean + alpha))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """The distinct texts, with toxic, of at most ``bound`` labelled rows of ``docs`` that are not held out, drawn by a hash of the id.

    ``check`` marks a third of them, on which scores are calibrated.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    drawn = known.where(fold(F.col("doc_id")) != 0).orderBy(F.md5(F.concat(F.lit("toxic:"), F.col("doc_id").cast("string"))), "doc_id").limit(bound)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id")
    return rows.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("check", F.pmod(F.xxhash64("text"), F.lit(3)) == 0)


COUNTS = ("clean", "toxic", "clean_check", "toxic_check")


def token_counts(rows: DataFrame) -> DataFrame:
    """In how many texts each key occurs, by class, of those to learn from and of those to calibrate on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        counts = [Counter() for _ in COUNTS]

        def out() -> pa.RecordBatch:
            names = list({**counts[0], **counts[1], **counts[2], **counts[3]})
            got = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[n] for n in names], pa.int64()) for c in counts]], ["token", *COUNTS])
            for c in counts:
                c.clear()
            return got

        for b in slices(batches):
            for text, toxic, check in zip(b.column("text"), b.column("toxic").to_pylist(), b.column("check").to_pylist(), strict=True):
                counts[(toxic == 1) + 2 * check].update({k for t in set(TOKEN.findall(text.as_py().lower())) for k in keys_of(t)})
                if sum(map(len, counts)) > FLUSH:
                    yield out()
        yield out()

    return rows.mapInArrow(run, "token string, " + ", ".join(f"{c} bigint" for c in COUNTS)).groupBy("token").agg(*[F.sum(c).alias(c) for c in COUNTS])


def contexts(rows: DataFrame) -> DataFrame:
    """Of each key, the distinct words before it in toxic texts, of those to learn from and of all.

    Families of near copies repeat a word in one context; a word that marks toxic
    texts stands in many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        found: set[tuple[str, str, bool]] = set()

        def out() -> pa.RecordBatch:
            token, before, check = zip(*found, strict=True) if found else ((), (), ())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(token, pa.string()), pa.array(before, pa.string()), pa.array(check, pa.bool_())], ["token", "before", "check"])

        for b in slices(batches):
            for text, c in zip(b.column("text"), b.column("check").to_pylist(), strict=True):
                words = TOKEN.findall(text.as_py().lower())
                for before, t in set(zip(["", *words], words, strict=False)):
                    found.update((k, before, c) for k in keys_of(t))
                    if len(found) > FLUSH:
                        yield out()
        yield out()

    pairs = rows.where("toxic = 1").mapInArrow(run, "token string, before string, check boolean")
    pairs = pairs.groupBy("token", "before").agg(F.min("check").alias("check"))
    return pairs.groupBy("token").agg(F.count(F.when(~F.col("check"), 1)).alias("seen"), F.count(F.lit(1)).alias("seen_all"))


def unevenness(toxic: Column, clean: Column, rate: float) -> Column:
    """-ln of Chernoff's bound on the probability that chance splits the occurrences as unevenly: n KL(toxic share, ``rate``)."""
    n = toxic + clean
    y = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), toxic / n))
    return F.when(n > 0, n * (y * F.log(y / rate) + (1 - y) * F.log((1 - y) / (1 - rate)))).otherwise(0.0)


def lexicon_of(tokens: list[str], clean: np.ndarray, toxic: np.ndarray, uneven: np.ndarray, totals: tuple[float, float], keys: int, share: float) -> dict[str, float]:
    """key -> log-odds, held back by one standard error, of the keys that are more uneven than chance makes any of ``keys``; half a key is let through by chance."""
    if not len(tokens) or not all(totals):
        return {}
    delta, error = log_odds(toxic, clean, totals, share)
    held = np.sign(delta) * np.maximum(0, np.abs(delta) - error)
    return {t: float(h) for t, h, u in zip(tokens, held, uneven >= math.log(keys / 0.5), strict=True) if u and h}


def lexicons(rows: DataFrame, share: float) -> tuple[dict[str, float], dict[str, float]]:
    """The lexicon of the rows to learn from, and that of all rows.

    Every key of every row is counted and tested in Spark; only keys that pass the test come to the driver.
    """
    rate = rows.agg(F.avg((F.col("toxic") == 1).cast("int"))).first()[0] or 0.0
    if not 0 < rate < 1:
        return {}, {}
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    counted = token_counts(rows).join(contexts(rows), "token", "left")
    kinds = {"apart": (F.least(F.col("toxic"), zero(F.col("seen"))), F.col("clean")), "whole": (F.least(F.col("toxic") + F.col("toxic_check"), zero(F.col("seen_all"))), F.col("clean") + F.col("clean_check"))}
    for kind, (toxic, clean) in kinds.items():
        counted = counted.withColumns({f"{kind}_toxic": toxic.cast("double"), f"{kind}_clean": clean.cast("double"), f"{kind}_uneven": unevenness(toxic, clean, rate)})
    tested = materialize(counted.select("token", *[f"{k}_{x}" for k in kinds for x in ("toxic", "clean", "uneven")]))
    word = ~F.endswith("token", F.lit("*"))
    whole = tested.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.when(word, F.col(f"{k}_{x}"))), F.lit(0.0)).alias(f"{k}_{x}") for k in kinds for x in ("toxic", "clean")]).first()
    passed = tested.where(F.greatest(*[f"{k}_uneven" for k in kinds]) >= math.log(max(1, whole.n) / 0.5)).orderBy("token").toArrow()
    release(tested)
    column = lambda name: passed.column(name).to_numpy()
    made = [lexicon_of(passed.column("token").to_pylist(), column(f"{k}_clean"), column(f"{k}_toxic"), column(f"{k}_uneven"), (whole[f"{k}_toxic"], whole[f"{k}_clean"]), whole.n, share) for k in kinds]
    return made[0], made[1]


def learn(docs: DataFrame, labels: DataFrame, *, bound: int = 20_000, share: float = 0.1, drift: float = 0.2) -> Model:
    """Learn from at most ``bound`` labelled documents that are not held out.

    The extreme-value law and the logistic curve are fitted on a third of the texts
    with a lexicon from the others; the lexicon in use is that of all. Without toxic or
    without clean rows to learn from the lexicon is empty, and where they are missing among those to
    calibrate on a curve of fixed form stands in (see ``curve``). A text without evidence is never
    predicted toxic, whatever the share of toxic rows.
    """
    rows = materialize(training_rows(docs, labels, bound))
    apart, whole = lexicons(rows, share)
    check = rows.where("check").mapInArrow(lambda batches: training_segments(batches, apart, drift), "toxic int, tokens bigint, scores array<double>").toArrow()  # at most ``bound`` rows
    toxic, sizes, scores = (check.column("toxic").to_numpy() == 1), check.column("tokens").to_pylist(), check.column("scores").to_pylist()
    chance = sorted(s for t, ss in zip(toxic, scores, strict=True) if not t for s in ss)
    tokens = max(1, sum(n for t, n in zip(toxic, sizes, strict=True) if not t))
    lam, k = extreme_value_law(apart, drift, tokens, chance)
    model = Model(apart, drift, lam, k, 0.0, 0.0)
    x = np.array([model.evidence([(0, 0, s) for s in ss], n) for n, ss in zip(sizes, scores, strict=True)])
    model.slope, model.offset = curve(x, toxic)
    model.lexicon = whole
    release(rows)
    return model


def extreme_value_law(lexicon: dict[str, float], drift: float, tokens: int, chance: list[float]) -> tuple[float, float]:
    """lambda and K, from the sorted segments of ``tokens`` tokens of clean text: K is such that the law gives as many above their median as there are."""
    lam = decay(lexicon, drift, tokens, chance)
    middle = chance[len(chance) // 2] if chance else 0.0
    return lam, (sum(s >= middle for s in chance) + 1) * math.exp(lam * middle) / tokens


def training_segments(batches: Iterator[pa.RecordBatch], lexicon: dict[str, float], drift: float) -> Iterator[pa.RecordBatch]:
    known = Scores(lexicon)
    for b in slices(batches):
        tokens = [TOKEN.findall(t.as_py().lower()) for t in b.column("text")]
        scores = [[s for _, _, s in segments(t, known, drift)] for t in tokens]
        yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), pa.array(list(map(len, tokens)), pa.int64()), pa.array(scores, pa.list_(pa.float64()))], ["toxic", "tokens", "scores"])


def decay(lexicon: dict[str, float], drift: float, tokens: int, chance: list[float]) -> float:
    """lambda of the extreme-value law: the root of E[exp(lambda s)] = 1 over the tokens of clean text.

    ``chance`` has the segments of clean text; their starts stand for positive tokens,
    of which one more is supposed, so that the root exists.
    """
    up = np.array([*chance, max(lexicon.values(), default=1.0)])
    up = up[up > 0]
    share = len(up) / (tokens + len(up))

    def excess(x: float) -> float:
        return (1 - share) * math.exp(-drift * x) + share * float(np.exp(np.minimum(x * up, 700)).mean()) - 1

    low, high = 0.0, 1e-3
    while excess(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max(low, 1e-3)


#: Where no curve can be fitted: one third to one without evidence, even at an evidence of ln 3; without evidence a score stays below one half.
UNFITTED, NO_EVIDENCE = (1.0, -math.log(3)), math.log(0.49 / 0.51)


def curve(x: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve that turns evidence into a probability, fitted where there are rows of both classes."""
    slope, offset = logistic(x, toxic) if toxic.any() and not toxic.all() else UNFITTED
    return slope, min(offset, NO_EVIDENCE)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-6) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, lightly held to zero."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    if not len(x) or y.all() or not y.any():
        return 0.0, math.log(rate / (1 - rate))
    unit = max(1e-9, x.std())
    a = np.c_[x / unit, np.ones(len(x))]
    w = np.zeros(2)
    loss = lambda v: np.logaddexp(0, np.where(y, -1, 1) * (a @ v)).sum() + ridge * v @ v / 2 * len(y)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        grad = a.T @ (p - y) + ridge * len(y) * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * len(y) * np.eye(2), grad)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(max(0.0, w[0]) / unit), float(w[1])


def text_score(model: Model, known: Scores, text: str | None) -> tuple[float, int, list[tuple[int, int, float]]]:
    """Probability, number of tokens and the significant passages as token spans with their excess."""
    tokens = TOKEN.findall((text or "").lower())
    found = segments(tokens, known, model.drift)
    strong = [(s, e, x) for s, e, v in found if (x := model.excess(v, len(tokens))) > 0]
    return model.probability(sum(x for _, _, x in strong)), len(tokens), strong


PASSAGES = "array<struct<start:int,end:int,excess:double>>"
SCORED = f"doc_id bigint, held_out boolean, score double, predicted int, passages {PASSAGES}"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and the significant passages of every row of ``docs`` (doc_id, text).

    A passage is a span of tokens (runs of letters and digits) with its excess over
    chance. Null and empty texts have no passage and the score of no evidence. Rows
    are scored one by one: repeated rows alike, other columns ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # keys that passed the test on a bounded number of rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        m = sent.value
        known = Scores(m.lexicon)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("excess", pa.float64())]))
        for b in slices(batches):
            got = [text_score(m, known, t.as_py()) for t in b.column("text")]
            p = pa.array([g[0] for g in got], pa.float64())
            passages = pa.array([[{"start": s, "end": e, "excess": x} for s, e, x in g[2]] for g in got], kind)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), p, pc.greater_equal(p, 0.5).cast(pa.int32()), passages], ["doc_id", "held_out", "score", "predicted", "passages"])

    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held, "text").mapInArrow(run, SCORED)


def clean_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score is below one half, in one pass.

    Null and empty texts have the score of no evidence. Rows are judged one by one, so
    repeated rows and ids stay or go alike. All columns pass through, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        m = sent.value
        known = Scores(m.lexicon)
        for b in slices(batches):
            yield b.filter(pa.array([text_score(m, known, t.as_py())[0] < 0.5 for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and passages of every row of ``documents``.

    Learned from labelled rows that are not held out; null labels and null ids teach nothing.
    Null, empty and very long texts, repeated rows, empty tables: see ``score`` and ``learn``.
    """
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
