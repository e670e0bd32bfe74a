"""Mixing sources to target weights, in DataFrame operations only.

Every source gets a word target; a source whose target exceeds its size is first
taken in complete epochs, and only the rest is sampled. The sample is drawn by
Efraimidis and Spirakis: a document with quality weight w gets the key -ln(u) / w,
and documents are taken in rising order of the key until the budget is used.

The order within a source is found without sorting a source in one task. Rows of one
source, id and size are drawn together and counted before the shuffle. What is left falls
into buckets by the share of the source's rows that chance puts below a key, given its
weights, so that buckets hold about as many whatever the weights; bucket totals are
prefix-summed, and only the rows of one bucket are ordered together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, null_safe, table, unit_interval, unused


def source_targets(sizes: DataFrame, budget: float, weights: tuple[int, ...], cap: float) -> DataFrame:
    """Targets of the sources in ``sizes`` (source, source_size, docs).

    Weights repeat over the sources in code point order, null last. Targets share
    ``budget`` times all sizes; one that would exceed ``cap`` times its source's size
    stops there and the excess goes to the others by weight. Sorted by the level at
    which each source fills up, the full ones are a prefix, so two running sums
    replace the repetition. One row per source passes through a single task.
    """
    everything = W.partitionBy()
    by_name = W.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("double"))
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(cap))).withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(budget)))
    before = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    spent, gone = F.coalesce(F.sum("limit").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("full", (F.col("budget") - spent) * F.col("weight") > F.col("limit") * (F.sum("weight").over(everything) - gone))
    rest = F.col("budget") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("limit")).otherwise(rest * F.col("weight") / open_weight)
    return s.select("source", "source_size", "docs", target.alias("target"))


def drawn(docs: DataFrame, quality: DataFrame | None, budget: float, weights: tuple[int, ...], cap: float, seed: str, bucket_docs: int) -> DataFrame:
    """(source, doc_id, size) once, with the number of ``copies``, source_size, target, epochs, the words ``part`` to draw beyond the epochs and ``start``, the words drawn before."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = materialize(docs.select("doc_id", "source", size.alias("size")))  # texts are read once and never shuffled
    rows = rows.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))
    if quality is not None:
        weighted = quality.select("doc_id", F.col("weight").cast("double").alias("weight"))
        rows = rows.join(weighted, "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    rows = rows.withColumn("key", -F.log(unit_interval(seed, F.col("doc_id"))) / F.col("weight"))

    octave = F.floor(F.log2("weight") * 4).cast("int").alias("octave")  # a few dozen classes of weights
    of_class = rows.groupBy("source", octave).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * F.col("copies")).alias("words"))
    spread = F.collect_list(F.struct(F.pow(F.lit(2.0), F.col("octave") / 4).alias("weight"), F.col("n").cast("double").alias("n")))
    sizes = of_class.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("docs"), spread.alias("classes"))
    targets = source_targets(sizes.drop("classes"), budget, weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    targets = targets.withColumn("epochs", epochs).withColumn("part", F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = targets.withColumn("buckets", F.ceil(F.col("docs") / bucket_docs))
    classes = sizes.select(F.col("source").alias("named"), "classes")
    targets = targets.join(classes, F.col("source").eqNullSafe(F.col("named"))).drop("named").withColumnRenamed("source", "of")

    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    below = F.aggregate("classes", F.lit(0.0), lambda s, c: s + c["n"] * (1 - F.exp(-c["weight"] * F.col("key"))))
    rows = rows.withColumn("bucket", F.least(F.floor(below / F.col("docs") * F.col("buckets")), F.col("buckets") - 1).cast("bigint")).drop("classes")
    totals = rows.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("in_bucket"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)).alias("ahead"))
    joined = rows.join(totals, null_safe(rows, totals, "source", "bucket")).drop(totals["source"]).drop(totals["bucket"])
    order = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("ahead") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0))
    return joined.select("doc_id", "source", "size", "copies", "source_size", "target", "epochs", "part", start.alias("start"))


def mix(docs: DataFrame, quality: DataFrame | None = None, *, budget: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), cap: float = 2.0, seed: str = "mix", bucket_docs: int = 4_000, whole: bool = False) -> DataFrame:
    """Words to take from every document so that sources reach their targets.

    ``docs`` has doc_id, source and text; ``quality`` has one row (doc_id, weight) per
    document with a weight other than 1, above zero. Returns doc_id, source, size, source_size, target
    and taken, one row per row of ``docs``; other columns are ignored, whatever their
    names. taken is size times the number of times the document is in the mix: whole
    epochs, and once more for sampled documents. The document on the edge of the
    budget gives the words that are left of it; with ``whole`` it is taken whole or
    not, whichever leaves the total nearer to the target.

    Null and empty texts have size 0 and take part with nothing. Null sources form a
    source of their own. Rows that repeat an id draw the same key and stay separate
    rows. An empty table gives an empty result. The draw depends on ids, sizes and
    the seed only, so reruns agree.
    """
    rows = drawn(docs, quality, budget, weights, cap, seed, bucket_docs)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    start = F.col("start") + F.col("copy") * F.col("size")
    if whole:
        extra = F.when((F.col("part") > 0) & (start + F.col("size") / 2 <= F.col("part")), F.col("size")).otherwise(0)
    else:
        extra = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("part") - start)))
    taken = F.col("size") * F.col("epochs") + extra
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def label_quality(labels: DataFrame, good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """doc_id and weight: ``good`` for documents labelled 1, ``bad`` for 0, 1 for other labels. Repeated labels: the largest."""
    q = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    return q.select("doc_id", F.when(F.col("label") == 1, good).when(F.col("label") == 0, bad).otherwise(1.0).alias("weight"))


def mixed_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it whole (not at all, once or twice).

    Of rows that repeat source, id and size the sample may take some only, those of the
    smallest text hashes. Texts without words go. Null ids and sources are values like any
    other. All columns pass through, whatever their names.
    """
    rows = drawn(docs, label_quality(labels), 1.5, (5, 2, 1), 2.0, "mix", 4_000).where("size > 0")
    sampled = F.when(F.col("part") > 0, F.floor((F.col("part") - F.col("start")) / F.col("size") + 0.5)).otherwise(0)
    sampled = F.greatest(F.lit(0), F.least(sampled, F.col("copies")))  # as many as end half a document beyond the budget at most
    rows = rows.withColumn("sampled", sampled).where("epochs > 0 or sampled > 0")
    id_, source, size, epochs, more, some, times = unused(docs, "mix_id", "mix_source", "mix_size", "mix_epochs", "mix_sampled", "mix_some", "mix_times")
    t = rows.select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("size").alias(size), F.col("epochs").alias(epochs), F.col("sampled").alias(more), (F.col("sampled").between(1, F.col("copies") - 1)).alias(some))
    kept = docs.join(t, docs["doc_id"].eqNullSafe(t[id_]) & docs["source"].eqNullSafe(t[source]) & (F.regexp_count(docs["text"], F.lit(WORD)).cast("bigint") == t[size]))
    often = kept.where(~F.col(some)).withColumn(times, F.col(epochs) + F.least(F.col(more), F.lit(1)))
    place = F.row_number().over(W.partitionBy(id_, source, size).orderBy(F.xxhash64("text")))  # one such group a source, at the edge of its budget
    split = kept.where(F.col(some)).withColumn(times, place).withColumn(times, F.col(epochs) + F.when(F.col(times) <= F.col(more), 1).otherwise(0))
    every = often.unionByName(split).where(F.col(times) > 0)
    return every.withColumn(times, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times).cast("bigint")))).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``documents``, quality weights from ``labels``.

    Null and empty texts, null ids and sources, repeated rows and an empty table: see ``mix``.
    Columns other than doc_id, source and text are not read.
    """
    return mix(table(spark, sf_dir, "documents"), label_quality(table(spark, sf_dir, "labels"))).drop("source")


OP2_SQL = r"""
WITH q AS (SELECT doc_id, max(quality) AS label FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
      / (CASE q.label WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS key
  FROM documents d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
    2 * source_size AS lim, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
f AS (
  SELECT *, (budget - coalesce(sum(lim) OVER b, 0)) * weight > lim * (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS "full"
  FROM w WINDOW b AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN "full" THEN lim
    ELSE (budget - sum(CASE WHEN "full" THEN lim ELSE 0 END) OVER ()) * weight / sum(CASE WHEN "full" THEN 0 ELSE weight END) OVER () END AS target FROM f),
e AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (size * epochs + greatest(0, least(size, floor(target - epochs * source_size - start))))::BIGINT AS taken
FROM e
"""
