from pyspark.sql import functions as F

from sievelight.llm import mixing


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_targets_and_epochs(spark):
    rows = [(i, s, "w " * (i % 7 + 1)) for i, s in enumerate(["a"] * 40 + ["b"] * 200 + [None] * 60)]
    part = sum(r.taken for r in mixing.mix(make(spark, rows), bucket_docs=10).collect())
    assert abs(part - 1.5 * sum(len(t.split()) for _, _, t in rows)) <= 3  # to a word for each source
    got = mixing.mix(make(spark, rows), bucket_docs=10, whole=True).collect()
    assert len(got) == 300
    by = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        by.setdefault(r.source, [r.source_size, r.target, 0])[2] += r.taken
    total = sum(v[0] for v in by.values())
    assert abs(sum(v[1] for v in by.values()) - 1.5 * total) < 1e-6
    assert by["a"][1] == 2 * by["a"][0]  # the largest weight hits its limit
    for size, target, taken in by.values():
        assert target <= 2 * size and abs(taken - target) <= 7


def test_buckets_do_not_matter(spark):
    rows = [(i, "s", "w " * (i % 5)) for i in range(300)] + [(1000, "t", "w " * 3000)]
    a, b = (sorted((r.doc_id, r.taken) for r in mixing.mix(make(spark, rows), bucket_docs=n).collect()) for n in (7, 10_000))
    assert a == b


def test_odd_rows(spark):
    assert mixing.mix(make(spark, [])).count() == 0
    rows = [(1, "s", None), (2, "s", ""), (3, None, "one two"), (3, None, "one two"), (None, "u", "x")]
    docs = make(spark, rows).withColumn("size", F.lit("clash")).withColumn("taken", F.lit(7))
    got = mixing.mix(docs).collect()
    assert len(got) == 5 and all(r.taken <= 2 * r.size for r in got)


def test_quality_draws_more(spark):
    rows = [(i, "s" if i < 2000 else "t", "w") for i in range(4000)]
    q = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(4.0).alias("weight"))
    got = [r for r in mixing.mix(make(spark, rows), q, budget=0.75, weights=(1, 9)).collect() if r.source == "s"]
    heavy = sum(r.taken for r in got if r.doc_id < 1000)
    assert heavy > sum(r.taken for r in got) * 0.6


def test_mixed_documents_repeats_rows(spark):
    rows = [(i, "a", "w w") for i in range(10)] + [(100 + i, "b", "w " * 5) for i in range(40)]
    docs = make(spark, rows)
    labels = spark.createDataFrame([(0, 1), (0, 0)], "doc_id long, quality int")
    out = mixing.mixed_documents(docs, labels)
    assert out.columns == docs.columns
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(docs, mixing.label_quality(labels), whole=True).collect()}
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in taken.items() if v}


def test_weights_fill_buckets_evenly(spark):
    rows = [(i, "s", "w") for i in range(6000)]
    q = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0.05).alias("weight"))
    d = mixing.drawn(make(spark, rows), q, 1.5, (5, 2, 1), 2.0, "mix", 100)
    starts = sorted(r.start for r in d.collect())
    assert starts == list(range(6000))


def test_repeated_rows_are_taken_in_part(spark):
    rows = [(7, "a", "w w w")] * 50 + [(i, "b", "w") for i in range(100, 150)] + [(None, None, "x y")] * 20
    docs = make(spark, rows)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    one = mixing.mix(docs, mixing.label_quality(labels), whole=True).collect()
    out = mixing.mixed_documents(docs, labels).collect()
    assert len(one) == 120
    for source in ("a", "b", None):
        words = sum(len(r.text.split()) for r in out if r.source == source)
        assert words == sum(r.taken for r in one if r.source == source)
        assert abs(words - next(r.target for r in one if r.source == source)) <= 3
