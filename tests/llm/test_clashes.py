"""Operators on documents whose other columns have the names that plans use inside."""

from pyspark.sql import functions as F

from sievelight.llm import jaccard, langid, lines, mixing, segmentation, simhash, tokens, toxicity

NAMES = ["times", "size", "bucket", "key", "fp", "root", "node", "doc", "twin", "i", "n", "r", "s", "gone", "words", "score", "taken", "held_out", "lang", "rank", "pieces", "n_tokens", "toxic", "check", "component_id", "fingerprint"]
#: Those that joins with whole rows use.
JOINED = ["mix_id", "mix_source", "mix_size", "mix_epochs", "mix_sampled", "mix_some", "mix_times", "is_last", "of_doc", "of_twin", "lines", "kept_lines", "kept_id", "kept_twin", "text_hash", "_doc", "_twin", "_gone", "_lines", "_left", "_size", "_id", "_source", "_times", "_copy", "_kept", "_text_hash"]


def test_names_that_plans_use(spark):
    rows = [(i, f"some words of text number {i % 3} and more of them", "a" if i % 2 else None, 7) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    docs = docs.select("*", *[F.lit("clash").alias(n) for n in NAMES + JOINED])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).withColumn("weight", F.lit(9))
    assert mixing.mix(docs, mixing.label_quality(labels)).count() == 6
    assert set(mixing.mixed_documents(docs, labels).columns) == set(docs.columns)
    assert simhash.near_duplicates(docs).count() == 6 and jaccard.first_of_each(docs).columns == docs.columns
    assert lines.kept_documents(docs, min_words=3).columns == docs.columns
    assert toxicity.clean_documents(docs, toxicity.learn(docs, labels)).columns == docs.columns
    assert langid.identify(docs).count() == 6
    assert tokens.token_counts(docs).count() == 6 and segmentation.segmentations(docs).count() == 12
    got = lines.deduplicated(docs, min_words=3)
    assert got.columns == [*docs.columns, "lines_", "kept_lines_"] and got.count() == 6
    for out in (mixing.mixed_documents(docs, labels), jaccard.first_of_each(docs), lines.kept_documents(docs, min_words=3)):
        assert {tuple(r[n] for n in NAMES + JOINED) for r in out.collect()} == {("clash",) * len(NAMES + JOINED)}


def test_without_n_chars(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "one two three")], "doc_id long, text string")
    assert [tuple(r) for r in lines.kept_documents(docs, min_words=3).collect()] == [(1, "one two three")]
