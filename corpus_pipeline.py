"""From raw documents to sampled segmentations: filter, deduplicate, mix, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelight.llm import jaccard, lines, mixing, segmentation, toxicity
from sievelight.llm.common import materialize, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; learned from the labelled ones among them.

    Null and empty texts stay, and all texts where nothing can be learned (no labels, or of one kind).
    Rows are judged one by one, so repeated rows and ids stay or go alike. An empty table stays empty; all columns,
    whatever their names, pass through.
    """
    return toxicity.clean_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines of ten words or more; those of which nothing is left go.

    The copy of the smallest id stays, null ids coming last; texts without a line that has a word, null ones
    among them, stay as they are. Rows that repeat id and text are cut alike. n_chars is set anew, other columns pass through.
    """
    return lines.kept_documents(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Texts without a word, null and blank ones, are one group. Null ids come last, and are documents of their own, as are
    rows that repeat an id with another text; of rows that repeat both one stays. All columns pass through.
    """
    return jaccard.first_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, whole epochs first; a null source is a source.

    Documents without a word are never taken, null ids are values like any other; of rows that repeat source, id and
    size some may be taken only. All columns pass through.
    """
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every row, with their inclusion scores and the text that they give back.

    Null and empty texts have one segmentation, without pieces; rows that repeat id and text have the same ones.
    """
    return segmentation.segmentations(docs, cached=250_000)  # executors hold the earlier stages' memory too


STAGES = [("toxicity", clean), ("line dedup", unrepeated), ("simhash near-dedup", distinct), ("mixing", mixed), ("sentencepiece", encoded)]

#: Learned scores and sampled segmentations have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, each on all that the one before kept of ``documents``; every stage's table is written and read back. Empty tables give no rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
