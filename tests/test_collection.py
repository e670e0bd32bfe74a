import pytest
from pyspark.sql import functions as F

from sievelight.functions import vectors
from sievelight.operators import chunking
from sievelight.operators.index import TextIndex
from sievelight.plans.collection import Collection, Selector, Settings
from sievelight.streaming import ingest

TEXTS = {"r1": "the quick brown fox", "r2": "lazy dogs sleep", "r3": "quick silver"}


def collection(spark, **kw):
    c = spark.createDataFrame([("s", f"k{r}", r, "[]", t) for r, t in TEXTS.items()], "scope_id string, chunk_id string, raw_hash string, heading_path string, text string").withColumn("created_at", F.current_timestamp())
    v = spark.createDataFrame([("s", f"k{r}", None, vectors.token_embedding(t).tolist()) for r, t in TEXTS.items()], "scope_id string, chunk_id string, image_id string, vector array<float>")
    e = spark.createDataFrame([("s", "c1", "a", "r1"), ("s", "c1", "c", "r3"), ("s", "c2", "a", "r1"), ("s", "c2", "b", "r2")], "scope_id string, commit_hash string, path string, raw_hash string")
    p = spark.createDataFrame([("s", "c2", "c1", 0)], "scope_id string, commit_hash string, parent string, ord int")
    h = spark.createDataFrame([("s", "c2")], "scope_id string, commit_hash string")
    return Collection(spark, {"chunks": c, "vectors": v, "entries": e, "parents": p, "heads": h}, **kw)


def test_time_selectors(spark):
    col = collection(spark)
    found = lambda **k: {r.raw_hash for r in col.search("quick", mode="text", **k).collect()}
    assert found() == {"r1"}
    assert found(selector=Selector(at="c1")) == {"r1", "r3"} == found(selector=Selector(all_history=True)) == found(selector=Selector(include_deleted=True)) == found(selector=Selector(since="1d"))
    assert found(scopes=["other"]) == set()


def test_hybrid_search(spark):
    rows = collection(spark).search("lazy dogs").orderBy("rank").collect()
    assert rows[0].raw_hash == "r2" and rows[0].path == "b" and rows[0].commit_hash == "c2"
    assert collection(spark, settings=Settings(diversify="off")).search("do", mode="text").count() == 1
    assert collection(spark).log("s").count() == 2
    assert {r.path: r.state for r in collection(spark).diff("c1", "c2").collect()} == {"a": "unchanged", "b": "added", "c": "deleted"}


def test_streamed_chunks(spark, tmp_path):
    schema = "raw_hash string, tool_profile_hash string, gen long, unit_key string, text string, at timestamp"
    units = spark.createDataFrame([("r1", "p", 1, "u", "# A\nx"), ("r1", "p", 1, "u", "# A\nx"), ("r2", "p", 1, "u", "y")], schema.rpartition(",")[0]).withColumn("at", F.current_timestamp())
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    units.write.parquet(source)
    for _ in range(2):
        q = ingest.append_chunks(ingest.stream_chunks(spark, source, schema), target, str(tmp_path / "cp"))
        q.awaitTermination()
    got = spark.read.parquet(target)
    assert got.count() == 2 and set(got.columns) >= {"chunk_id", "text"}
    assert chunking.chunk(units).select("chunk_id").distinct().count() == 2


def test_pages_and_their_tokens(spark):
    col = collection(spark, settings=Settings(cursor_key=b"k", diversify="off"))
    one = col.answer("quick dogs fox", mode="text", selector=Selector(all_history=True), limit=2)
    two = col.answer("quick dogs fox", mode="text", selector=Selector(all_history=True), limit=2, cursor=one.cursor)
    seen = [r.raw_hash for a in (one, two) for r in a.rows.orderBy("rank").collect()]
    assert len(seen) == 3 and set(seen) == set(TEXTS) and two.cursor is None
    with pytest.raises(ValueError):
        col.answer("quick", mode="text", selector=Selector(all_history=True), cursor=one.cursor)
    with pytest.raises(ValueError):
        col.answer("quick dogs fox", mode="text", cursor=one.cursor)


def test_what_is_searched_and_why(spark):
    assert collection(spark).answer("quick").mode == "hybrid"
    asked = collection(spark, settings=Settings(consent=False)).answer("quick")
    assert (asked.mode, asked.reason) == ("text", "consent_required")
    with pytest.raises(ValueError, match="consent"):
        collection(spark, settings=Settings(consent=False, fail_behavior="error")).answer("quick", mode="vector")
    col = collection(spark)
    col.tables["profiles"] = spark.createDataFrame([("s", 768, "cosine", "text", "p"), ("t", 512, "cosine", "text", "p")], "scope_id string, dimensions int, distance string, modality string, profile_hash string")
    assert (col.answer("quick").mode, col.answer("quick").reason) == ("text", "profile_mismatch")
    del col.tables["vectors"]
    assert col.answer("quick").reason == "vectors_unavailable"


def test_images_rank_with_their_chunks(spark):
    col = collection(spark, settings=Settings(diversify="off"))
    v = spark.createDataFrame([("s", "kr2", "img", vectors.token_embedding("lazy dogs sleep").tolist())], "scope_id string, chunk_id string, image_id string, vector array<float>")
    col.tables["vectors"] = v
    top = col.search("lazy dogs").orderBy("rank").first()
    assert (top.raw_hash, top.image_id) == ("r2", "img") and top.score > 1 / 61


def test_an_index_answers_alike(spark, tmp_path):
    col = collection(spark, settings=Settings(diversify="off"))
    TextIndex.build(col.tables["chunks"], str(tmp_path / "i"))
    rows = lambda c: [tuple(r) for r in c.search("quick", mode="text", selector=Selector(all_history=True)).orderBy("rank").collect()]
    want = rows(col)
    col.index = TextIndex(spark, str(tmp_path / "i"))
    got = rows(col)
    assert [r[:4] for r in got] == [r[:4] for r in want] and len(got) == 2


def test_commits_without_a_tree_are_skipped(spark):
    col = collection(spark)
    col.tables["parents"] = col.tables["parents"].unionByName(spark.createDataFrame([("s", "c1", "c0", 0)], "scope_id string, commit_hash string, parent string, ord int"))
    assert col.bindings(Selector(all_history=True)).count() == 4 and col.shallow.count() == 1
    assert {(r.path, r.pointer_commit, r.is_live) for r in col.history_of("s").collect()} == {("a", "c1", True), ("c", "c1", False), ("b", "c2", True)}


def test_purges_bar_scopes(spark):
    col = collection(spark)
    col.tables["purges"] = spark.createDataFrame([("s",)], "scope_id string")
    assert col.search("quick", mode="text").count() == 0
