import json
import sqlite3

import numpy as np
import pytest

from sievelight.operators import chunking, index, search

UNIT = {"raw_hash": "r", "tool_profile_hash": "p", "gen": 1, "unit_key": "u"}


def spans(text, max_chars=6000):
    return [(c["heading_path"], c["section_id"], c["text"]) for c in chunking.chunk_unit(UNIT | {"text": text}, max_chars)]


def test_headings_and_fences():
    got = spans("intro\n# A\none\n## B ##\ntwo\n```\n# no\n```\n# A\nthree\n#\n####### x\n#nospace\n")
    assert [(p, s) for p, s, _ in got] == [([], None), (["A"], "a"), (["A", "B"], "a/b"), (["A"], "a#2")]
    assert got[2][2].endswith("```\n")
    assert spans("### deep\nx\n# up\ny")[0][0] == ["deep"]
    assert spans(" \n\t\n") == []


def test_sizes_and_bytes():
    text = "é" * 5 + "\n\n" + "b" * 5 + "\n\n" + "c" * 12
    got = list(chunking.chunk_unit(UNIT | {"text": text}, 10))
    assert [c["text"] for c in got] == ["ééééé\n\n", "bbbbb\n\n", "c" * 10, "cc"]
    raw = text.encode()
    assert all(raw[c["byte_start"] : c["byte_end"]].decode() == c["text"] for c in got)
    assert [len(t) for _, _, t in spans("x" * 6001)] == [6000, 1]


def test_chunk_frame(spark):
    units = spark.createDataFrame([("r1", "p", 1, "u", "# A\nx"), ("r2", "p", 1, "u", None)], "raw_hash string, tool_profile_hash string, gen long, unit_key string, text string")
    rows = chunking.chunk(units).collect()
    assert len(rows) == 1 and rows[0].heading_path == ["A"]


DOCS = ["aaaa bbb", "the quick aaa fox", "ÉCOLE aaa école", "検索エンジン 検索", "nothing here", "bbb bbb bbb", "aaaaaaaa", "x", "", "common aaa", "aaa"]


@pytest.mark.parametrize("phrases", [["aaa"], ["aaa", "bbb"], ["école"], ["検索エ"], ["quick aaa"]])
def test_bm25_equals_full_text_search(spark, phrases):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(text, heading, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no trigram tokenizer here")
    heads = [json.dumps(["aaa"]) if i % 4 == 0 else "[]" for i in range(len(DOCS))]
    db.executemany("insert into t(rowid, text, heading) values (?, ?, ?)", [(i + 1, d, h) for i, (d, h) in enumerate(zip(DOCS, heads))])
    match = " OR ".join('"' + p + '"' for p in phrases)
    want = dict(db.execute("select rowid - 1, bm25(t, 1.0, 0.3) from t where t match ?", (match,)).fetchall())
    corpus = spark.createDataFrame([("s", f"{i:02d}", h, d) for i, (d, h) in enumerate(zip(DOCS, heads))], "scope_id string, chunk_id string, heading_path string, text string")
    got = {int(r.chunk_id): r.bm25 for r in search.bm25(corpus, phrases).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    some = corpus.where("chunk_id < '05'").select("scope_id", "chunk_id")
    assert {int(r.chunk_id): r.bm25 for r in search.bm25(corpus, phrases, some).collect()} == {k: v for k, v in got.items() if k < 5}


def lane(spark, ids, image=False):
    rows = [("s", c, None, i + 1) for i, c in enumerate(ids)]
    df = spark.createDataFrame(rows, "scope_id string, chunk_id string, image_id string, rank int")
    return df if image else df.drop("image_id")


def test_rank_fusion(spark):
    got = search.fuse(lane(spark, ["c1", "c2", "c3"]), lane(spark, ["c2", "c4", "c1", "c5"], True)).orderBy("rank").collect()
    assert [r.chunk_id for r in got][:2] == ["c2", "c1"] and [r.rank for r in got] == [1, 2, 3, 4, 5]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61) and got[0].score == pytest.approx(123 / 3782)
    images = spark.createDataFrame([("s", "c1", "i1", 1)], "scope_id string, chunk_id string, image_id string, rank int")
    rows = {(r.chunk_id, r.image_id): r.text_rank for r in search.fuse(lane(spark, ["c1"]), images).collect()}
    assert rows == {("c1", None): 1, ("c1", "i1"): 1}


def test_diversify_order():
    rel = np.array([1.0, 0.9, 0.8, 0.1])
    v = [np.array(x, float) for x in ([1, 0], [1, 0.01], [0, 1], [-1, 0])]
    order = search.mmr_order(rel, v, 0.7)
    assert order[0] == 0 and order[1] == 2 and sorted(order) == [0, 1, 2, 3]
    assert search.mmr_order(np.ones(3), [np.zeros(2)] * 3, 0.7) == [0, 1, 2]


def ranked(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, raw_hash string, score double, vector array<float>, rank int")


def test_diversify_frames(spark):
    rows = [("a", "r1", 1.0, [1.0, 0.0], 1), ("b", "r1", 0.9, [1.0, 0.0], 2), ("c", "r2", 0.5, [0.0, 1.0], 3), ("d", "r1", 0.4, [1.0, 0.1], 4)]
    out = search.diversify(ranked(spark, rows), most=2).orderBy("rank").collect()
    assert [r.chunk_id for r in out][:1] == ["a"] and len(out) == 3 and [r.rank for r in out] == [1, 2, 3]
    missing = [*rows[:3], ("d", "r1", 0.4, None, 4)]
    assert [r.chunk_id for r in search.diversify(ranked(spark, missing), most=0).orderBy("rank").collect()] == ["a", "b", "c", "d"]
    assert search.diversify(ranked(spark, rows), strategy="off").count() == 4
    assert [r.chunk_id for r in search.diversify(ranked(spark, rows), strategy="group_by_raw_hash", most=1).orderBy("rank").collect()] == ["a", "c"]


def test_vector_lane_images(spark):
    rows = [("s", "c1", None, [1.0, 0.0]), ("s", "c2", "i1", [1.0, 0.0]), ("s", "c3", "i1", [1.0, 0.0]), ("s", "c4", None, [0.0, 0.0]), ("s", "c5", None, [1.0]), ("s", "c0", "i2", [1.0])]
    df = spark.createDataFrame(rows, "scope_id string, chunk_id string, image_id string, vector array<float>")
    got = [(r.chunk_id, r.image_id) for r in search.vector_lane(df, [1.0, 0.0]).orderBy("rank").collect()]
    assert got == [("c1", None), ("c2", "i1")]
    only = spark.createDataFrame([("s", "c3")], "scope_id string, chunk_id string")
    assert [r.chunk_id for r in search.vector_lane(df, [1.0, 0.0], only).collect()] == ["c3"]


def test_modes():
    assert search.resolve_mode("auto", vectors_ready=True, online_allowed=True) == ("hybrid", None)
    assert search.resolve_mode("hybrid", vectors_ready=False, online_allowed=True) == ("text", "vectors_unavailable")
    with pytest.raises(ValueError):
        search.resolve_mode("vector", vectors_ready=True, online_allowed=False, fail_behavior="error")


def test_order_from_outside(spark):
    assert search.rerank(lane(spark, ["a", "b", "c"]), spark.createDataFrame([("c", 1)], "chunk_id string, new_rank int"), ["chunk_id"]).orderBy("rank").select("chunk_id").collect()[0][0] == "c"


@pytest.mark.parametrize("phrases", [["aaa"], ["aaa", "bbb"], ["école"], ["検索エ"], ["quick aaa"], ["aaaa"], ["no such"], ["aaa", "zzz"]])
def test_index_equals_scan(spark, tmp_path, phrases):
    heads = [json.dumps(["aaa"]) if i % 4 == 0 else "[]" for i in range(len(DOCS))]
    corpus = spark.createDataFrame([("s", f"{i:02d}", "r", h, d) for i, (d, h) in enumerate(zip(DOCS, heads))], "scope_id string, chunk_id string, raw_hash string, heading_path string, text string")
    index.TextIndex.build(corpus, f"{tmp_path}/i")
    built = index.TextIndex(spark, f"{tmp_path}/i")
    want = {r.chunk_id: r.bm25 for r in search.bm25(corpus, phrases).collect()}
    got = {r.chunk_id: r.bm25 for r in built.bm25(phrases).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    some = corpus.where("chunk_id < '05'").select("scope_id", "chunk_id")
    assert {r.chunk_id for r in built.bm25(phrases, some).collect()} == {k for k in want if k < "05"}


def test_index_of_nothing_and_of_odd_rows(spark, tmp_path):
    rows = [("s", "a", "r", "[]", None), ("s", "b", "r", None, "xy"), ("s", "c", "r", "[]", "😀😀😀 x")]
    corpus = spark.createDataFrame(rows, "scope_id string, chunk_id string, raw_hash string, heading_path string, text string")
    index.TextIndex.build(corpus, f"{tmp_path}/i")
    assert [r.chunk_id for r in index.TextIndex(spark, f"{tmp_path}/i").bm25(["😀😀😀"]).collect()] == ["c"]
    index.TextIndex.build(corpus.limit(0), f"{tmp_path}/j")
    assert index.TextIndex(spark, f"{tmp_path}/j").bm25(["abc"]).count() == 0
    with pytest.raises(ValueError):
        index.TextIndex(spark, f"{tmp_path}/j").bm25(["ab"])


def test_settled_lane(spark):
    assert [r.chunk_id for r in search.settled(lane(spark, ["a", "b"]), 2).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        search.settled(lane(spark, ["a", "b", "c"]), 2)
