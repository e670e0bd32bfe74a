import pytest
from pyspark.sql import functions as F

from sievelight.operators import index, search
from sievelight.operators.index import TextIndex

SCHEMA = "scope_id string, chunk_id string, raw_hash string, heading_path string, text string"
PHRASES = [["alpha beta"], ["ABC", "naïve"], ["aaa", "beta gamma", "title"], ["nowhere", "alpha"]]


def chunks(first, last, tag=""):
    words = ["alpha", "beta", "gamma", "naïve", "aaaaa", "xabcx", "漢字かな", "delta"]
    return [(f"s{i % 3}", f"c{i:04d}", f"h{i % 50}", '["Title"]' if i % 4 else "[]", tag + " ".join(words[(i * k) % 8] for k in range(1, 3 + i % 23))) for i in range(first, last)]


def ranked(df):
    return [(r.scope_id, r.chunk_id, round(r.bm25, 9), r.rank) for r in df.orderBy("rank").collect()]


def same_as_fresh(spark, built, rows, eligible=None):
    corpus = spark.createDataFrame(rows, SCHEMA)
    assert built.chunks == len(rows)
    for phrases in PHRASES:
        assert ranked(built.bm25(phrases, eligible, depth=40)) == ranked(search.bm25(corpus, phrases, eligible, depth=40)), phrases


@pytest.mark.parametrize("few", [50_000, -1])
def test_updates_equal_a_fresh_index(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(index, "FEW_HITS", few)
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    rows = {r[:2]: r for r in chunks(0, 300)}
    v1 = TextIndex.build(df(list(rows.values())), f"{tmp_path}/i")
    same_as_fresh(spark, v1, list(rows.values()))
    before = ranked(v1.bm25(["alpha beta"]))

    more = chunks(300, 320) + chunks(10, 20, "alpha beta alpha beta changed ")  # new ones, and ten in place of old ones
    v2 = v1.append(df(more))
    rows |= {r[:2]: r for r in more}
    same_as_fresh(spark, v2, list(rows.values()))

    gone = [k for k in rows if int(k[1][1:]) % 7 == 0]
    v3 = v2.delete(spark.createDataFrame([*gone, ("s0", "none")], "scope_id string, chunk_id string"))
    rows = {k: r for k, r in rows.items() if k not in gone}
    eligible = df([r for r in rows.values() if r[0] != "s1"]).select("scope_id", "chunk_id")
    same_as_fresh(spark, v3, list(rows.values()))
    same_as_fresh(spark, v3, list(rows.values()), eligible)

    v4 = v3.compact()
    assert len(v4.manifest.segments) <= len(v3.manifest.segments)
    v5 = v4.append(df(chunks(400, 404))).append(df(chunks(404, 408))).compact()
    rows |= {r[:2]: r for r in chunks(400, 408)}
    assert len(v5.manifest.segments) <= 3
    same_as_fresh(spark, v5, list(rows.values()))
    v6 = v5.compact(whole=True)
    assert len(v6.manifest.segments) == 1 and not v6.manifest.deletions
    same_as_fresh(spark, v6, list(rows.values()))
    assert {(r.scope_id, r.chunk_id) for r in v6.docs.collect()} == set(rows)

    # a reader keeps its version, until it is cleared away; a writer on an old one is refused
    assert ranked(TextIndex(spark, f"{tmp_path}/i", 1).bm25(["alpha beta"])) == before == ranked(v1.bm25(["alpha beta"]))
    with pytest.raises(RuntimeError):
        v3.append(df(chunks(500, 501)))
    latest = TextIndex(spark, f"{tmp_path}/i")
    assert latest.manifest == v6.manifest and latest.vacuum() > 4
    same_as_fresh(spark, TextIndex(spark, f"{tmp_path}/i"), list(rows.values()))


def test_a_version_without_its_end_is_not_read(spark, tmp_path):
    v1 = TextIndex.build(spark.createDataFrame(chunks(0, 5), SCHEMA), f"{tmp_path}/i")
    (tmp_path / "i/manifests/000000000002").write_text('{"version": 2')
    assert TextIndex(spark, f"{tmp_path}/i").manifest == v1.manifest


def test_state_sees_nested_files(spark, tmp_path):
    (tmp_path / "t/a=1/b=2").mkdir(parents=True)
    (tmp_path / "t/a=1/b=2/f").write_text("x")
    before = index.state_of(spark, f"{tmp_path}/t")
    (tmp_path / "t/a=1/b=2/f").write_text("xy")
    assert index.state_of(spark, f"{tmp_path}/t") != before


def test_index_is_published_once(spark, tmp_path):
    made = []
    corpus = lambda: made.append(1) or spark.createDataFrame(chunks(0, 5), SCHEMA)
    name = f"test-{tmp_path.name}"
    first = TextIndex.of(spark, corpus, name)
    index._open.clear()
    assert TextIndex.of(spark, corpus, name).path == first.path and len(made) == 1


def test_delete_from_an_empty_index(spark, tmp_path):
    v = TextIndex(spark, f"{tmp_path}/i").delete(spark.createDataFrame([("a", "b")], "scope_id string, chunk_id string"))
    assert v.chunks == 0 and v.bm25(["abc"]).count() == 0 and v.append(spark.createDataFrame([], SCHEMA)).docs.count() == 0


def test_postings_are_written_where_they_are_made(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "RUN_BYTES", 200, raising=False)
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def shuffled():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()) if stages.apply(i).stageId() > last)

    stages = store.stageList(None, False, False, none, None)
    last = max([stages.apply(i).stageId() for i in range(stages.size())], default=-1)
    rows = [(s, c, h, head, text * 20) for s, c, h, head, text in chunks(0, 400)]
    v = TextIndex.build(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/i")
    n = shuffled()
    assert n < v.postings.count() / 2
    held = {}
    for _, c, _, head, text in rows:
        for g in {*index.grams_of(head.lower()).tolist(), *index.grams_of(text.lower()).tolist()}:
            held[g] = held.get(g, 0) + 1
    assert v.docs_with(sorted(held)[:200]) == {g: held[g] for g in sorted(held)[:200]}
    same_as_fresh(spark, v, rows)
