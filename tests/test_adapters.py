import numpy as np
import pytest

from sievelight.operators import adapters

from .test_collection import collection


def make():
    import os

    import numpy as np

    from sievelight.operators.adapters import AdapterError

    loads = []
    loads.append(os.getpid())

    def model(texts):
        if len(texts) > 4 or sum(map(len, texts)) > 60:
            raise AdapterError("rate_limit")
        if "quota" in texts:
            raise AdapterError("quota_exceeded")
        if "boom" in texts:
            raise OSError("no route")
        if "few" in texts:
            return [[1.0, 2.0]]
        return [{"zero": [0.0, 0.0], "nan": [float("nan"), 1.0], "huge": [3e38, 3e38]}.get(t, [float(len(t)), 1.0]) for t in texts]

    return model


def test_embeddings_are_checked(spark):
    profile = adapters.Profile("toy", 2, most_texts=4, most_chars=60, longest=30)
    texts = [f"text {i}" for i in range(40)] + ["zero", "nan", "huge", None, "x" * 31, "y" * 30, "text 1", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    got = {r.id: (r.vector, r.error) for r in adapters.embedded(rows, make, profile).collect()}
    for i, t in enumerate(texts):
        want = {"zero": (None, "contract_violation"), "nan": (None, "contract_violation"), None: (None, "invalid_input"), "x" * 31: (None, "invalid_input")}.get(t)
        if t == "huge":
            assert got[i][1] is None and np.isfinite(got[i][0]).all()
        else:
            assert got[i] == (want or ([float(len(t)), 1.0], None))
    bad = spark.createDataFrame([("quota",), ("boom",), ("few",)], "text string").coalesce(1)
    one = adapters.Profile("toy1", 2, most_texts=1)
    assert {r.text: r.error for r in adapters.embedded(bad, make, one).collect()} == {"quota": "quota_exceeded", "boom": "network_error", "few": None}
    both = adapters.Profile("toy2", 2, most_texts=4)
    assert {r.error for r in adapters.embedded(spark.createDataFrame([("few",), ("other",)], "text string").coalesce(1), make, both).collect()} == {"contract_violation"}
    assert adapters.embedded(rows.limit(0), make, profile).count() == 0
    with pytest.raises(ValueError):
        adapters.AdapterError("odd")


def scorer():
    def score(query, texts):
        if query == "bad":
            return [float("nan")] * len(texts)
        return [float(t.count(query)) for t in texts]

    return score


def test_rescoring_only_reorders(spark):
    rows = [(q, "a" if q < 2 else "bad", k, "a" * (k * 7 % 4)) for q in range(3) for k in range(1, 9)]
    df = spark.createDataFrame(rows, "query_id int, query string, rank int, text string").repartition(4)
    got = adapters.rescored(df, scorer, adapters.Profile("s", 1, most_texts=3)).collect()
    assert len(got) == len(rows)
    for q in range(3):
        mine = [r for r in got if r.query_id == q]
        want = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3].count("a") if q < 2 else 0, r[2]))
        assert [r.rank for r in sorted(mine, key=lambda r: r.new_rank)] == [r[2] for r in want] and {r.failed for r in mine} == {q == 2}


def test_a_collection_takes_an_embedder(spark):
    col = collection(spark)
    asked = []
    col.embed = lambda q: asked.append(q) or [float(x) for x in col.tables["vectors"].where("chunk_id = 'kr2'").first().vector]
    assert col.search("whatever", mode="vector").orderBy("rank").first().raw_hash == "r2" and asked == ["whatever"]
