import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from sievelight.llm import toxicity


def brute_segments(s):
    """Recursive definition: the best segment, then the same to its left and right."""
    best = max(((sum(s[i:j]), -(j - i), -i) for i, j in itertools.combinations(range(len(s) + 1), 2)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    total, n, i = best[0], -best[1], -best[2]
    left, right = brute_segments(s[:i]), brute_segments(s[i + n :])
    return left + [(i, i + n, total)] + [(a + i + n, b + i + n, v) for a, b, v in right]


def test_maximal_segments_by_definition():
    rng = random.Random(4)
    for _ in range(300):
        s = [rng.choice([-5, -3, -2, -1, 1, 2, 4]) + rng.random() / 100 for _ in range(rng.randrange(12))]
        got = toxicity.maximal_segments([(i, i + 1, v) for i, v in enumerate(s)])
        want = brute_segments(s)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want))


def corpus(spark, n=600):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(n):
        t = rng.choices(words, k=rng.randrange(20, 120))
        bad = i % 4 == 0
        if bad:
            for _ in range(rng.randrange(3, 6)):
                t.insert(rng.randrange(len(t)), rng.choice(["idiot", "scum"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 60 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    kept = {r.doc_id for r in toxicity.clean_documents(docs, model).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}


def test_odd_rows(spark):
    docs, labels, _ = corpus(spark, 200)
    model = toxicity.learn(docs, labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1), (3, None), (10**9, 1)], "doc_id long, toxic int")))
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "idiot scum idiot"), (4, "w1 " * 30000), (5, "w1"), (5, "w1")], "doc_id long, text string").withColumn("score", F.lit("x"))
    got = toxicity.score(odd, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert {r.predicted for r in got if r.doc_id is not None} == {0} and [r.predicted for r in got if r.doc_id is None] == [1]
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_nothing_to_learn(spark):
    docs, labels, _ = corpus(spark, 40)
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1"), labels.limit(1)):
        model = toxicity.learn(docs, some)
        assert {r.predicted for r in toxicity.score(docs, model).collect()} == {0}
        assert toxicity.clean_documents(docs, model).count() == docs.count()


def test_no_rows_to_calibrate_on(spark):
    docs, labels, _ = corpus(spark, 400)
    rows = docs.join(labels, "doc_id").where("text is not null").select("doc_id", "text", "toxic").collect()
    third = {r.text for r in docs.where(F.pmod(F.xxhash64("text"), F.lit(3)) == 0).collect()}
    known = spark.createDataFrame([(r.doc_id, r.toxic) for r in rows if r.text not in third], "doc_id long, toxic int")
    scored = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(docs, known)).collect()}
    assert all(s < 0.5 for i, s in scored.items() if i in {r.doc_id for r in rows if not r.toxic})


def test_labels_of_absent_documents_teach_nothing(spark):
    docs, labels, _ = corpus(spark, 400)
    absent = spark.range(100_000, 140_000).selectExpr("id AS doc_id", "0 AS toxic")
    both = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).unionByName(absent)
    assert toxicity.learn(docs, both, bound=2000) == toxicity.learn(docs, labels, bound=2000)


def test_stems_carry_forms_not_seen_before(spark):
    rng = random.Random(8)
    words = [f"w{i}x" for i in range(60)]
    rows, labels = [], []
    for i in range(700):
        t = rng.choices(words, k=rng.randrange(20, 80))
        bad = i % 4 == 0
        for _ in range(3 * bad):
            t.insert(rng.randrange(len(t)), "rotten" + "".join(rng.choices("abcdefghij", k=4)))
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score(docs, toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).where("held_out").collect()
    assert len(got) > 80 and sum(r.predicted == dict(labels)[r.doc_id] for r in got) / len(got) > 0.98


def test_lexicon_by_definition(spark):
    """Counts, Chernoff's test and log-odds of every key, in plain Python."""
    rng = random.Random(6)
    rows = [(" ".join(rng.choices(["idiot", "idiotic", "scum", "aaaa", "bbbb", "cccc", "dd"], [3 * bad + 0.1, 2 * bad + 0.1, bad + 0.2, 3, 3, 3, 3], k=12)), bad, i % 3 == 0) for i in range(200) for bad in [int(i % 4 == 0)]]
    rate = sum(r[1] for r in rows) / len(rows)
    want = []
    for keep in (lambda r: not r[2], lambda r: True):
        toxic, clean, before = {}, {}, {}
        every = {k for text, _, _ in rows for t in text.split() for k in toxicity.keys_of(t)}
        for text, bad, check in rows:
            if keep((text, bad, check)):
                for k in {k for t in text.split() for k in toxicity.keys_of(t)}:
                    (toxic if bad else clean)[k] = (toxic if bad else clean).get(k, 0) + 1
                if bad:
                    for b, t in zip(["", *text.split()], text.split()):
                        for k in toxicity.keys_of(t):
                            before.setdefault(k, set()).add(b)
        toxic = {k: min(v, len(before[k])) for k, v in toxic.items()}
        n1, n0 = (sum(v for k, v in c.items() if k[-1] != "*") for c in (toxic, clean))
        found = {}
        for k in every:
            y, x = toxic.get(k, 0), clean.get(k, 0)
            if not x + y:
                continue
            p = min(max(y / (x + y), 1e-12), 1 - 1e-12)
            kl = p * math.log(p / rate) + (1 - p) * math.log((1 - p) / (1 - rate))
            if (x + y) * kl >= math.log(len(every) / 0.5):
                a, a0 = max(0.1 * (x + y), 1e-9), 0.1 * (n1 + n0)
                odds = lambda c, n: math.log((c + a) / (n + a0 - c - a))
                d, e = odds(y, n1) - odds(x, n0), math.sqrt(1 / (y + a) + 1 / (x + a))
                if abs(d) > e:
                    found[k] = math.copysign(abs(d) - e, d)
        want.append(found)
    got = toxicity.lexicons(spark.createDataFrame(rows, "text string, toxic int, check boolean"), 0.1)
    for g, w in zip(got, want):
        assert g.keys() == w.keys() and all(abs(g[k] - w[k]) < 1e-9 for k in w) and w


def test_logistic_curve_is_the_best():
    rng = np.random.default_rng(2)
    x = rng.exponential(2, 400)
    y = rng.random(400) < 1 / (1 + np.exp(3 - 1.3 * x))
    slope, offset = toxicity.logistic(x, y)
    loss = lambda a, b: np.logaddexp(0, np.where(y, -1, 1) * (a * x + b)).sum()
    assert all(loss(slope, offset) <= loss(slope + da, offset + db) + 1e-3 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))
    assert abs(slope - 1.3) < 0.4 and abs(offset + 3) < 0.8


def test_extreme_value_law_against_random_walks():
    # steps +1 and -1: the root of p e^x + (1 - p) e^-x = 1 is ln((1 - p) / p)
    assert abs(toxicity.decay({}, 1.0, 100_000, [1.0] * 9_999) - math.log(10)) < 1e-6
    rng = np.random.default_rng(3)
    segments = []
    for part in rng.random((400, 500)) < 0.2:
        segments += [s for _, _, s in toxicity.maximal_segments([(i, i + 1, 1.0 if up else -1.0) for i, up in enumerate(part)])]
    n = 400 * 500
    lam, k = math.log(4), None
    for s in (3, 4, 5):
        found = sum(x >= s for x in segments) / (n * math.exp(-lam * s))
        k = k or found
        assert abs(found / k - 1) < 0.25
    _, fitted = toxicity.extreme_value_law({"a": 1.0}, 1.0, n, sorted(segments))
    assert fitted > 0
