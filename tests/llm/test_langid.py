import math
import random

import numpy as np
from pyspark.sql import functions as F

from sievelight.llm import langid

TEXTS = {"en": "the cat and the dog were in the house with thing and other ", "de": "der hund und die katze waren nicht über dem haus gewesen ", "fr": "le chat et le chien étaient dans la maison avec les autres "}


def corpus(spark, n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = list(TEXTS)[i % 3]
        words = TEXTS[lang].split()
        rows.append((i, " ".join(rng.choices(words, k=rng.randrange(4, 40))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), {r[0]: r[2] for r in rows}


def test_held_out_accuracy(spark):
    docs, truth = corpus(spark)
    got = [r for r in langid.identify(docs).collect() if r.held_out]
    assert len(got) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def tree(train):
    """The tree of the texts by language."""
    lang, code, n = [], [], []
    for k, texts in enumerate(train.values()):
        c, m = np.unique(np.concatenate([langid.codes_of(langid.PAD + t.encode()) for t in texts]), return_counts=True)
        lang += [k] * len(c)
        code += c.tolist()
        n += m.tolist()
    return langid.build(list(train), np.array(lang), np.array(code, dtype=np.uint64), np.array(n, dtype=float))


def brute_bits(train, text):
    """PPM with escape C and exclusion, straight from the definition."""
    order = langid.ORDER
    b, out = langid.PAD + text.encode(), 0.0
    t = [langid.PAD + x.encode() for x in train]

    def p(context, byte, k):
        if k < 0:
            return 1 / 256
        c = {}
        for x in t:
            for i in range(order, len(x)):
                if x[i - k : i] == context[len(context) - k :]:
                    c[x[i]] = c.get(x[i], 0) + 1
        n, d = sum(c.values()), len(c)
        if not n:
            return p(context, byte, k - 1)
        if byte in c:
            return c[byte] / (n + d)
        return d / (n + d) * p(context, byte, k - 1) / (1 - sum(p(context, x, k - 1) for x in c))

    for i in range(order, len(b)):
        out -= math.log2(p(b[i - order : i], b[i], order))
    return out


def test_code_lengths_by_definition():
    train = {"xx": ["abracadabra abracadabra", "banana bandana cabana", "abc abc abd"], "yy": ["zebra zebu zeta", "über öde äpfel"], "zz": ["zz"]}
    texts = ["abracadabra", "banzai", "zz", "é", "a" * 9, "", "zebras über"]
    got = langid.code_lengths(tree(train), [t.encode() for t in texts])
    want = [[brute_bits(train[k], t) for k in train] for t in texts]
    assert np.allclose(got, want, rtol=1e-4), (got, want)


def test_paths_are_found():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, 1 << 48, 5000, dtype=np.uint64))
    rows = langid.Rows(codes, np.arange(len(codes))[:, None])
    at = rows.find(codes)
    assert (at >= 0).all() and (rows.values[at, 0] == np.arange(len(codes))).all()
    assert (rows.find(codes + np.uint64(1 << 50)) == -1).all()


def test_every_script_keeps_its_bytes():
    train = {k: ["".join(chr(start + i % 90) for i in range(j, j + 400)) for j in range(5)] for k, start in {"ar": 0x627, "hi": 0x905, "ko": 0xAC00, "zh": 0x4E00}.items()}
    bits = langid.code_lengths(tree(train), [t[0][:60].encode() for t in train.values()])
    assert bits.argmin(axis=1).tolist() == [0, 1, 2, 3]


def test_long_texts_are_cut_without_loss():
    model = tree({"xx": ["abracadabra banana"] * 3})
    text = b"abracadabra banana " * 3000
    whole = langid.code_lengths(model, [text])
    step, langid.STEP = langid.STEP, 1000
    try:
        assert np.allclose(whole, langid.code_lengths(model, [text]))
    finally:
        langid.STEP = step


def test_odd_rows(spark):
    docs, _ = corpus(spark, 90)
    model = langid.learn(docs.unionByName(spark.createDataFrame([(None, "x", "en"), (7, None, "en"), (8, "y", None)], docs.schema)))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (None, "der hund"), (5, "the " * 40000), (5, "the " * 40000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(odd, model).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (None, "de"), (5, "en")}
    none = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_many_languages_in_bounded_room(spark):
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(30):
        words = ["".join(rng.choices(letters, k=rng.randrange(2, 8))) for _ in range(60)]
        rows += [(1000 * k + i, " ".join(rng.choices(words, k=60)), f"l{k:02d}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, cells=1 << 22)
    assert all(p.values.size <= 1.5 * (1 << 22) for p in model.paths)
    assert len(model.paths[-1].codes) < len(langid.learn(docs).paths[-1].codes)
    named = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.predict(docs, model).collect()
    assert sum(r.lang_pred == named[r.doc_id] for r in got) > 0.98 * len(got)
    long = docs.limit(1).withColumn("text", F.repeat("text", 5000))
    assert langid.learn(docs.unionByName(long), cells=1 << 22).langs == model.langs
