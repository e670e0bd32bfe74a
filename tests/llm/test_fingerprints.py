import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sievelight.llm import fingerprints as fp

SF = "/root/testdata/sf0.001"


def plain_vector(text):
    """Lanes by single windows and paragraphs, in Python integers."""
    m, lanes = (1 << 64) - 1, [0] * (fp.WIDE + fp.NEAR)

    def mix(x):
        x = (x ^ (x >> 29)) * fp.GOLDEN & m
        x = (x ^ (x >> 32)) * 0xBF58476D1CE4E5B9 & m
        return x ^ (x >> 30)

    def vote(h):
        lanes[fp.WIDE + h % fp.NEAR] += 1 if h >> 63 else -1

    for p in text.split(b"\n"):
        digest = fp.xxhash.xxh3_128_digest(p)
        a, b = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")
        for k in range(fp.WIDE):
            salt = pow(fp.GOLDEN, k + 1, 1 << 64) | 1
            lanes[k] += mix((a * salt & m) ^ mix(b + salt & m))
        if 0 < len(p) < fp.WINDOW:
            vote(mix(fp.xxhash.xxh3_64_intdigest(p)))
        for i in range(len(p) - fp.WINDOW + 1):
            x, y = int.from_bytes(p[i : i + 8], "little"), int.from_bytes(p[i + 8 : i + 16], "little")
            vote(mix((x * fp.GOLDEN & m) ^ mix(y)))
    return [x & m for x in lanes[: fp.WIDE]] + [x & 0xFFFF for x in lanes[fp.WIDE :]]


def brute(rows):
    docs = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    out = []
    for k, (i, text, _) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        v, w, x = (np.array(plain_vector(t.encode()), np.uint64) for t in (text, new, after))
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), fp.written(v), fp.written(w), round(fp.likeness(v, w), 9), round(fp.likeness(v, x), 9)))
    return Counter(out)


def clashing(spark, rows):
    names = ["last", "id", "twin", "at", "halo", "n", "fingerprint", "n_chars"]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in names})


def check(spark, rows, ranges):
    hashed = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    got = Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in fp.fingerprints(clashing(spark, rows), ranges=ranges).collect())
    assert got == brute([tuple(r) for r in hashed])


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijkl éß漢", k=rng.randrange(1, 9)))
    rows = [(i, "\n".join(" ".join(word() for _ in range(rng.randrange(12))) for _ in range(rng.randrange(5)))) for i in range(40)]
    rows += [(3, "the same id, another text"), (None, "no id"), (None, None), (None, ""), (50, None), (51, ""), (52, "x"), (53, "\n"), (54, "long\n" * 3000)]
    rows += [(7, rows[7][1])] * 30 + [(None, None)] * 20 + [(60, "y")] * 25
    for ranges in (1, 3, 9):
        check(spark, rows, ranges)


def test_few_documents(spark):
    assert fp.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    check(spark, [(5, "alone in the table")], 4)
    check(spark, [(5, "one row twice")] * 2, 4)
    check(spark, [(1, None), (2, "two")], 4)


def test_sums_of_paragraphs():
    a, b = b"first paragraph of some length\nsecond", b"third, a long one after the others\n\nfourth"
    va, vb = fp.vector(a), fp.vector(b)
    assert np.array_equal(fp.added(va, vb), fp.vector(a + b"\n" + b)) and np.array_equal(fp.added(va, vb), fp.vector(b + b"\n" + a))
    assert np.array_equal(fp.removed(fp.added(va, vb), vb), va) and not np.array_equal(va, vb)
    assert np.array_equal(fp.read(fp.written(va)), va)
    assert not np.array_equal(fp.vector(b"x\nx"), fp.vector(b"x")) and not np.array_equal(fp.vector(b""), fp.vector(b"\n"))
    assert np.array_equal(fp.vector(a).tolist(), plain_vector(a))
    long = b"\n".join(b"line %d of a text that is longer than a step" % i for i in range(40_000))
    assert len(long) > fp.STEP and np.array_equal(fp.vector(long), fp.added(*(fp.vector(p) for p in (long[:1_000_000].rpartition(b"\n")[0], long[1_000_000 - len(long[:1_000_000].rpartition(b"\n")[2]) :]))))


def test_insertions_and_deletions(spark):
    texts = {1: "a paragraph\nanother one\nanother one", 2: "x", 3: "stays as it is"}
    prints = spark.createDataFrame([(i, fp.written(fp.vector(t.encode()))) for i, t in texts.items()], "doc_id long, fingerprint string")
    changes = [(1, "another one", -1), (1, "new at the end of it", 2), (2, "x", -1), (2, "y", 1), (4, "of a new document", 1), (None, "no id", 1), (3, None, 1), (3, "z", None)] + [(2, "hot", 1)] * 3000
    got = {r.doc_id: r.fingerprint for r in fp.changed(prints, spark.createDataFrame(changes, "doc_id long, paragraph string, times long")).collect()}
    want = {1: "a paragraph\nanother one\nnew at the end of it\nnew at the end of it", 2: "\n".join(["y"] + ["hot"] * 3000), 3: texts[3], 4: "of a new document", None: "no id"}
    assert got == {i: fp.written(fp.vector(t.encode())) for i, t in want.items()}


def test_likeness_follows_shared_text(spark):
    assert fp.likeness(fp.vector(b""), fp.vector(b"")) == 1.0 and 0 <= fp.likeness(fp.vector(b""), fp.vector(b"\n")) <= 1
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(3000)]
    text = lambda k: " ".join(rng.choices(words, k=k))
    base, other = text(400), text(400)
    shared = [fp.likeness(fp.vector(base.encode()), fp.vector((base[:n] + other[n:]).encode())) for n in (0, len(base) // 4, len(base) // 2, 3 * len(base) // 4, len(base))]
    assert shared[0] < 0.2 and abs(shared[1] - 0.25) < 0.2 and abs(shared[2] - 0.5) < 0.2 and abs(shared[3] - 0.75) < 0.2
    rows = fp.op11_fingerprints(spark, SF).collect()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    long = [r for r in rows if r.n_chars > 200]
    assert sum(r.near_edited for r in long) > sum(r.near_next for r in long) + 0.2 * len(long)
    same = {r.doc_id: r.fingerprint for r in rows}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len({(texts[i], p) for i, p in same.items()}) == len(set(texts.values()))
