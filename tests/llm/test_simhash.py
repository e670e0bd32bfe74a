import numpy as np
import xxhash
from pyspark.sql import functions as F

from sievelight.llm import simhash


def brute(rows):
    """Fingerprints and components by definition."""
    fps = {}
    for i, (doc, text) in enumerate(rows):
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
        sh = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if bin(fps[i] ^ fps[j]).count("1") <= 4 and comp[j] < comp[i]:
                    comp[i] = comp[j]
                    changed = True
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[comp[i]] = min(least.get(comp[i], doc), doc)
    return sorted((doc, f"{fps[i]:016x}", least.get(comp[i])) for i, (doc, _) in enumerate(rows))


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(["Alpha", "beta", "gamma", "été", "x1", "the"], size=n)) for n in (2, 3, 4, 40, 60, 80)]
    rows = [(k, t) for k, t in enumerate(base * 2)] + [(50, None), (51, ""), (52, " \t\n"), (53, base[3] + " end"), (54, base[4].upper()), (55, "word " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    assert got == brute(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tiles_find_every_pair():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 700, dtype=np.uint64)
    flips = a[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    for b in (None, flips):
        got = {(int(x), int(y)) for xs, ys in simhash.tile_hits(a, b, 4) for x, y in zip(xs, ys)}
        o = a if b is None else b
        want = {(i, j) for i in range(len(a)) for j in range(len(o)) if int(a[i] ^ o[j]).bit_count() <= 4 and (b is not None or i != j)}
        assert {tuple(sorted(p)) if b is None else p for p in got} == {tuple(sorted(p)) if b is None else p for p in want}


def test_hot_group_gives_few_links():
    rng = np.random.default_rng(3)
    hot = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)))
    x, y = simhash.stars(hot, None, 4)
    assert len(x) == len(hot) - 1 and len(set(y.tolist())) == 1
