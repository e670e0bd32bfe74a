import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import collocations as c


def brute(rows, least, top, inside=80, factor=2_000_000):
    """By lists of words and Python integers."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    gone = set()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= inside * f[lang, p[i : i + k]]:
                    gone.add((lang, p[i : i + k]))
    rows = []
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            score, k = min((factor * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            rows.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out, place = [], Counter()
    for lang, score, a, p, left, right in sorted(rows):
        place[lang] += 1
        if place[lang] <= top:
            out.append((lang, place[lang], p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)] + ["Über", "X\x01", "x", "漢字", "the", "THE"]
    line = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ". "]) for _ in range(rng.randrange(30)))
    rows = [(line(), rng.choice(["en", "de", None, "und"])) for _ in range(120)]
    rows += [("new york city hall", "en")] * 40 + [("new york", "en")] * 4 + [("a a a a a a", "en")] * 3
    rows += [(None, "en"), ("", None), ("...", "fr"), ("one two " * 4000, "long"), ("same row", "hot")] * 2 + [("very common words of a hot row", "hot")] * 400
    return rows


@pytest.mark.parametrize("options", [{}, {"most_words": 0}, {"per_range": 900, "block": 500}, {"most_words": 0, "per_range": 2000, "block": 1000}])
def test_against_brute_force(spark, options):
    rows = corpus()
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({k: F.lit("clash") for k in ("hi", "lo", "a", "word", "id", "rank", "size")})
    for least, top in ((3, 50), (30, 5)):
        assert sorted(map(tuple, c.collocations(df, least=least, top=top, **options).collect())) == brute(rows, least, top)


def test_nothing_frequent(spark):
    assert c.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert c.collocations(spark.createDataFrame([("one two three", "en"), (None, None)], "text string, lang string")).count() == 0


def test_large_products_are_exact(spark):
    phrases = spark.createDataFrame([((1 << 32) | 2, 0, 6_000_000_000_000_001, 2)], "hi long, lo long, a long, size int")
    words = spark.createDataFrame([("en", "x", 9_000_000_000_000_001, 1), ("en", "y", 6_500_000_000_000_003, 2)], "lang string, word string, f long, id long")
    got = c.scored(phrases, words, 2_000_000).first()
    assert (got.l, got.r) == (9_000_000_000_000_001, 6_500_000_000_000_003) and got.score == 2_000_000 * 6_000_000_000_000_001 // 15_500_000_000_000_004


def test_keys():
    rng = np.random.default_rng(0)
    hi, lo = rng.integers(0, 1 << 62, 5000), rng.integers(0, 1 << 62, 5000)
    hi[::3], lo[::5] = hi[0], lo[0]
    assert np.array_equal(c.radix_order(hi, lo), np.lexsort((lo, hi)))
    h, low, n = c.summed(hi, lo, np.ones(5000, np.int64))
    assert Counter(zip(hi.tolist(), lo.tolist())) == dict(zip(zip(h.tolist(), low.tolist()), n.tolist()))
    assert all(np.array_equal(a, b) for a, b in zip(c.unpacked(c.packed(h, low, n)), (h, low, n)))
    assert c.keys_at(np.array([1, 2, 3, 0, 4, 5]))[0].tolist() == [(1 << 32) | 2, (2 << 32) | 3, (4 << 32) | 5]
