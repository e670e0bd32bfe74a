import numpy as np

from sievelight.llm import jaccard


def brute(rows):
    """The smallest id of each component of texts whose five-word shingles have similarity 0.8 or more."""
    sets = {}
    for doc, text in rows:
        words = (text or "").lower().split()
        sets[doc] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    comp = {d: d for d in sets}
    near = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)]
    while any(comp[a] != comp[b] for a, b in near):
        for a, b in near:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return sorted(set(comp.values()))


def edited(rng, text, share):
    words = text.split()
    for k in rng.choice(len(words), max(1, int(share * len(words))), replace=False):
        words[k] = f"new{rng.integers(10**9)}"
    return " ".join(words)


def test_near_copies_by_similarity(spark):
    rng = np.random.default_rng(1)
    bases = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 300)) for _ in range(40)]
    texts = bases + [edited(rng, b, s) for b in bases for s in (0.005, 0.015, 0.02, 0.03, 0.06)]
    texts += [edited(rng, bases[0], 0.012) for _ in range(60)] + [None, "", " \n", "Two words", "two  words", "two other"]
    rows = [(int(k), t) for k, t in zip(rng.permutation(len(texts)), texts)]
    got = jaccard.first_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == brute(rows)


def test_empty_table(spark):
    assert jaccard.first_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_and_repeated_ids(spark):
    words = [" ".join(f"{k}x{i}" for i in range(60)) for k in "abcdef"]
    rows = [(None, words[0]), (None, words[1]), (None, words[1]), (None, words[2] + " end"), (1, words[2]), (2, words[3]), (2, words[4]), (2, words[2] + " more"), (3, words[5]), (3, words[5])]
    got = jaccard.first_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.columns == ["doc_id", "text"]
    want = [(None, words[0]), (None, words[1]), (1, words[2]), (2, words[3]), (2, words[4]), (3, words[5])]
    assert sorted(map(str, got.collect())) == sorted(f"Row(doc_id={d}, text={t!r})" for d, t in want)


def test_intersections_by_matrix_and_one_by_one():
    rng = np.random.default_rng(4)
    made = [[np.unique(rng.integers(0, 40_000, n, dtype=np.uint64)) for n in rng.integers(1, 600, 60)] for _ in range(2)]
    a, b = (jaccard.Sets(np.concatenate(s), np.r_[0, np.cumsum([len(x) for x in s])]) for s in made)
    x, y = (v.ravel() for v in np.meshgrid(np.arange(60), np.arange(60)))
    want = [len(set(made[0][i].tolist()) & set(made[1][j].tolist())) for i, j in zip(x, y)]
    assert a.shared(x, y, b).tolist() == want
    assert a.shared(x[:99], y[:99], b).tolist() == want[:99]


def test_blocks_of_any_size_give_the_same(spark):
    rng = np.random.default_rng(5)
    bases = [" ".join(f"w{x}" for x in rng.integers(0, 500, n)) for n in (30, 60, 61, 62, 200, 2000)]
    texts = [edited(rng, b, s) for b in bases for s in (0.001, 0.02, 0.03, 0.05) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(list(enumerate(texts)))
    for block, load in ((4096, 1 << 20), (7, 1 << 20), (16, 900)):
        assert sorted(r.doc_id for r in jaccard.first_of_each(docs, block=block, load=load).collect()) == want
