import math
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from sievelight.llm import segmentation as sg
from sievelight.llm import tokens

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL))
DATA = tokens.model_bytes()
OWN = sg.Lattices(DATA, 1.0)


def brute(text):
    """Every segmentation of a text with its probability, by listing all."""
    s = "▁" + text.replace(" ", "▁")

    def paths(i):
        if i == len(s):
            return [((), 1.0)]
        out = []
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in OWN.weight:
                p, w = OWN.weight[s[i:j]]
                out += [((p, *q), w * v) for q, v in paths(j)]
        if s[i] not in OWN.weight:
            raw = s[i].encode()
            out += [((*[OWN.byte[b] for b in raw], *q), OWN.byte_weight ** len(raw) * v) for q, v in paths(i + 1)]
        return out

    found = paths(0)
    total = sum(v for _, v in found)
    return {q: v / total for q, v in found}


def draw(text, seed, k, own=OWN):
    (paths, left), = sg.sample_batch(own, [own.encode(text)], [seed], k)
    return [(tuple(own.store["piece"][p.options].tolist()), float(own.store["log"][p.options].sum()), p.value) for p in paths], left


def test_probabilities_by_definition():
    for text in ("low", "a b", "new ab", "é日"):
        truth = brute(text)
        got, left = draw(text, 3, len(truth) + 5)
        assert len(got) == len(truth) and left == -math.inf
        for q, log, _ in got:
            assert abs(truth[q] - math.exp(log)) < 1e-9
        values = [v for _, _, v in got]
        assert values == sorted(values, reverse=True)


def test_without_replacement_law():
    """Pairs are drawn with the probability of successive draws without replacement."""
    truth = brute("ab c")
    n = 6000
    pairs = Counter()
    for seed in range(n):
        got, _ = draw("ab c", seed * 7919 + 13, 2)
        pairs[got[0][0], got[1][0]] += 1
    for (a, b), c in pairs.most_common(6):
        want = truth[a] * truth[b] / (1 - truth[a])
        assert abs(c / n - want) < 4 * math.sqrt(want / n) + 1e-3
    # values of the first draw follow a Gumbel law, those of inclusion match how often a path is among the first two
    some = max(truth, key=truth.get)
    rate, score = 0.0, 0.0
    for seed in range(2000):
        got, left = draw("ab c", seed * 104729 + 5, 2)
        rate += some in [q for q, _, _ in got]
        score += sum(truth[q] / math.exp(sg.log_inclusion(math.log(truth[q]), left)) for q, _, _ in got)
    assert abs(score / 2000 - 1) < 0.1  # the inclusion scores make an unbiased estimate of the whole mass


def test_prefix_of_texts_and_bytes():
    texts = ["hello world", " lead", "tab\tnew\nline", "日本 🙂", "x" * 300, "a" * 5000, "unbelievable " * 200]
    for t in texts:
        for q, _, _ in draw(t, 11, 3)[0]:
            assert OWN.decode(np.array(q, dtype=np.int64)) == t == SP.decode(list(q))


def test_query(spark):
    rows = [(2, None), (1, "the same text here"), (1, "the same text here"), (3, ""), (4, "ünïcode ▁ x"), (None, "no id"), (5, "long text of words " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pieces", F.lit("clash"))
    got = sg.segmentations(docs, k=3, pieces=True).collect()
    assert all(r.decoded for r in got)
    by = Counter((r.doc_id) for r in got)
    assert by == {1: 6, 2: 1, 3: 1, 4: 3, None: 3, 5: 3}
    assert len({tuple(r.pieces) for r in got if r.doc_id == 1}) == 3
    assert all(0 >= r.log_inclusion for r in got)
    again = sg.segmentations(docs.repartition(3), k=3).collect()
    key = lambda r: (str(r.doc_id), r.sample, r.pieces_hash, r.perturbed)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sg.segmentations(docs.limit(0)).count() == 0


def unigram():
    """A small model with piece probabilities of its own."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(DATA)
    proto.trainer_spec.model_type = 1
    kept = [p for p in proto.pieces if p.type != 1]
    del proto.pieces[:]
    proto.pieces.extend(kept)
    for piece, p in {"▁": 0.2, "a": 0.15, "b": 0.1, "ab": 0.2, "▁a": 0.1, "ba": 0.05, "▁ab": 0.1, "aba": 0.1}.items():
        proto.pieces.add(piece=piece, score=math.log(p), type=1)
    return sg.Lattices(proto.SerializeToString(), 1.0)


def test_a_unigram_model_keeps_its_probabilities():
    own = unigram()
    weight = {p: w for p, (_, w) in own.weight.items()}
    assert all(abs(weight[p] - v) < 1e-6 for p, v in {"▁": 0.2, "ab": 0.2, "aba": 0.1, "ba": 0.05}.items())

    def paths(s):
        return [((), 1.0)] if not s else [((s[:j], *q), weight[s[:j]] * v) for j in range(1, len(s) + 1) if s[:j] in weight for q, v in paths(s[j:])]

    found = paths("▁abab▁ab")
    total = sum(v for _, v in found)
    truth = Counter()
    for q, v in found:
        truth[tuple(own.weight[x][0] for x in q)] = v / total
    got, left = draw("abab ab", 5, len(truth) + 1, own)
    assert len(got) == len(truth) > 20 and left == -math.inf
    assert all(abs(truth[q] - math.exp(log)) < 1e-6 for q, log, _ in got)


def test_inclusion_scores_weigh_samples_without_bias():
    """The sum of p / inclusion over k draws without replacement is 1 on average, and so is any share of it."""
    own, n, k = unigram(), 3000, 4
    whole = first = exact = 0.0
    for seed in range(n):
        got, left = draw("abab", seed, k, own)
        for q, log, _ in got:
            share = math.exp(log - sg.log_inclusion(log, left))
            whole += share / n
            first += share / n * (own.raw[q[0]] == "▁a".encode())
    got, _ = draw("abab", 0, 10_000, own)
    exact = sum(math.exp(log) for q, log, _ in got if own.raw[q[0]] == "▁a".encode())
    assert abs(whole - 1) < 0.03 and abs(first - exact) < 0.03
