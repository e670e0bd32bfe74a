"""Each stage of the pipeline against plain Python that shares no code with it but the learned model."""

import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
import pytest

from sievelight.llm import toxicity

from .test_lines import brute as repeated_lines
from .test_toxicity import brute_segments

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(14) for _ in range(4)]
    rows = []
    for i in range(60):
        lines = [line(rng.randrange(3, 16)) for _ in range(rng.randrange(1, 9))]
        if i % 5 == 0:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(shared))
        if i % 4 == 0:
            lines += [f"{word()} vile {word()} rotten scum {word()} vile"]
        rows.append((i, "\n".join(lines), "en", f"s{i % 4}" if i % 7 else None))
    long = [word() for _ in range(120)]
    near = [*long[:60], "changed", *long[61:]]
    rows += [(100, " ".join(long), "en", "s1"), (101, " ".join(near), "en", "s2"), (None, " ".join([*long[1:], "end"]), "en", "s1")]
    rows += [(200, rows[1][1], "de", "s3"), (None, None, None, None), (None, "", "en", "s0"), (201, None, "en", "s0"), (3, "another text of the same id", "en", "s3"), (4, rows[4][1], "en", rows[4][3]), (202, "two words", "en", "s2"), (203, "Two  words", "en", "s2")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{at}/documents.parquet")
    labels = [(i, i % 2, int(i % 4 == 0)) for i in range(60)] + [(None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain_toxic(model, text):
    tokens = toxicity.TOKEN.findall((text or "").lower())
    score = lambda w: next((model.lexicon[k] for k in [w, *(w[:n] + "*" for n in range(9, 3, -1) if n < len(w))] if k in model.lexicon), -model.drift)
    found = brute_segments([score(w) for w in tokens]) if tokens else []
    excess = sum(max(0.0, model.lam * v - math.log(model.k * len(tokens))) for _, _, v in found)
    return 1 / (1 + math.exp(-(model.offset + model.slope * excess))) >= 0.5


def plain_lines(rows):
    gone = repeated_lines([(r[0], r[1]) for r in rows], 10)
    out = []
    for r in rows:
        if not r[1]:
            out.append((*r[:4], None if r[1] is None else 0))
            continue
        g, k, kept = gone[(2**65 if r[0] is None else r[0], r[1])], 0, []
        for ln in r[1].split("\n"):
            if ln.split():
                if k not in g:
                    kept.append(ln)
                k += 1
            else:
                kept.append(ln)
        if k > len(g) or not k:
            text = "\n".join(kept)
            out.append((r[0], text, *r[2:4], len(text)))
    return out


def plain_near(rows):
    order = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows}, key=str)
    sets = []
    for _, _, t in order:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    part = list(range(len(order)))
    for i in range(len(order)):
        for j in range(i):
            if sets[i] == sets[j] or sets[i] & sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = part[i], part[j]
                part = [min(a, b) if p in (a, b) else p for p in part]
    return part, order


def plain_mix(rows, labels):
    size = lambda t: len(WORD.findall(t or ""))
    quality = {}
    for i, q, _ in labels:
        if i is not None:
            quality[i] = max(quality.get(i, 0), q)
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(size(r[1]) for r in by[s]) for s in names}
    budget, capped = 1.5 * sum(total.values()), {}
    while True:  # whatever would exceed twice its size stops there
        free = [s for s in names if s not in capped]
        left = budget - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * total[s]]
        if not over:
            break
        capped |= {s: 2 * total[s] for s in over}
    out = Counter()
    for s in names:
        target = {**share, **capped}[s]
        epochs = int(target // total[s]) if total[s] else 0
        part, before = target - epochs * total[s], 0

        def key(r):
            name = "null" if r[0] is None else str(r[0])
            u = (int(hashlib.md5(f"mix:{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -math.log(u) / {1: 2.0, 0: 0.5}.get(quality.get(r[0]), 1.0)

        for r in sorted(by[s], key=lambda r: (key(r), r[0] is not None, r[0] or 0, size(r[1]))):
            n = size(r[1])
            times = epochs + int(part > 0 and before + n / 2 <= part)
            before += n
            if n and times:
                out[r[0], r[3], n] += times
    return out


def test_stages_by_plain_python(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    left = stages["toxicity"](spark, docs, folder)
    assert left.columns == columns and rows_of(left) == sorted((r for r in documents() if not plain_toxic(model, r[1])), key=str)
    docs = corpus_pipeline.materialize(left)
    before = rows_of(docs)

    docs = corpus_pipeline.materialize(stages["line dedup"](spark, docs, folder))
    after = rows_of(docs)
    assert docs.columns == columns and after == sorted(plain_lines(before), key=str) and after != before

    part, order = plain_near(after)
    docs = corpus_pipeline.materialize(stages["simhash near-dedup"](spark, docs, folder))
    kept = rows_of(docs)
    assert docs.columns == columns and len(kept) == len(set(part)) < len(after) and set(kept) <= set(after)
    places = [order.index((r[0] is None, r[0] or 0, r[1])) for r in kept]
    assert sorted(part[p] for p in places) == sorted(set(part))
    assert all(order[p][:2] == min(order[q][:2] for q in range(len(order)) if part[q] == part[p]) for p in places)

    docs = corpus_pipeline.materialize(stages["mixing"](spark, docs, folder))
    mixed = rows_of(docs)
    assert docs.columns == columns and set(mixed) <= set(kept)
    assert Counter((r[0], r[3], len(WORD.findall(r[1]))) for r in mixed) == plain_mix(kept, labels)

    out = stages["sentencepiece"](spark, docs, folder).collect()
    assert all(r.decoded for r in out) and Counter(r.doc_id for r in out) == Counter(r[0] for r in mixed for _ in range(2))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = corpus_pipeline.clean(spark, docs, SF)
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    gone = {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in left.select("doc_id").collect()}
    labelled = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert gone & labelled <= toxic
    assert corpus_pipeline.run(spark, SF).where("not decoded").count() == 0
