import random

import pytest
from pyspark.sql import functions as F

from sievelight.functions import hashing, vectors
from sievelight.operators import eligibility, evaluation, history, refs, tasks, units
from sievelight.sources import pdf, prepare, scan, stores


def table_lcs(a, b):
    """Pairs by the table of lengths, for comparison."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_common_subsequences():
    rng = random.Random(1)
    for _ in range(400):
        a, b = (rng.choices("abcd", k=rng.randrange(14)) for _ in range(2))
        assert units.lcs_pairs(a, b) == table_lcs(a, b)


def test_units_are_paired_between_anchors(spark):
    rows = lambda fs: spark.createDataFrame([(1, i, f"u{i}", f) for i, f in enumerate(fs)], "doc int, ord int, unit string, fingerprint string")
    got = {(r.old_unit, r.new_unit, r.state) for r in units.map_units(rows("abcde"), rows("axyde")).collect()}
    assert got == {("u0", "u0", "unchanged"), ("u1", "u1", "changed"), ("u2", "u2", "changed"), ("u3", "u3", "unchanged"), ("u4", "u4", "unchanged")}
    got = {(r.old_unit, r.new_unit, r.state) for r in units.map_units(rows("abe"), rows("axyze")).collect()}
    assert got == {("u0", "u0", "unchanged"), ("u1", "u1", "changed"), (None, "u2", "added"), (None, "u3", "added"), ("u2", "u4", "unchanged")}
    rates = units.change_rates(units.map_units(rows("abe"), rows("axyze"))).first()
    assert (rates.changed, rates.added, rates.removed, rates.change_rate) == (1, 2, 0, 3 / 5)


def test_canonical_introductions_in_a_graph(spark):
    rng = random.Random(2)
    edges = [(f"c{i:03d}", f"c{p:03d}") for i in range(1, 60) for p in {rng.randrange(max(0, i - 6), i) for _ in range(2)}]
    parents = spark.createDataFrame([(a, b, 0) for a, b in edges], "commit_hash string, parent string, ord int")
    intro = {(k, f"c{rng.randrange(60):03d}") for k in range(200) for _ in range(rng.randrange(1, 6))}
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    above = {}
    for i in range(60):
        c = f"c{i:03d}"
        above[c] = set().union(*({p} | above[p] for p in up.get(c, ())))
    want = {k: min(c for j, c in intro if j == k and not any((k, x) in intro for x in above[c])) for k, _ in intro}
    got = history.canonical_introduction(spark.createDataFrame([(c, k) for k, c in intro], "commit_hash string, k int"), parents, ["k"])
    assert {r.k: r.commit_hash for r in got.collect()} == want
    with pytest.raises(ValueError):
        history.canonical_introduction(got.select("commit_hash", "k"), parents, ["k"], most=10)


def test_folders_decide_for_what_is_in_them(spark, tmp_path):
    for name in ("a.md", "tmp/b.md", "sub/tmp/c.md", "sub/id_rsa/known", "sub/keep.md", "sub/x.pem", "my_token.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    rows = {r.relative: r for r in scan.scan_folder(spark, str(tmp_path), ["tmp/", "sub/k*", "!sub/tmp/c.md"], recursive=True).collect()}
    assert {k for k, r in rows.items() if r.ignored} == {"tmp/b.md", "sub/tmp/c.md", "sub/keep.md"}
    assert {k: r.secret_tier for k, r in rows.items() if r.secret_tier} == {"sub/id_rsa/known": "A", "sub/x.pem": "A", "my_token.md": "B"}


def test_text_is_told_by_all_bytes():
    assert prepare.looks_like_text(b"a" * 10_000 + "é".encode())
    assert not prepare.looks_like_text(b"a" * 10_000 + b"\0") and not prepare.looks_like_text(b"a" * 10_000 + b"\xff")
    assert not prepare.looks_like_text(b"\x01\x02" * 50) and not prepare.looks_like_text(b"")


def test_pdf_limits_are_errors(monkeypatch):
    pages = b"".join(b"%d 0 obj\n<< /Type /Page /Parent 2 0 R >>\nendobj\n" % i for i in range(3, 6))
    data = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R 4 0 R 5 0 R] >>\nendobj\n" + pages
    assert len(pdf.pdf_pages(data)) == 3
    monkeypatch.setattr(pdf, "MOST_PAGES", 2)
    with pytest.raises(ValueError):
        pdf.pdf_pages(data)
    with pytest.raises(ValueError):
        pdf.Pdf(b"%PDF-1.4").stream(b"<< /Filter /LZWDecode >>\nstream\nxx\nendstream")


def test_passages_that_texts_hold(spark):
    texts = [(1, "one two three"), (2, '"one two'), (3, None), (4, ""), (5, "xone twox, and three")]
    passages = [(10, "one two"), (11, "three"), (12, ""), (13, None), (14, "one two"), (15, "e")]
    t, p = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(passages, "query_id long, passage string")
    want = {(d, q) for d, x in texts for q, y in passages if x and y and y in x}
    assert {tuple(r) for r in evaluation.containing(t, p).collect()} == want == {tuple(r) for r in evaluation.containing(t, p, block_chars=8).collect()}
    assert evaluation.containing(t, p.limit(0)).count() == 0


def test_nearest_in_blocks(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(100, [0.0, 0.0, 0.0]), (200, None)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    whole, parts = ({tuple(r) for r in evaluation.nearest(df, F.col("id") % 10 == 0, 3, block=b).collect()} for b in (4096, 13))
    assert whole == parts and len(whole) == 18 and not any(a == b for a, b, _ in whole)


def test_logs_are_rewritten_whole(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "k int, v string"
    for part in ([(1, "a"), (2, None)], [(1, "b")]):
        stores.append_log(spark.createDataFrame(part, schema), path)
    assert stores.rewrite_log(spark, path, schema, F.col("k") == 1) == 1
    assert sorted(map(tuple, stores.read_log(spark, path, schema).collect())) == [(1, "a"), (1, "b")]


def test_vectors_as_bytes(spark):
    rows = [(1, [1.5, -2.0]), (2, []), (3, None), (4, [float("nan")]), (5, [1.0, None])]
    df = spark.createDataFrame(rows, "k int, v array<float>").withColumn("b", vectors.encoded("v"))
    assert {r.k: r.b and bytes(r.b) for r in df.collect()} == {1: b"\x00\x00\xc0?\x00\x00\x00\xc0", 2: b"", 3: None, 4: None, 5: None}
    back = df.select("k", vectors.decoded("b").alias("v")).where("k < 3").collect()
    assert [r.v for r in sorted(back)] == [[1.5, -2.0], []]


def test_requests_in_two_phases(spark):
    held = spark.createDataFrame([("a", 0), ("b", 3)], "idempotency_key string, state int")
    wanted = spark.createDataFrame([("a", 1.0, 5), ("b", 2.0, 6), ("b", 9.0, 4), ("c", 3.0, 7)], "idempotency_key string, estimated_usd double, created_at int")
    assert sorted(map(tuple, tasks.reserve(held, wanted).collect())) == [("b", 9.0, 4, 0), ("c", 3.0, 7, 0)]
    outcomes = spark.createDataFrame([("a", "done", 2.0)], "idempotency_key string, outcome string, usd double")
    assert {(r.idempotency_key, r.next, r.cost_usd) for r in tasks.settle(held, outcomes).collect()} == {("a", 0, None), ("b", 3, 0.0)}


def test_reports_refuse_gaps(spark):
    rows = [(1, m, "measured", 5, None) for m in evaluation.MEASURES]
    schema = "report_id int, measure string, state string, value long, reason string"
    assert evaluation.assessments(spark.createDataFrame(rows, schema)).first().cost_ratio == 1.0
    with pytest.raises(Exception, match="missing"):
        evaluation.assessments(spark.createDataFrame([(1, "baseline_ttfv_ms", "blocked", None, " ")], schema)).collect()


def test_tags_fold_case(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    tags, commits = one([("Release", "c1")], "name string, commit_hash string"), one([("c1",), ("c2",)], "commit_hash string")
    got = {r.name: (r.commit_hash, r.fault) for r in refs.tag(one([("release", None), ("New", "c1"), ("Head", None), ("x/y", None), ("z", "c9")], "name string, commit string"), tags, commits, "c2").collect()}
    assert got == {"release": (None, "exists"), "New": ("c1", None), "Head": (None, "reserved"), "x/y": (None, "path"), "z": (None, "commit_missing")}
    found = {r.operand: (r.commit_hash, r.fault) for r in refs.resolve(one([("RELEASE",), ("HEAD",), ("none",)], "operand string"), tags, commits, "c2").collect()}
    assert found == {"RELEASE": ("c1", None), "HEAD": ("c2", None), "none": (None, "not_found")}


def test_input_hash_is_of_nfc(spark):
    df = spark.createDataFrame([("é",), ("é",), (None,)], "q string")
    got = [r[0] for r in df.select(hashing.input_hash("q")).collect()]
    assert got[0] == got[1] == hashing.hash_bytes("é".encode()) and got[2] is None


def test_pinned_chunks_are_counted_without_pairs(spark):
    ddl = "raw_hash string, tool_profile_hash string, gen long, manifest_hash string"
    chunks = spark.createDataFrame([(f"h{i % 3}" if i % 7 else None, "t", i % 2, "m") for i in range(600)], ddl)
    entries = spark.createDataFrame([(f"h{i % 4}" if i % 5 else None, "t", i % 2, "m" if i % 3 else "n", i) for i in range(400)], ddl + ", path long")
    for c, e in ((chunks, entries), (chunks.drop("manifest_hash"), entries)):
        want = {r.path: r["count"] for r in eligibility.live_chunks(c, e).groupBy("path").count().collect()}
        got = eligibility.live_counts(c, e)
        assert want and {r.path: r.chunks for r in got.collect()} == want and got.count() == len(want)
