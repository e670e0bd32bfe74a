import random

from pyspark.sql import functions as F

from sievelight.llm import lines


def brute(rows, least):
    """Delete every line of a run of enough words that starts earlier in the corpus too."""
    docs = sorted({(2**65 if d is None else d, t) for d, t in rows if t}, key=lambda x: x[0])
    seqs = {x: [ln for ln in x[1].split("\n") if ln.split()] for x in docs}
    gone = {x: set() for x in docs}
    for a, x in enumerate(docs):
        for y in docs[: a + 1]:
            for s in range(len(seqs[x])):
                for p in range(len(seqs[y])):
                    if x == y and p >= s:
                        break
                    n = 0
                    while s + n < len(seqs[x]) and p + n < len(seqs[y]) and seqs[x][s + n] == seqs[y][p + n]:
                        n += 1
                    if sum(len(ln.split()) for ln in seqs[x][s : s + n]) >= least:
                        gone[x].update(range(s, s + n))
    return gone


def check(spark, rows, least):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.lines, r.kept_lines) for r in lines.deduplicated(docs, min_words=least).collect()), key=str)
    gone, want = brute(rows, least), []
    for d, t in rows:
        if not t:
            want.append((d, t, 0, 0))
            continue
        g, k, out = gone[(2**65 if d is None else d, t)], 0, []
        for ln in t.split("\n"):
            if ln.split():
                if k not in g:
                    out.append(ln)
                k += 1
            else:
                out.append(ln)
        want.append((d, "\n".join(out), k, k - len(g)))
    assert got == sorted(want, key=str)


def test_against_brute_force(spark):
    rng = random.Random(6)
    some = ["a", "b b", "c c c", "d d d d", "e e e e e e e", ""]
    rows = [(i, "\n".join(rng.choices(some, k=rng.randrange(1, 14)))) for i in range(14)]
    rows += [(20, rows[0][1]), (21, "a\n" * 40), (22, "x\n" + rows[3][1] + "\ny"), (23, None), (24, ""), (25, " \n\n"), (None, rows[5][1]), (2**63 - 1, rows[5][1] + "\nz"), (0, None), (2, rows[2][1])]
    check(spark, rows, 6)
    check(spark, rows, 1)


def test_short_lines_stay_alone(spark):
    rows = [(1, "yes\nno\nlong line of many words here"), (2, "yes\nother"), (3, "yes\nno\nmaybe"), (4, "x\nyes\nno\nlong line of many words here\nz")]
    got = {r.doc_id: r.text for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), min_words=8).collect()}
    assert got[2] == "yes\nother" and got[3] == "yes\nno\nmaybe" and got[4] == "x\nz"


def test_nothing_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string").withColumn("i", F.lit("clash")).withColumn("r", F.lit(1))
    assert lines.deduplicated(docs, min_words=1).collect()[0].text == "one two three"
    assert lines.deduplicated(docs.limit(0)).count() == 0


def test_kept_documents(spark):
    rows = [(1, "one two three\nfour", 5), (2, "one two three", 5), (3, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.n_chars for r in lines.kept_documents(docs, min_words=3).collect()}
    assert got == {1: 18, 3: 0}


def test_maximal_runs_by_definition(spark):
    rng = random.Random(9)
    some = ["a", "b b", "c c c", "d d d d"]
    rows = [(i, "\n".join(rng.choices(some, k=rng.randrange(1, 18)))) for i in range(9)] + [(30, "q\nr\ns\nt\nu\nv\nw"), (31, "x\nq\nr\ns\nt\nu\nv\ny"), (32, "q\nr\ns\n" + "z\n" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seqs = {d: [ln for ln in t.split("\n") if ln.split()] for d, t in rows}
    at = lambda d, i: seqs[d][i] if 0 <= i < len(seqs[d]) else None
    words = lambda d, i, n: sum(len(x.split()) for x in seqs[d][i : i + n])
    for least in (1, 7):
        got = {(r.doc, r.i, r.n, r.first.doc, r.first.i) for r in lines.maximal_runs(docs, min_words=least).collect()}
        gone = {}
        for d, i, n, e, j in got:
            assert (e, j) < (d, i) and words(d, i, n) >= least
            assert seqs[d][i : i + n] == seqs[e][j : j + n] and (at(d, i + n) is None or at(d, i + n) != at(e, j + n))
            assert not any(seqs[x][y : y + n] == seqs[d][i : i + n] for x in seqs for y in range(len(seqs[x])) if (x, y) < (e, j))
            gone.setdefault(d, set()).update(range(i, i + n))
        want = brute(rows, least)
        assert {k: v for k, v in gone.items() if v} == {k[0]: v for k, v in want.items() if v}
        assert least > 6 or (31, 1, 6, 30, 0) in got
    assert lines.maximal_runs(docs.limit(0)).count() == 0


def test_short_lines_repeat_but_no_run_is_long_enough(spark):
    for rows in ([(0, "a b"), (1, "a b")], [(0, "a b\nc d"), (1, "c d\na b"), (2, None), (3, "a b")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted((r.doc_id, r.text, r.lines == r.kept_lines) for r in lines.deduplicated(docs).collect()) == [(i, t, True) for i, t in rows]
        assert sorted(map(tuple, lines.kept_documents(docs).collect())) == rows
