import pytest
from pyspark.sql import functions as F

from sievelight.operators import evaluation, evidence, history, ledger, lifecycle, units
from sievelight.sources import restore, scan, sheets, stores

NOW = 1_700_000_000


def parents(spark, edges):
    return spark.createDataFrame([(a, b, o) for a, b, o in edges], "commit_hash string, parent string, ord int")


def test_walks(spark):
    p = parents(spark, [("d", "b", 0), ("d", "c", 1), ("b", "a", 0), ("c", "a", 0)] + [(f"x{i:03d}", f"x{i - 1:03d}", 0) for i in range(1, 301)])
    starts = spark.createDataFrame([("d",), ("x300",), ("lone",)], "commit_hash string")
    got = {(r.start, r.commit_hash): r.depth for r in history.reachable(starts, p).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "d"} == {"d": 0, "b": 1, "c": 1, "a": 2}
    assert got["x300", "x000"] == 300 and got["lone", "lone"] == 0
    first = {r.commit_hash for r in history.reachable(starts, p, first_parent=True).where("start = 'd'").collect()}
    assert first == {"d", "b", "a"}
    with pytest.raises(Exception, match="more than 2"):
        history.reachable(starts, p, most=2).count()


def test_history_rules(spark):
    p = parents(spark, [("c2", "c1", 0), ("c3", "c2", 0)])
    e = spark.createDataFrame([("c1", "a", "1"), ("c1", "b", "2"), ("c2", "a", "1"), ("c3", "a", "3"), ("c3", "b", "2")], "commit_hash string, path string, raw_hash string")
    key = ["path", "raw_hash"]
    intro = history.introductions(e, p, key)
    assert {tuple(r) for r in intro.select("commit_hash", *key).collect()} == {("c1", "a", "1"), ("c1", "b", "2"), ("c3", "a", "3"), ("c3", "b", "2")}
    canon = {tuple(r) for r in history.canonical_introduction(intro, p, key).select(*key, "commit_hash").collect()}
    assert canon == {("a", "1", "c1"), ("b", "2", "c1"), ("a", "3", "c3")}
    chain = history.reachable(spark.createDataFrame([("c2",)], "commit_hash string"), p, first_parent=True)
    live = e.where("commit_hash = 'c2'")
    gone = history.final_deleted(chain, e, live)
    assert [(r.path, r.raw_hash) for r in gone.collect()] == [("b", "2")]
    both = history.include_deleted(live.select(*key), gone.select(*key), ["raw_hash"])
    assert {tuple(r) for r in both.collect()} == {("a", "1"), ("b", "2")}
    with pytest.raises(ValueError):
        history.present(history.reachable(spark.createDataFrame([("zz",)], "commit_hash string"), p), e)


def test_retention(spark):
    day = 86_400
    rows = [("tip", "auto", NOW - 1, "t0"), ("new", "auto", NOW - 100, "t1"), ("future", "auto", NOW + 5, "t2"), ("h1", "auto", NOW - 2 * day, "t3"), ("h2", "auto", NOW - 2 * day - 1, "t4"), ("old", "auto", NOW - 400 * day, "t5"), ("shared", "auto", NOW - 400 * day, "t1"), ("man", "manual", NOW - 400 * day, "t6"), ("lost", "auto", NOW, "t7"), ("done", "auto", NOW - 400 * day, "t8")]
    rows += [(f"rep{i}", "repaired", NOW - 400 * day - i, f"r{i}") for i in range(7)]
    commits = spark.createDataFrame(rows, "commit_hash string, commit_type string, t long, tree_hash string")
    reached = commits.where("commit_hash <> 'lost'").select(F.lit("tip").alias("start"), "commit_hash")
    refs = spark.createDataFrame([("heads/main", "tip")], "name string, commit_hash string")
    receipts = spark.createDataFrame([("done",)], "commit_hash string")
    plan = {r.commit_hash: r.fate for r in lifecycle.retention_plan(commits, reached, refs, receipts, NOW).collect()}
    same_hour = (NOW - 2 * day) // 3600 == (NOW - 2 * day - 1) // 3600
    assert plan["tip"] == "ref_tip" and plan["new"] == "retained_recent" and plan["future"] == "future_timestamp"
    assert plan["h1"] == "retained_hourly" and plan["h2"] == ("candidate" if same_hour else "retained_hourly")
    assert plan["old"] == "candidate" and plan["shared"] == "shared_tree_non_shallow" and plan["man"] == "protected_commit_type"
    assert plan["lost"] == "unreachable_commit" and plan["done"] == "already_shallow"
    assert [plan[f"rep{i}"] for i in range(7)] == ["retained_repaired"] * 5 + ["candidate"] * 2


def test_last_event_and_budget(spark):
    ev = lambda rows: spark.createDataFrame(rows, "raw_hash string, epoch int, event string")
    got = {r.raw_hash: r.event for r in lifecycle.final_events(ev([("a", 1, "purged"), ("b", 2, "purged")]), ev([("a", 1, "retired"), ("b", 3, "retired")])).collect()}
    assert got == {"a": "purged", "b": "retired"}
    c = spark.createDataFrame([(0.0, 50.0), (1.0, 49.0), (0.5, 49.0), (1.0, None)], "usd double, total double")
    assert [r[0] for r in c.select(ledger.admission(F.col("total"), F.col("usd"), F.lit(50.0))).collect()] == [True, False, True, None]
    q = spark.createDataFrame([(i, "prune" if i < 200 else "poll", i, False) for i in range(260)], "id int, kind string, ord int, own boolean")
    kinds = ledger.sweep_quota(q).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in kinds} == {"prune": 196, "poll": 60}


def test_evaluation(spark):
    e = spark.createDataFrame([("q", "a", "s", None), ("q", "", "s", None), ("z", "b", "s", "p")], "query_id string, raw_hash string, section string, path string")
    r = spark.createDataFrame([("q", "a", "s", None, 1), ("q", "", "s", None, 2), ("z", "b", "s", "p", 3), ("y", "c", "s", "p", 1)], "query_id string, raw_hash string, section string, path string, rank int")
    assert {x.query_id: x.recall for x in evaluation.recall_at_k(e, r, 2).collect()} == {"q": 0.5, "z": 0.0, "y": 0.0}
    v = spark.createDataFrame([("a", float(x)) for x in (5, 1, 3, 2, 4)] + [("b", None)], "k string, v double")
    assert [x.percentile for x in evaluation.percentile_disc(v, ["k"], "v", 0.95).collect()] == [5.0]
    assert {x.k: x.m for x in v.groupBy("k").agg(evaluation.nearest_rank(F.col("v"), 0.5).alias("m")).collect()} == {"a": 3.0, "b": None}
    t = spark.createDataFrame([("abc", "xxabdxx"), ("", "y"), ("abc", "")], "a string, b string")
    assert [round(x[0], 3) for x in t.select(evaluation.character_error_rate(F.col("a"), F.col("b"))).collect()] == [0.333, 0.0, 1.0]


def test_pointers():
    h = "sha256:" + "0" * 64
    p = evidence.Pointer("s", h, h, h, "a b/ü?.md", 1, 9)
    assert evidence.parse_pointer(evidence.pointer_uri(p)) == p
    for bad in ("evidence://s", evidence.pointer_uri(p).replace("0" * 64, "x")):
        with pytest.raises(ValueError):
            evidence.parse_pointer(bad)
    token = evidence.encode_cursor({"query_hash": "q", "consumed": 3}, b"k")
    assert evidence.decode_cursor(token, b"k", "q")["consumed"] == 3
    for args in ((token, b"other", "q"), (token, b"k", "r"), (token[:-2], b"k", "q"), ("x", b"k", "q")):
        with pytest.raises(ValueError):
            evidence.decode_cursor(*args)
    a = evidence.query_hash("x", [{"scope_id": "b"}, {"scope_id": "a"}])
    assert a == evidence.query_hash("x", [{"scope_id": "a"}, {"scope_id": "b"}], since=None)
    with pytest.raises(ValueError):
        evidence.query_hash("x", [{"scope_id": "a"}, {"scope_id": "a"}])


def test_scan(spark, tmp_path):
    for name in ("a.txt", "b.tmp", ".env", "keep.tmp"):
        (tmp_path / name).write_text(name)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.md").write_text("c")
    got = {r.name: (r.ignored, r.secret_tier, r.size_bytes) for r in scan.scan_folder(spark, str(tmp_path), ["*.tmp", "!keep.tmp"]).collect()}
    assert got == {"a.txt": (False, None, 5), "b.tmp": (True, None, 5), "keep.tmp": (False, None, 8), ".env": (False, "A", 4)} or ".env" not in got
    assert scan.child_scopes(spark, str(tmp_path)).count() == 2
    files = scan.scan_folder(spark, str(tmp_path), contents=True)
    assert scan.verified(files).count() == files.count()
    p = spark.createDataFrame([("src/a/b.rs",), ("b.rs",), ("docs/x/y/z.md",), ("docs/z.md",)], "p string")
    hits = lambda rule: [r[0] for r in p.select(scan.ignored(F.col("p"), F.lit(False), [rule])).collect()]
    assert hits("*.rs") == [True, True, False, False] and hits("docs/**/z.md") == [False, False, True, True] and hits("docs/*.md") == [False, False, False, True] and hits("?.rs") == [True, True, False, False]


def test_units(spark):
    assert units.lcs_pairs(list("abcd"), list("xbcdy")) == [(1, 1), (2, 2), (3, 3)]
    frame = lambda s: spark.createDataFrame([("d", i, u, f) for i, (u, f) in enumerate(s)], "doc string, ord int, unit string, fingerprint string")
    got = {(r.old_unit, r.new_unit, r.state) for r in units.map_units(frame([("p1", "x"), ("p2", "y"), ("p3", "z")]), frame([("p1", "x"), ("p2", "q"), ("p4", "w")])).collect()}
    assert got == {("p1", "p1", "unchanged"), ("p2", "p2", "changed"), ("p3", "p4", "changed")}
    r = spark.createDataFrame([(["a"], [], ["b"], [], [], ["a", "b"], ["a"], [], []), (["a"], ["a"], [], [], [], ["a"], ["a"], [], []), (["a"], [], [], [], [], ["a", "b"], ["a"], [], [])], "updated array<string>, added array<string>, unchanged array<string>, failed array<string>, removed array<string>, units array<string>, asked_changed array<string>, asked_added array<string>, asked_removed array<string>")
    assert [x.fault for x in units.response_faults(r).collect()] == [None, "not_disjoint", "not_complete"]


def test_sheets():
    assert sheets.shown("45000", "yyyy-mm-dd") == "2023-03-15" and sheets.shown("0.256", "0.0%") == "25.6%" and sheets.shown("1234.5", "#,##0.00") == "1,234.50" and sheets.shown("7", None) == "7" and sheets.shown("x", "0") == "x"
    assert sheets.serial_date(1).strftime("%Y-%m-%d") == "1900-01-01" and sheets.serial_date(61).strftime("%Y-%m-%d") == "1900-03-01"
    assert sheets.markdown_table([["a|b", "c"], ["d"]]) == "| a\\|b | c |\n| --- | --- |\n| d |  |\n"


def test_stores(spark, tmp_path):
    c = spark.createDataFrame([("s", "k", "h", "p", None)], "scope_id string, chunk_id string, text_hash string, profile_hash string, context string")
    e = spark.createDataFrame([("h", "p", None, [1.0]), ("h", "p", "x", [2.0])], "target_hash string, profile_hash string, context string, vector array<float>")
    assert stores.link_embeddings(c, e).first().vector == [1.0]
    with pytest.raises(Exception, match="two embeddings"):
        stores.link_embeddings(c, e.unionByName(e)).collect()
    o = spark.createDataFrame([("a.txt", b"x")], "name string, body binary").withColumn("hash", F.concat(F.lit("sha256:"), F.sha2("body", 256)))
    assert restore.restore(o, str(tmp_path / "out")).collect()[0].size_bytes == 1
    assert (tmp_path / "out" / "a.txt").read_bytes() == b"x"
    rows = spark.createDataFrame([("s1", 1), ("s2", 2)], "scope_id string, v int")
    stores.replace_scope(spark, rows, str(tmp_path / "t"))
    stores.replace_scope(spark, rows.where("scope_id = 's1'").withColumn("v", F.lit(9)), str(tmp_path / "t"))
    assert {(r.scope_id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("s1", 9), ("s2", 2)}
