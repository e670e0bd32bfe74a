import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sievelight.operators import evaluation, history, ledger, tasks
from sievelight.plans.collection import Selector, Settings
from sievelight.sources import folder, scan

from .test_collection import collection


def test_outcomes_in_order(spark):
    held = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 3), ("e", 2), ("f", 0)], "idempotency_key string, state int")
    rows = [("a", 2, "done", 5.0), ("a", 1, "submitted", 1.0), ("b", 1, "done", 4.0), ("b", 2, "submitted", 2.0), ("c", 7, "rejected", 9.0), ("c", 8, "done", 3.0), ("d", 1, "submitted", 1.0), ("e", 1, "rejected", 1.0), ("x", 1, "done", 1.0)]
    got = tasks.settle(held, spark.createDataFrame(rows, "idempotency_key string, seq long, outcome string, usd double"))
    assert {(r.idempotency_key, r.next, r.cost_usd) for r in got.collect()} == {("a", 2, 5.0), ("b", 1, None), ("c", 3, 0.0), ("d", 3, 0.0), ("e", 2, None), ("f", 0, None)}
    for bad in (rows + [("a", 2, "rejected", 0.0)], [r[:1] + (0,) + r[2:] for r in rows]):
        with pytest.raises(Exception, match="without an order"):
            tasks.settle(held, spark.createDataFrame(bad, "idempotency_key string, seq long, outcome string, usd double")).collect()


def test_percentiles_of_a_hot_group(spark):
    rng = random.Random(4)
    rows = [("hot", rng.randrange(10**6)) for _ in range(20_000)] + [("same", 7)] * 900 + [(None, v) for v in range(11)] + [("one", 3), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v long")
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    for p in (0.001, 0.5, 0.95, 1.0):
        want = {k: sorted(vs)[max(1, -(-int(round(p * 1000)) * len(vs) // 1000)) - 1] for k, vs in groups.items()}
        for accuracy in (50, 10_000):
            assert {r.k: r.percentile for r in evaluation.percentile_disc(df, ["k"], "v", p, accuracy).collect()} == want
    assert [r.percentile for r in evaluation.percentile_disc(df, [], "v", 0.5).collect()] == [sorted(v for vs in groups.values() for v in vs)[-(-sum(map(len, groups.values())) // 2) - 1]]


def test_admission_equals_a_replay(spark):
    rng = random.Random(9)
    cap = lambda *some: rng.choice(some)
    asked = [(f"2026-{rng.randrange(1, 4):02d}", i, f"s{rng.randrange(3)}", rng.choice(["x", "y"]), rng.choice([0.0, 1.0, 2.0, 5.0]), cap(150.0, 150.0, None), cap(60.0, None), cap(80.0, 70.0)) for i in range(600)]
    before = [("2026-01", "s0", "x", 12.0), ("2026-01", "s0", "x", 3.0), ("2026-02", "s9", "y", 40.0), ("2025-12", "s0", "x", 99.0)]
    totals, want = {}, {}

    def add(month, scope, adapter, usd):
        for k in ((month,), (month, "s", scope), (month, "a", adapter)):
            totals[k] = totals.get(k, 0.0) + usd

    for m, s, a, t in before:
        add(m, s, a, t)
    for m, i, s, a, usd, *caps in asked:
        over = [level for level, k, c in zip(("device", "folder", "adapter"), ((m,), (m, "s", s), (m, "a", a)), caps) if c is not None and totals.get(k, 0.0) + usd >= c]
        want[i] = over[0] if over and usd else None
        if want[i] is None:
            add(m, s, a, usd)
    df = spark.createDataFrame(asked, "month string, seq long, scope_id string, adapter string, usd double, device_cap double, folder_cap double, adapter_cap double").withColumn("note", F.lit("kept")).repartition(5)
    got = ledger.admit(df, spark.createDataFrame(before, "month string, scope_id string, adapter string, total double"))
    assert got.columns == [*df.columns, "denied_by"]
    assert {r.seq: r.denied_by for r in got.collect()} == want and set(want.values()) == {None, "device", "folder", "adapter"}
    assert ledger.admit(df, spark.createDataFrame([], "month string, scope_id string, adapter string, total double")).count() == 600
    with pytest.raises(Exception, match="without a cost"):
        ledger.admit(df.withColumn("usd", F.lit(None).cast("double")), got.limit(0).select("month", "scope_id", "adapter", F.col("usd").alias("total"))).collect()


def test_ancestry_by_doubling(spark):
    rng = random.Random(1)
    edges = [(f"c{i:03d}", f"c{i - 1 - rng.randrange(3):03d}" if i > 3 else "c000", 0) for i in range(1, 300)]
    edges += [(f"c{i:03d}", f"c{i - 5 - rng.randrange(9):03d}", 1) for i in range(20, 300, 4)] + [("root", None, 0)]
    parents = spark.createDataFrame(edges, "commit_hash string, parent string, ord int")
    starts = spark.createDataFrame([("c299",), ("c120",), ("root",), ("c120",)], "commit_hash string")
    rows = lambda df: sorted((r.start, r.commit_hash, r.depth) for r in df.collect())
    up = {}
    for c, p, o in edges:
        up.setdefault(c, []).append((p, o))
    for first in (False, True):
        want = []
        for s in ("c299", "c120", "root"):
            seen, now, depth = {s}, [s], 0
            while now:
                want += [(s, c, depth) for c in now]
                now = sorted({p for c in now for p, o in up.get(c, ()) if p and (not first or o == 0)} - seen)
                seen |= set(now)
                depth += 1
        assert rows(history.reachable_by_doubling(starts, parents, first_parent=first)) == sorted(want)
    two = lambda df: df.withColumn("scope_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    by = history.reachable_by_doubling(two(starts), two(parents), by=["scope_id"])
    assert by.count() == 2 * len(rows(history.reachable_by_doubling(starts, parents)))
    with pytest.raises(ValueError):
        history.reachable_by_doubling(starts, parents, most=10)
    entries = spark.createDataFrame([(f"c{i:03d}", f"p{j}", 100) for i in range(300) for j in range(2)], "commit_hash string, path string, size_bytes long")
    reached = history.reachable_by_doubling(starts.limit(1), parents)
    n = reached.count()
    assert history.within_limits(reached, entries, commits=n, rows=2 * n, size=200 * n).count() == 2 * n
    for limit in ({"commits": n - 1}, {"rows": 2 * n - 1}, {"size": 200 * n - 1}):
        with pytest.raises(ValueError):
            history.within_limits(reached, entries, **limit)


@pytest.mark.parametrize("skeleton", [0, 40])
def test_ancestry_makes_no_pairs(spark, monkeypatch, skeleton):
    n = 2000
    edges = [(i, i - 6, 0) for i in range(7, n + 1)] + [(i, i - 13, 1) for i in range(14, n + 1) if i % 11 == 0]
    parents = spark.createDataFrame(edges, "commit_hash long, parent long, ord int")
    starts = spark.createDataFrame([(n,), (n - 1,)], "commit_hash long")
    rows = []
    keep = history.written
    monkeypatch.setattr(history, "written", lambda df: rows.append((out := keep(df)).count()) or out)
    monkeypatch.setattr(history, "SKELETON", skeleton, raising=False)
    monkeypatch.setattr(history, "MOST_ADDED", 64, raising=False)
    up, want = {}, set()
    for c, p, _ in edges:
        up.setdefault(c, []).append(p)
    for s in (n, n - 1):
        depth, now = {s: 0}, [s]
        for c in now:  # breadth first
            for p in up.get(c, ()):
                if p not in depth:
                    depth[p] = depth[c] + 1
                    now.append(p)
        want |= {(s, c, d) for c, d in depth.items()}
    got = [tuple(r) for r in history.reachable_by_doubling(starts, parents).select("start", "commit_hash", "depth").collect()]
    assert len(got) == len(want) and set(got) == want
    if skeleton:
        assert sum(rows) < 40 * n


def test_long_ancestry_takes_few_tables(spark, monkeypatch):
    tables, keep = [], history.written
    monkeypatch.setattr(history, "written", lambda df: tables.append(out := keep(df)) or out)
    monkeypatch.setattr(history, "SKELETON", 500)
    monkeypatch.setattr(history, "BLOCK", 4000, raising=False)
    got = {r.commit: r.depth for r in __spark_entry__.queries()["long_ancestry"](spark, "/root/testdata/sf0.01").collect()}
    keys = sorted(r[0] for r in spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey").collect())
    n = len(keys)
    depth = {n: 0}
    for i in range(n - 1, 0, -1):
        ways = [depth[i + 30]] if i + 30 in depth else []
        ways += [depth[i + 61]] if i + 61 in depth and (i + 61) % 97 == 0 else []
        if ways:
            depth[i] = min(ways) + 1
    assert got == {keys[i - 1]: d for i, d in depth.items()}
    assert len(tables) <= 6


@pytest.mark.parametrize("kind", ["near", "sparse", "cycles", "random", "one block", "dense"])
def test_numbered_ancestry(spark, monkeypatch, kind):
    rng = random.Random(3)
    n = 1500
    number = {"sparse": lambda i: i * 10**12 - 10**15, "random": lambda i: rng.randrange(-(1 << 62), 1 << 62)}.get(kind, lambda i: i)
    names = [number(i) for i in range(n + 1)]
    edges = [(i, i - 1 - rng.randrange(3), 0) for i in range(4, n + 1)] + [(i, i - 5 - rng.randrange(9), 1) for i in range(20, n + 1) if kind == "dense" or i % 7 == 0]
    if kind == "cycles":
        edges += [(i, min(n, i + rng.randrange(12)), 1) for i in range(1, n, 9)]
    if kind == "one block":  # all lead to one commit, and the numbers lie in one place but for a single one
        names[0] = 10**15
        edges += [(0, 5, 0)] + [(i, 3, 1) for i in range(30, n, 2)]
    edges = [(names[c], names[p], o) for c, p, o in edges]
    parents = spark.createDataFrame([*edges, *edges[::5], (names[1], None, 0)], "commit_hash long, parent long, ord int").repartition(3)
    starts = [names[i] for i in (n, n // 2, n // 2, 2)]
    monkeypatch.setattr(history, "SKELETON", {"near": 10, "one block": 1500}.get(kind, 600))
    monkeypatch.setattr(history, "BLOCK", 300)
    monkeypatch.setattr(history, "MOST_IN_BLOCK", 1200)
    filled, keep = [], history._filled
    monkeypatch.setattr(history, "_filled", lambda *a: filled.append(a[3]) or keep(*a))
    for first in (False, True) if kind == "near" else (False,):
        up, want = {}, set()
        for c, p, o in edges:
            if not first or o == 0:
                up.setdefault(c, []).append(p)
        for s in starts:
            depth, now = {s: 0}, [s]
            for c in now:  # breadth first
                for p in up.get(c, ()):
                    if p not in depth:
                        depth[p] = depth[c] + 1
                        now.append(p)
            want |= {(s, c, d) for c, d in depth.items()}
        some = spark.createDataFrame([(s,) for s in starts], "commit_hash long")
        rows = lambda df: [tuple(r) for r in df.select("start", "commit_hash", "depth").collect()]
        got = rows(history.reachable_by_contraction(some, parents, first_parent=first, numbered=True))
        assert len(got) == len(want) and set(got) == want
        assert bool(filled) == (kind not in ("random", "one block"))
        if kind == "near" and not first:
            assert len(filled) > 1  # blocks of blocks
            two = lambda df: df.withColumn("scope_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
            by = history.reachable_by_contraction(two(some), two(parents), by=["scope_id"], numbered=True)
            for scope in "ab":
                assert sorted(rows(by.where(F.col("scope_id") == scope))) == sorted(want)
    with pytest.raises(ValueError):
        history.reachable_by_contraction(some, parents, most=10, numbered=True)


def tree(root, files):
    for name, text in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def test_hidden_files_are_seen(spark, tmp_path):
    tree(tmp_path, {".env": "A=1", ".env.local": "B=2", "_draft.md": "d", "a.md": "text", ".ssh/id_rsa": "key", "deep/x/y/.aws/credentials": "c", "deep/x/token.txt": "t", "deep/_tmp/b.md": "b", "keep/.npmrc": "n", "é ü.md": "u"})
    rows = {r.relative: r for r in scan.scan_folder(spark, str(tmp_path), ["_tmp/", "!.npmrc"], recursive=True).collect()}
    opened = {r.relative: r for r in scan.scan_folder(spark, str(tmp_path), ["_tmp/", "!.npmrc"], recursive=True, contents=True).collect()}
    assert set(rows) == {".env", ".env.local", "_draft.md", "a.md", ".ssh/id_rsa", "deep/x/y/.aws/credentials", "deep/x/token.txt", "deep/_tmp/b.md", "keep/.npmrc", "é ü.md"}
    assert {k for k, r in rows.items() if r.quarantine == "secrets_tier_a_excluded"} == {".env", ".env.local", ".ssh/id_rsa", "deep/x/y/.aws/credentials"}
    assert rows["keep/.npmrc"].quarantine == "secrets_tier_a_online_hold" and rows["deep/x/token.txt"].quarantine == "secrets_tier_b_warning" and rows["a.md"].quarantine is None
    assert set(rows) - set(opened) == {".env", ".env.local", ".ssh/id_rsa", "deep/x/y/.aws/credentials", "deep/_tmp/b.md"}
    assert bytes(opened["é ü.md"].content) == b"u" and opened["a.md"].raw_hash.startswith("sha256:") and None not in {r.content for r in opened.values()}
    assert {r.relative for r in scan.scan_folder(spark, str(tmp_path)).collect()} == {".env", ".env.local", "_draft.md", "a.md", "é ü.md"}
    assert scan.scan_folder(spark, str(tmp_path), contents=True, most_bytes=1).where("content is not null").count() == 2
    folder.register(spark)
    few = spark.read.format(folder.FORMAT).options(recursive="true", subtrees="2").load(str(tmp_path))
    assert few.count() == len(rows) and few.rdd.getNumPartitions() > 1
    (tmp_path / "none").mkdir()
    assert scan.scan_folder(spark, str(tmp_path / "none"), recursive=True).count() == 0


def test_only_changed_files_are_opened(spark, tmp_path):
    root = tmp_path / "t"
    tree(root, {"a": "one", "b": "two", "c": "three", ".hidden": "h", "d/e": "deep"})
    nothing = spark.createDataFrame([], "relative string, size_bytes long, modified timestamp, raw_hash string")
    first = scan.rescan(spark, str(root), nothing)
    assert {r.change for r in first.collect()} == {"added"} and first.count() == 5
    first.write.parquet(str(tmp_path / "listing"))
    stored = spark.read.parquet(str(tmp_path / "listing"))
    (root / "a").write_text("changed")
    os.utime(root / "b", (1, 1))
    (root / "c").unlink()
    tree(root, {"f": "new"})
    (root / "d/e").chmod(0)  # unchanged files are not opened
    got = {r.relative: r for r in scan.rescan(spark, str(root), stored).collect()}
    assert {k: r.change for k, r in got.items()} == {"a": "changed", "b": "touched", "c": "removed", ".hidden": "unchanged", "d/e": "unchanged", "f": "added"}
    old = {r.relative: r.raw_hash for r in stored.collect()}
    assert got["b"].raw_hash == old["b"] and got["d/e"].raw_hash == old["d/e"] and got["a"].raw_hash != old["a"]


def test_pages_of_one_chain_see_one_state(spark):
    col = collection(spark, settings=Settings(cursor_key=b"k", diversify="off"))
    base = {k: v for k, v in col.tables.items()}
    numbered = base["chunks"].withColumn("seq", F.lit(1))
    more = numbered.limit(1).select("scope_id", F.lit("k0").alias("chunk_id"), F.lit("r0").alias("raw_hash"), "heading_path", F.lit("quick quick fox").alias("text"), "created_at", F.lit(2).alias("seq"))
    col.tables["chunks"] = numbered
    ask = lambda cursor=None: col.answer("quick dogs fox", mode="text", selector=Selector(all_history=True), limit=1, cursor=cursor)
    plain, token = [], None
    while token or not plain:
        page = ask(token)
        plain += [r.raw_hash for r in page.rows.collect()]
        token = page.cursor
    page = ask()
    seen = [r.raw_hash for r in page.rows.collect()]
    # meanwhile a chunk comes that would be the best one, with a commit of its own
    col.tables["chunks"] = numbered.unionByName(more)
    col.tables["entries"] = base["entries"].unionByName(spark.createDataFrame([("s", "c3", "z", "r0")], base["entries"].schema))
    col.tables["parents"] = base["parents"].unionByName(spark.createDataFrame([("s", "c3", "c2", 0)], base["parents"].schema))
    col.tables["heads"] = spark.createDataFrame([("s", "c3")], base["heads"].schema)
    while page.cursor:
        page = ask(page.cursor)
        seen += [r.raw_hash for r in page.rows.collect()]
    assert seen == plain
    assert "r0" in {r.raw_hash for r in col.search("quick dogs fox", mode="text", selector=Selector(all_history=True)).collect()}


def test_a_purge_that_begins_meanwhile(spark):
    col, asked = collection(spark), []

    def purges():
        asked.append(1)
        return spark.createDataFrame([("s",)] if len(asked) > 1 else [], "scope_id string")

    col.tables["purges"] = purges
    assert col.search("quick", mode="text").count() == 0 and len(asked) == 2
