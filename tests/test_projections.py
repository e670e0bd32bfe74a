import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from sievelight.sources import restore, scan, sheets
from sievelight.sources.projections import Projections, verified_scopes

SCHEMA = "scope_id string, commit_hash string, chunk_id string"


def test_a_reader_sees_its_version(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    got = lambda df: sorted((r.scope_id, r.commit_hash, r.chunk_id) for r in df.collect())
    empty = Projections(spark, f"{tmp_path}/p", SCHEMA)
    assert got(empty.current()) == [] == got(empty.at("c1"))
    v1 = empty.replace(rows(("a", "c1", "1"), ("a", "c1", "2"), ("b", "d1", "3")), {"a": "c1", "b": "d1"})
    first = got(v1.current())
    v2 = v1.replace(rows(("a", "c2", "4")), {"a": "c2"}, preserve_at=True)
    assert got(v1.current()) == first and got(v2.current()) == [("a", "c2", "4"), ("b", "d1", "3")]
    assert got(v2.at("c1")) == [("a", "c1", "1"), ("a", "c1", "2")] and got(v2.at("c2")) == [("a", "c2", "4")]
    with pytest.raises(RuntimeError):
        v1.replace(rows(), {"a": "c9"})
    with pytest.raises(ValueError):
        v2.replace(rows(("b", "c2", "4")), {"a": "c2"})
    v3 = v2.replace(rows(), {"a": "c3"}, preserve_at=True)
    assert got(v3.current()) == [("b", "d1", "3")] and got(v3.at("c2")) == [("a", "c2", "4")] and got(v3.at("c1")) == [("a", "c1", "1"), ("a", "c1", "2")]
    assert {(r.scope_id, r.commit_hash, r.rows) for r in verified_scopes(v3).collect()} == {("a", "c3", 0), ("b", "d1", 1)}
    v4 = v3.replace(rows(("a", "c4", "9")), {"a": "c4"})
    assert got(v4.at("c1")) == [] and got(v4.current(["a"])) == [("a", "c4", "9")]
    v5 = v4.retain(["b"])
    assert got(v5.current()) == [("b", "d1", "3")] and got(v1.current()) == first
    assert v5.vacuum() > 3 and got(Projections(spark, f"{tmp_path}/p", SCHEMA).current()) == [("b", "d1", "3")]


def objects(spark, *rows):
    return spark.createDataFrame([(n, "sha256:" + hashlib.sha256(b).hexdigest(), b) for n, b in rows], "name string, hash string, body binary").repartition(3)


def test_a_folder_is_restored_whole_or_not_at_all(spark, tmp_path):
    out = tmp_path / "out"
    good = [(f"f{i}.txt", bytes([i]) * i) for i in range(12)]
    assert restore.restore(objects(spark, *good), str(out)).count() == 12
    assert {p.name: p.read_bytes() for p in out.iterdir()} == dict(good) and os.listdir(tmp_path) == ["out"]
    for rows, wrong in (([("../x", b"1")], "unsafe"), ([(".part-1", b"1")], "unsafe"), ([("a", b"1"), ("a", b"2")], "twice"), ([("big", b"1" * 99)], "allowed")):
        with pytest.raises(Exception, match=wrong):
            restore.restore(objects(spark, *good, *rows), str(tmp_path / "bad"), most_bytes=50)
        assert os.listdir(tmp_path) == ["out"]
    with pytest.raises(Exception, match="does not have the hash"):
        restore.restore(objects(spark, *good).withColumn("body", F.lit(b"other")), str(tmp_path / "bad"))
    with pytest.raises(Exception, match="exists"):
        restore.restore(objects(spark, ("n", b"1")), str(out))
    assert os.listdir(tmp_path) == ["out"] and len(list(out.iterdir())) == 12
    assert restore.restore(objects(spark, *good).limit(0), str(tmp_path / "none")).count() == 0


def test_a_task_that_runs_again(tmp_path):
    import pyarrow as pa

    writer = restore.FolderWriter(str(tmp_path / "o"), 100)
    batch = pa.RecordBatch.from_pydict({"name": ["a"], "hash": ["sha256:" + hashlib.sha256(b"x").hexdigest()], "body": [b"x"]})
    writer.write(iter([batch]))  # its executor is lost before it reports
    (tmp_path / writer.staging.rpartition("/")[2] / ".part-dead").write_bytes(b"half")
    writer.commit([writer.write(iter([batch])), None])
    assert [(p.name, p.read_bytes()) for p in (tmp_path / "o").iterdir()] == [("a", b"x")]


def test_rules_as_data(spark):
    rng = random.Random(6)
    pool = ["*.log", "!keep.log", "tmp/", "/a/*.md", "!a/**", "# note", "", "**/x?.txt", "b", "!tmp/", "a/b/", "*.md"]
    rules = {f"s{i}": rng.sample(pool, rng.randrange(1, 9)) for i in range(12)}
    names = ["a", "b", "tmp", "keep.log", "n.log", "x1.txt", "r.md", "é.md"]
    paths = ["/".join(rng.choices(names, k=rng.randrange(1, 4))) for _ in range(150)]
    files = spark.createDataFrame([(s, p) for s in [*rules, "none", None] for p in paths] + [("s0", None)], "scope_id string, relative string").withColumn("_note", F.lit(1))
    table = spark.createDataFrame([(s, k, r) for s, rs in rules.items() for k, r in enumerate(rs)], "scope_id string, ord int, rule string").repartition(4)
    got = {(r.scope_id, r.relative): r.ignored for r in scan.ignored_by_scope(files, table).collect()}
    assert not any(v for (s, p), v in got.items() if s in ("none", None) or p is None)
    one = spark.createDataFrame([(p,) for p in set(paths)], "relative string")
    for s in list(rules)[:4]:  # as the expression of nested cases says
        hidden, _, _ = scan._judged(F.col("relative"), rules[s])
        assert {r.relative: r.h for r in one.select("relative", hidden.alias("h")).collect()} == {p: got[s, p] for p in set(paths)}


def test_regions_of_a_sheet():
    rows = [["Title", "", ""], ["", "", ""], ["name", "", "n"], ["a", "", "1"], [], ["note"], [""], ["k", "v"], ["x|y"]]
    assert sheets.sheet_markdown(rows) == "Title\n\n| name | n |\n| --- | --- |\n| a | 1 |\n\nnote\n\n| k | v |\n| --- | --- |\n| x\\|y |  |\n"
    assert sheets.sheet_markdown([["Heading"], ["a", "b"], ["1", "2"]]) == "Heading\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n"
