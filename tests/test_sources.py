import io
import sqlite3
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from sievelight.functions.hashing import hash_bytes
from sievelight.operators import history
from sievelight.plans.runner import run_scopes
from sievelight.sources import office, prepare, scan, sqlite


def test_sqlite_rows(spark, tmp_path):
    for k in range(2):
        db = sqlite3.connect(tmp_path / f"{k}.db")
        db.execute("create table t (a integer, b text)")
        db.executemany("insert into t values (?, ?)", [(k * 100 + i, None if i == 3 else f"v{i}") for i in range(25)])
        db.commit()
        db.close()
    got = sqlite.read_sqlite(spark, f"{tmp_path}/*.db", "select a, b from t where a % 2 = 1", "a long, b string", rows=4)
    assert got.columns == ["path", "a", "b"] and sorted(r.a for r in got.collect()) == [*range(1, 25, 2), *range(101, 125, 2)]
    assert [r.b for r in got.where("a = 3").collect()] == [None]
    one = f"{tmp_path}/0.db"
    assert sqlite.read_sqlite(spark, one, "select count(*) from t", "n long", expected=hash_bytes((tmp_path / "0.db").read_bytes())).first().n == 25
    with pytest.raises(Exception, match="has changed"):
        sqlite.read_sqlite(spark, one, "select 1", "n long", expected="sha256:0").collect()
    with pytest.raises(Exception, match="readonly|query_only|write"):
        sqlite.read_sqlite(spark, one, "insert into t values (1, 'x') returning a", "n long").collect()


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def test_documents_and_slides(spark, tmp_path):
    body = '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>one </w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    doc = archive({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})
    assert office.document_markdown(doc) == "## Title\n\none \ttwo\n\n| a | b |\n| --- | --- |\n\n"
    shows = archive({f"ppt/slides/slide{k}.xml": f"<sld {A}><a:p><a:r><a:t>S{k}</a:t></a:r></a:p><a:p><a:r><a:t>x</a:t></a:r></a:p></sld>" for k in (10, 2)})
    assert list(office.slides(shows)) == [("slide:2", "# S2\n\nx\n"), ("slide:10", "# S10\n\nx\n")]
    for name, data in {"a.docx": doc, "b.pptx": shows, "c.docx": b"PK"}.items():
        (tmp_path / name).write_bytes(data)
    rows = prepare.prepare(scan.scan_folder(spark, str(tmp_path), contents=True)).collect()
    assert {(r.path[-6:], r.unit_key) for r in rows} == {("a.docx", "file"), ("b.pptx", "slide:2"), ("b.pptx", "slide:10"), ("c.docx", None)}


def test_scopes_side_by_side(spark):
    def work(scope):
        if scope == "bad":
            raise ValueError("no such scope")
        if scope == "slow":
            spark.range(0, 1 << 40, 1, 1).selectExpr("sum(id % 7)").collect()
        time.sleep(0.1)
        return spark.range(len(scope)).count()

    got = run_scopes(spark, ["abc", "bad", "slow", "x"], work, timeout=6)
    assert [(o.scope, o.value, o.error) for o in got] == [("abc", 3, None), ("bad", None, "ValueError: no such scope"), ("slow", None, "timeout"), ("x", 1, None)]


def test_snapshots(spark):
    tree = lambda rows: spark.createDataFrame(rows, "path string, raw_hash string")
    none = tree([]).withColumn("commit_hash", F.lit("x"))
    first, entries = history.snapshot(tree([("a", "1"), ("b", "2")]), none, None)
    assert first["stats"] == {"added": 2, "modified": 0, "deleted": 0} and entries.count() == 2
    again, _ = history.snapshot(tree([("b", "2"), ("a", "1")]), none, None)
    assert again["commit_hash"] == first["commit_hash"]
    same, rows = history.snapshot(tree([("a", "1"), ("b", "2")]), entries, first["commit_hash"], kind="auto")
    assert same["commit_hash"] == first["commit_hash"] and rows.count() == 0
    second, _ = history.snapshot(tree([("a", "9"), ("c", "2")]), entries, first["commit_hash"], kind="auto", at=5)
    assert second["stats"] == {"added": 1, "modified": 1, "deleted": 1} and second["parent"] == first["commit_hash"] and second["tree_hash"] != first["tree_hash"]
    with pytest.raises(ValueError):
        history.snapshot(tree([]), entries, None, kind="odd")
