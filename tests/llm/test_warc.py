import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from sievelight.llm import warc


def test_round_trip_and_revisits(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "u\nv", ""), (5, "c", "WARC/1.1\r\n\r\nx"), (5, "c", "own"), (6, "z", "é" * 70000), (None, "n", "same"), (7, "r", "rep"), (7, "r", "rep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    got = sorted(map(tuple, warc.revisits(pages, limit=200).collect()), key=str)
    last = {}
    for p, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if p is None else p)
    want, seen = [], set()
    for p, _, h in rows:
        b = (h or "").encode()
        first = last[h or ""] == p and (p, b) not in seen
        seen.add((p, b))
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else last[h or ""]))
    assert got == sorted(want, key=str)


def test_min_bytes(spark):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "a", "xx"), (3, "a", "long text"), (4, "a", "long text")], "page_id long, url string, html string")
    assert {r.page_id: r.refers_to for r in warc.revisits(pages, min_bytes=5).collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_empty(spark):
    assert warc.revisits(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_files_are_plain_warc(spark):
    pages = spark.createDataFrame([(1, "http://a", "same"), (2, "http://b", "same")], "page_id long, url string, html string")
    folder, files = warc.deduplicated_archives(pages)
    data = b"".join(gzip.decompress(open(os.path.join(folder.removeprefix("file:"), r.file), "rb").read()) for r in files.collect())
    assert data.count(b"WARC-Type: response") == 1 and data.count(b"WARC-Type: revisit") == 1 and data.count(b"same") == 1
    found = list(warc.parse([data[i : i + 7] for i in range(0, len(data), 7)]))
    assert len(found) == 2
    with pytest.raises(ValueError):
        list(warc.parse([data[:-30]]))


def test_every_capture_has_a_name_of_its_own(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i % 3} b", f"text {i % 4}") for i in range(60)], "page_id long, url string, html string").coalesce(2)
    folder = warc.shared_dir(spark)
    headers = warc.write_captures(pages, folder, limit=900).collect()
    found = {}
    for name in {r.file for r in headers}:
        for h, _ in warc.parse(warc.file_chunks(*warc.open_folder(f"{folder}/{name}"))):
            found[h["warc-record-id"]] = h["warc-target-uri"]
    assert len({r.file for r in headers}) > 4 and len(found) == 60 and set(found.values()) == {f"http://a/{k} b" for k in range(3)}
    assert {warc.record_name(r.file, r.offset) for r in headers} == set(found)
