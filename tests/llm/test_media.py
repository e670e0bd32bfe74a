import hashlib
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import media


def test_image_round_trip():
    for p in (b"", b"x", b"a" * 64, b"\0\0", bytes(range(256)) * 3):
        samples, n = media.from_png(media.to_png(p))
        assert samples.tobytes() == media.padded(p) and n == len(p) and samples.shape[1] == 64
    broken = bytearray(media.to_png(b"hello"))
    broken[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(broken))


def test_query_by_definition(spark):
    texts = [None, "", "x", "été " * 50, "long " * 20000, "same", "same", "nul\0"]
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(5, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("name", F.lit("clash")).repartition(3)
    got = sorted(map(tuple, media.media_features(docs).collect()), key=str)
    want = []
    for d, t in rows:
        b = (t or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        m = media.to_png(b)
        want.append((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), media.feature(np.frombuffer(p, np.uint8).reshape(-1, 64))))
    assert got == sorted(want, key=str)


def test_empty(spark):
    assert media.media_features(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ranges_retries_and_foreign_archives(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * (i * 30)) for i in range(40)], "doc_id long, text string").repartition(2)
    folder = media.store(docs, str(tmp_path / "m"))
    spark.dataSource.register(media.MediaArchives)
    read = lambda **o: sorted((r.name, bytes(r.media)) for r in spark.read.format("media_archive").options(**o).load(folder).collect())
    whole = read()
    assert len(whole) == 40 and whole == read(range_bytes=700, batch_bytes=100)
    for f in (tmp_path / "m").iterdir():
        if f.suffix == ".idx":
            f.unlink()
        else:
            with tarfile.open(f) as t:
                assert all(t.extractfile(m).read().startswith(media.SIGNATURE) for m in t)
    assert read() == whole

    reader, tries = media.MediaReader({"path": folder, "wait": "0"}), []

    class Flaky:
        def __init__(self, fs):
            self.fs = fs

        def open_input_file(self, path):
            tries.append(path)
            if len(tries) in (1, 2):
                raise OSError("lost")
            return self.fs.open_input_file(path)

    fs, path = media.open_folder(folder)
    archive = sorted(p.name for p in (tmp_path / "m").iterdir())[0]
    name, offset, size = next(iter(reader.members(fs, f"{path}/{archive}")))
    assert reader.retried(Flaky(fs), f"{path}/{archive}", name, offset, size).startswith(media.SIGNATURE) and len(tries) == 3
    with pytest.raises(OSError):
        reader.retried(fs, f"{path}/{archive}", "other", offset, size)
