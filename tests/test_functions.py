import hashlib

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.functions import hashing, text, vectors
from sievelight.operators import chunking


def test_canonical_json():
    h = lambda v: hashing.canonical_json(v)
    assert h({"z": 2, "a": 1}) == '{"a":1,"z":2}'
    assert h({"n": 1e-7}) == '{"n":1e-7}'
    assert h({"n": 9007199254740991}) == '{"n":9007199254740991}'
    assert h({"あ": "値", "é": "café"}) == '{"é":"café","あ":"値"}'
    assert h({"present": None}) == '{"present":null}'
    assert [h(x) for x in (0.0, -0.0, 1.0, 1.5, 100.0, 1e21, 1e20, 0.1, 123456789.125, 5e-324, 1e-6, -2.5e-9)] == ["0", "0", "1", "1.5", "100", "1e+21", "100000000000000000000", "0.1", "123456789.125", "5e-324", "0.000001", "-2.5e-9"]
    assert hashing.canonical_hash({"z": 2, "a": 1}) == "sha256:99168216144c7fed5d4c54916cf98d9c66096280c04a499822a99b6658bd177a"
    with pytest.raises(ValueError):
        h(float("nan"))


ONE = {"raw_hash": "sha256:" + "1" * 64, "tool_profile_hash": "sha256:" + "2" * 64, "gen": 1, "unit_key": "section:one", "unit_content_hash": "sha256:" + "3" * 64, "heading_path": ["Document", "Section"], "byte_start": 0, "byte_end": 5}


def test_chunk_identity(spark):
    want = "sha256:1faef27e8109d93f5a4a9f2707bab3b827e46669db532c42c2453ce70a44f9aa"
    assert hashing.chunk_id(**ONE) == want and hashing.chunk_id(**ONE, section_id="") == want
    other = ONE | {"unit_content_hash": "sha256:" + "4" * 64}
    assert hashing.chunk_id(**other) == "sha256:716360a9c8682f88ae9703c417ac10229fdd0fad51ba6b57451033a77a7a5d9c"
    df = spark.createDataFrame([(*ONE.values(), s) for s in (None, "", "a/b")], "raw_hash string, tool_profile_hash string, gen int, unit_key string, unit_content_hash string, heading_path array<string>, byte_start int, byte_end int, section_id string")
    got = [r.id for r in df.select(hashing.chunk_id_column(*[F.col(c) for c in ("raw_hash", "tool_profile_hash", "gen", "unit_key", "unit_content_hash", "heading_path", "byte_start", "byte_end", "section_id")]).alias("id")).collect()]
    assert got == [want, want, hashing.chunk_id(**ONE, section_id="a/b")]


def test_slugs():
    assert text.slugify("Café 回収率と精度") == "caf-回収率と精度"
    assert text.slugify("  API -- Token!! ") == "api-token"
    assert text.slugify("A\u001cB") == "ab"
    assert text.slugify("a_b c々d") == "a_b-cd"


def test_markdown():
    assert text.normalize_markdown("﻿Title\r\n=====\r\n\r\nSub  \n---\ntext\t\n\n\n") == "# Title\n\n## Sub\ntext\n"
    assert text.normalize_markdown("```\nTitle\n===\n```") == "```\nTitle\n===\n```\n"
    assert text.normalize_markdown("é") == "é\n"
    assert text.fence_code("a```b\n", "py") == "````py\na```b\n````\n"


def test_projection_and_its_inverse():
    assert text.search_projection(r"a\*b &lt;x&gt; `c\*d` \\") == "a*b <x> `c\\*d` \\"
    assert text.search_projection("```\na\\*b\n```\nc\\*d\0") == "```\na\\*b\n```\nc*d"
    for s in ("a*b <x> & \\ `", "#1 [x](y)", "plain"):
        assert text.search_projection(text.escape_source(s)) == s


def test_query_units():
    assert text.query_units("回収率テスト abc-12,345") == ["回収率テスト", "回収率", "テスト", "abc-12,345", "abc", "12,345"]
    assert text.match_plan("3600 x") == (["3600", "3,600"], [])
    assert text.match_plan("ab c") == ([], [["ab"], ["c"]])
    with pytest.raises(ValueError):
        text.match_plan("  ")


def test_durations():
    assert [text.duration_seconds(x) for x in ("5s", "2m", "1h", "7d", "3w")] == [5, 120, 3600, 604800, 1814400]
    for bad in ("", "5", "0d", "d", "1x", "-1d", "1 d"):
        with pytest.raises(ValueError):
            text.duration_seconds(bad)


def test_occurrences_overlap(spark):
    df = spark.createDataFrame([("aaaa AaA",), ("É.é.x",), ("",)], "t string")
    assert [r[0] for r in df.select(text.occurrences(F.lower("t"), "aaa")).collect()] == [3, 0, 0]
    assert [r[0] for r in df.select(text.occurrences(F.lower("t"), "é.")).collect()] == [0, 2, 0]


def test_columns(spark):
    h = "sha256:" + "a" * 64
    md = f"![x](pic://s/object/image/{h}) ![y](pic://s/object/image/{h}) ![z](http://no)"
    df = spark.createDataFrame([(md, "p/q", "Slug"), ("\x01\x02\x03ab", "", "Slug")], "m string, s string, g string")
    rows = df.select(text.related_images(F.col("m"), "pic"), text.leaf_section(F.col("s"), F.col("g")), text.is_real_text(F.col("m"))).collect()
    assert rows[0][0] == [h] and [r[1] for r in rows] == ["q", "Slug"] and [r[2] for r in rows] == [True, False]


def test_vectors(spark):
    rows = [([1.0, 0.0],), ([0.0, 0.0],), ([1.0],), ([float("nan"), 1.0],), ([3.0, 4.0],), (None,)]
    df = spark.createDataFrame(rows, "v array<float>")
    q = F.array(F.lit(0.6), F.lit(0.8))
    got = [r[0] for r in df.select(vectors.rank_cosine(F.col("v"), q)).collect()]
    assert got[0] == pytest.approx(0.6) and got[1:4] == [None, None, None] and got[4] == pytest.approx(1.0) and got[5] is None
    cut = [r[0] for r in df.select(vectors.truncated(F.col("v"), 1)).collect()]
    assert cut[0] == [1.0] and cut[1] is None and cut[4] == [1.0]
    v = vectors.token_embedding("alpha beta")
    assert v.shape == (768,) and abs((v * v).sum() - 1) < 1e-5
    assert vectors.token_embedding("Alpha, BETA!").tolist() == v.tolist()
    anchored = vectors.token_embedding("0123456789ab and more words here")
    assert vectors.similarity(anchored, vectors.token_embedding("0123456789ab")) > 0.9


def test_hash_columns(spark):
    r = spark.createDataFrame([("a", "b")], "x string, y string").select(hashing.content_hash(F.col("x")), hashing.idempotency_key(F.col("x"), F.col("y")), hashing.unit_ref(F.col("x"))).first()
    s = lambda b: hashlib.sha256(b).hexdigest()
    assert tuple(r) == ("sha256:" + s(b"a"), "sha256:" + s(b"a\0b"), s(b"a")[:16])
    assert hashing.prompt_hash("a  \r\nb\n\n") == hashing.prompt_hash("a\nb")
    base = dict(target_type="chunk", target_hash="h", dimensions=2, distance="cosine", modality="text", profile_hash="p")
    assert hashing.embedding_id(**base) != hashing.embedding_id(**base, context="")


class Units:
    """Gives out the function that a task runs."""

    columns, schema = ["id", "text"], T.StructType()

    def select(self, *names):
        return self

    def mapInPandas(self, run, schema):
        return run

    mapInArrow = mapInPandas


def test_a_task_hands_chunks_over_in_parts():
    text = "".join(f"# Section {k}\n\nSome words.\n\n" for k in range(30))
    units = pd.DataFrame({"raw_hash": [f"h{i}" for i in range(3000)], "tool_profile_hash": "p", "gen": 1, "unit_key": [f"u{i}" for i in range(3000)], "text": text})
    sizes = [len(b) for b in chunking.chunk(Units())(iter([units]))]
    assert sum(sizes) == 90_000 and max(sizes) < 6000


def test_columns_of_long_strings_are_computed_in_slices(spark):
    rows = [(i, None if i == 5 else f"&amp; \u0041\u030a {i} " * 50_000) for i in range(40)]
    columns = {"upper": (str.upper, "text"), "length": (lambda s: str(len(s)), "upper")}
    whole = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["id", "text"])
    slices = list(text.computed(Units(), columns)(iter([whole])))
    assert sum(b.num_rows for b in slices) == 40 and max(b.num_rows for b in slices) < 15
    got = text.computed(spark.createDataFrame(rows[:8], "id long, text string"), columns).collect()
    assert [(r.id, r.upper, r.length) for r in got] == [(i, s and s.upper(), s and str(len(s.upper()))) for i, s in rows[:8]]
