import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelight.llm import tokens

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL))
OWN = tokens.counter(tokens.model_bytes())


def check(text):
    got = tokens.counts(OWN.table(text)).tolist()
    assert got == [len(SP.encode(text[:i])) for i in range(len(text) + 1)], text


def test_every_prefix():
    for t in ("", " ", "  ", "hello world", " lead and  double   spaces ", "a\nb\tc\r\n", "Éçmentelle için 日本語 🙂🙂 xﬁn▁y ▁▁z", "internationalization unbelievably the the", "<s> </s> <unk> <0x0A>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\x00\x01"):
        check(t)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abceinorst hT.,\n▁é1 "), max_size=40))
def test_random_texts(text):
    check(text)


def test_questions_without_the_text():
    text = "The quick brown fox, " * 30
    packed = tokens.pack(OWN.table(text))
    want = [len(SP.encode(text[:i])) for i in range(len(text) + 1)]
    assert [tokens.tokens_of_prefix(packed, i) for i in (0, 1, 50, 400, 10**6)] == [want[i] for i in (0, 1, 50, 400, -1)]
    for k in (0, 1, 17, 10**6):
        assert tokens.longest_prefix(packed, k) == max(i for i, w in enumerate(want) if w <= k)


def test_query_rows(spark):
    texts = [None, "", "x", "word " * 6000, "same", "same"]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs).collect()), key=str)
    want = [(i if i else None, len((t or "").encode()), len(SP.encode(t or "")), len(SP.encode(t or "")) > 4096) for i, t in enumerate(texts)]
    assert got == sorted(want, key=str)
    stored = tokens.materialize(tokens.prefix_tables(docs))
    by_limit = {k: tokens.answers(stored, limit=k).where("doc_id = 3").first() for k in (0, 7, 4096, 10**6)}
    count = [len(SP.encode(texts[3][:i])) for i in (0, by_limit[7].chars_within, by_limit[7].chars_within + 1)]
    assert by_limit[0].chars_within == 0 and count[1] <= 7 < count[2] and by_limit[10**6].chars_within == len(texts[3])
    assert by_limit[4096].chars_within < len(texts[3]) and not by_limit[10**6].over_limit


def test_megabytes_of_text(spark):
    text = "Some words, again and again; été 日本 " * 60_000
    got = tokens.token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_tokens == len(SP.encode(text)) and got.n_bytes == len(text.encode())


def test_pieces_of_the_user_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(tokens.model_bytes())
    proto.pieces[-1].type = 4
    with pytest.raises(ValueError):
        tokens.PrefixCounter(proto.SerializeToString())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.token_counts(docs.limit(0)).count() == 0


def test_cache_limit():
    own = tokens.PrefixCounter(tokens.model_bytes(), cached=3)
    text = "one two three four five six one two"
    assert int(np.frombuffer(own.table(text), np.int8).sum()) == len(SP.encode(text))
