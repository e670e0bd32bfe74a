"""Token counts of every prefix of a text, for byte-pair models of sentencepiece.

A sequence of pieces is what the model gives for their text exactly if that holds for
each two neighbours. So every prefix has one last piece that fits the last piece of
what stands before it, and its count is one more than the count there: a dynamic
programme over prefixes. It runs once per distinct segment (no piece crosses the
border of two), and a text's table is the segments' tables joined, one byte per
character: by how much that character changes the count.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, materialize, slices, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Segments up to this length share what is known of their prefixes.
SHARED = 40


def model_bytes(model: str = MODEL) -> bytes:
    """The model file at a path, or of a name among the public tokenizers."""
    if "/" not in model:
        import public_tokenizers

        model = public_tokenizers.path(model)
    with open(model, "rb") as f:
        return f.read()


class Tables(dict):
    """segment -> its table of changes; filled when asked, emptied when full."""

    def __init__(self, counter: PrefixCounter, limit: int):
        super().__init__()
        self.counter, self.limit = counter, limit

    def __missing__(self, segment: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        parts = self.counter.cut(segment)
        found = b"".join(map(self.__getitem__, parts)) if len(parts) > 1 else self.counter.segment_table(segment)
        self[segment] = found
        return found


class PrefixCounter:
    """Prefix counts under one model; ``cached`` segments and prefixes (some 300 MB) and a quarter as many piece pairs are kept."""

    def __init__(self, model: bytes, cached: int = 800_000):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        n = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces:
            raise ValueError("prefix counts need a byte-pair model with byte fallback and without normalization")
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("prefix counts need a model without pieces of the user's own")
        n.add_dummy_prefix = False
        self.bare = SentencePieceProcessor(model_proto=proto.SerializeToString())
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        #: Pieces that merging can reach; the others never occur in an encoding.
        self.ids = {p: i for (p, i), e in zip(normal.items(), self.bare.encode(list(normal), num_threads=1), strict=True) if e == [i]}
        self.longest = max(map(len, self.ids), default=1)
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal):
            self.split = None
        else:
            self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if "\n" in "".join(normal) else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.pairs = {p[i : i + 2] for p in normal for i in range(len(p) - 1)}
        self.fits: dict[tuple[str, str], bool] = {}
        self.last: dict[str, str] = {}  # a prefix of a segment -> its last piece ("": bytes)
        self.cached, self.tables = cached, Tables(self, cached)

    def pair_fits(self, a: str, b: str) -> bool:
        if (known := self.fits.get((a, b))) is None:
            if len(self.fits) >= self.cached // 4:
                self.fits.clear()
            known = self.fits[a, b] = self.bare.encode(a + b) == [self.ids[a], self.ids[b]]
        return known

    def cut(self, s: str) -> list[str]:
        """The parts of a segment between neighbours that no piece holds both, so that nothing merges across."""
        pairs = self.pairs
        at = [i for i, pair in enumerate(map(add, s, s[1:]), 1) if pair not in pairs]
        return [s[i:j] for i, j in zip([0, *at], [*at, len(s)], strict=True)] if at else [s]

    def segment_table(self, s: str) -> bytes:
        ids, fits, longest, known = self.ids, self.fits, self.longest, self.last
        count, last = [0] * (len(s) + 1), [""] * (len(s) + 1)
        begin, shared = 1, len(s) <= SHARED
        while shared and begin <= len(s) and (piece := known.get(s[:begin])) is not None:
            last[begin] = piece
            count[begin] = count[begin - len(piece)] + 1 if piece else count[begin - 1] + len(s[begin - 1].encode())
            begin += 1
        for i in range(begin, len(s) + 1):
            for j in range(max(0, i - longest), i):
                if (piece := s[j:i]) in ids:
                    if before := last[j]:
                        if (fit := fits.get((before, piece))) is None:
                            fit = self.pair_fits(before, piece)
                        if not fit:
                            continue
                    count[i], last[i] = count[j] + 1, piece
                    break
            else:  # no piece ends here: the character becomes bytes, and nothing merges with it
                count[i] = count[i - 1] + len(s[i - 1].encode())
            if shared:
                if len(known) >= self.cached:
                    known.clear()
                known[s[:i]] = last[i]
        return bytes([(y - x) & 0xFF for x, y in zip(count, count[1:], strict=False)])

    def table(self, text: str) -> bytes:
        """Changes of the count, the first for the space that the model puts ahead."""
        if not text:
            return b""
        shown = SPACE + text.replace(" ", SPACE)
        if self.split is None:
            return self.tables[shown]
        return b"".join(map(self.tables.__getitem__, self.split.findall(shown)))


def counter(model: bytes) -> PrefixCounter:
    return keep(("prefix counter", model), lambda: PrefixCounter(model))


def counts(changes: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2, ... characters."""
    if not changes:
        return np.zeros(1, dtype=np.int64)
    total = np.cumsum(np.frombuffer(changes, dtype=np.int8), dtype=np.int64)
    total[0] = 0  # the empty prefix has no token, though the leading space alone would be one
    return total


def pack(changes: bytes) -> bytes:
    return zlib.compress(changes, 1)


def tokens_of_prefix(packed: bytes, chars: int) -> int:
    """Tokens of the first ``chars`` characters of the text whose table this is."""
    c = counts(zlib.decompress(packed))
    return int(c[min(chars, len(c) - 1)])


def longest_prefix(packed: bytes, tokens: int) -> int:
    """Characters of the longest prefix of at most ``tokens`` tokens."""
    return int(np.flatnonzero(counts(zlib.decompress(packed)) <= tokens)[-1])


STORED = "doc_id bigint, n_bytes bigint, prefix_table binary"


def prefix_tables(docs: DataFrame, *, model: str = MODEL) -> DataFrame:
    """doc_id, n_bytes and the packed table of prefix counts of every row of ``docs`` (doc_id, text).

    ``tokens_of_prefix`` and ``longest_prefix`` answer from the table, without the text.
    Null and empty texts have an empty table. Rows are independent, so repeated ids and
    rows stay; other columns are ignored.
    """
    data = model_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(data)
        for b in slices(batches):
            tables = [pack(own.table(text.as_py() or "")) for text in b.column("text")]
            sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, pa.array(tables, pa.binary())], ["doc_id", "n_bytes", "prefix_table"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, STORED)


def answers(tables: DataFrame, *, limit: int = 4096) -> DataFrame:
    """n_bytes, n_tokens, over_limit and the characters of the longest prefix within ``limit`` tokens, from stored tables alone."""
    ddl = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, chars_within bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            total, within = [], []
            for packed in b.column("prefix_table"):
                c = counts(zlib.decompress(packed.as_py()))
                total.append(int(c[-1]))
                within.append(len(c) - 1 if c[-1] <= limit else int(np.flatnonzero(c <= limit)[-1]))
            n_tokens = pa.array(total, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n_tokens, pc.greater(n_tokens, limit), pa.array(within, pa.int64())], [x.split()[0] for x in ddl.split(", ")])

    return tables.select("doc_id", "n_bytes", "prefix_table").mapInArrow(run, ddl)


def token_counts(docs: DataFrame, *, model: str = MODEL, limit: int = 4096) -> DataFrame:
    """``answers`` from the ``prefix_tables`` of ``docs``, which are written first and read back.

    n_tokens is what the library gives for the whole text, without added special tokens.
    """
    return answers(materialize(prefix_tables(docs, model=model)), limit=limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and chars_within of every row of ``documents``, from stored prefix tables.

    Null and empty texts have 0 bytes and 0 tokens; texts of any length are read whole;
    repeated rows and ids stay; an empty table gives no rows; other columns are not read.
    """
    return token_counts(table(spark, sf_dir, "documents"))
