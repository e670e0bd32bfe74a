"""Media columns: a data source over folders of tar archives.

Payloads are kept as 8-bit grey images (PNG, 64 samples a row, no row filter) in tar
archives of bounded size, each with an index of its members' offsets beside it. The
source plans byte ranges over the archives from their sizes alone; a task reads the
index, takes the members that begin in its range and streams them as Arrow batches of
bounded bytes. Every member is read, and on failure read again, by its own offset.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import drop_kept, materialize, open_folder, shared_dir, slices, table

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
INDEX = pa.schema([("name", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])
MEMBERS = pa.schema([("archive", pa.string()), ("name", pa.string()), ("offset", pa.int64()), ("media", pa.binary())])


def padded(payload: bytes, unit: int = WIDTH) -> bytes:
    """The payload with bytes 0 up to a positive multiple of ``unit``."""
    return payload + bytes(max(unit, -(-len(payload) // unit) * unit) - len(payload))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 2) -> bytes:
    """A lossless grey image of the padded payload; its text chunk has the length without padding."""
    samples = np.frombuffer(padded(payload), dtype=np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(samples), WIDTH + 1), dtype=np.uint8)
    rows[:, 1:] = samples
    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"Bytes\0" + str(len(payload)).encode()) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[np.ndarray, int]:
    """Samples (rows, 64) and the length without padding of an image that ``to_png`` made; anything else is an error."""
    if not media.startswith(SIGNATURE):
        raise ValueError("not a PNG image")
    at, parts, packed = len(SIGNATURE), {}, b""
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk does not match its checksum")
        if kind == b"IDAT":
            packed += data
        parts[kind] = data
        at += size + 12
    width, height, depth, colour = struct.unpack(">IIBB", parts[b"IHDR"][:10])
    rows = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(height, width + 1)
    if (width, depth, colour) != (WIDTH, 8, 0) or rows[:, 0].any() or b"IEND" not in parts:
        raise ValueError("not an image of this format")
    return rows[:, 1:], int(parts[b"tEXt"].partition(b"\0")[2])


def feature(samples: np.ndarray) -> str:
    """Rows, mean and a 64-bit average hash of an 8 x 8 thumbnail."""
    h = len(samples)
    edges = np.arange(8) * h // 8
    sums = np.add.reduceat(samples.reshape(h, 8, 8).sum(axis=2, dtype=np.int64), edges, axis=0)
    counts = np.maximum(1, np.diff(np.r_[edges, h]))
    cells = sums / counts[:, None]
    bits = int.from_bytes(np.packbits((cells > cells.mean()).ravel()).tobytes(), "big")
    return f"{WIDTH}x{h} mean={samples.sum(dtype=np.int64) / samples.size:.3f} hash={bits:016x}"


def tar_header(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.USTAR_FORMAT)


def write_archives(rows: DataFrame, folder: str, limit: int = 64 << 20) -> DataFrame:
    """Write an image per row of ``rows`` (name, text) into archives of at most ``limit`` bytes; returns (archive, members).

    Every attempt of a task writes archives of its own; those that no successful
    attempt reports are deleted before the folder is used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        fs, path = open_folder(folder)
        fs.create_dir(path, recursive=True)
        context = TaskContext.get()
        done: list[tuple[str, int]] = []
        index: list[tuple[str, int, int]] = []
        out, at, name = None, 0, ""

        def close() -> None:
            out.write(bytes(1024))
            out.close()
            with pa.ipc.new_file(fs.open_output_stream(f"{path}/{name}.idx", compression=None), INDEX) as w:
                w.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index, strict=True), INDEX, strict=True)], schema=INDEX))
            done.append((name, len(index)))
            index.clear()

        for b in slices(batches):
            for member, text in zip(b.column("name").to_pylist(), b.column("text").cast(pa.large_binary()), strict=True):
                media = to_png(text.as_py() or b"")
                block = tar_header(member, len(media)) + padded(media, 512)
                if out is not None and at + len(block) > limit:
                    close()
                    out = None
                if out is None:
                    name, at = f"{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):05d}.tar", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                out.write(block)
                index.append((member, at, len(media)))
                at += len(block)
        if out is not None:
            close()
        names, members = zip(*done, strict=True) if done else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(members, pa.int64())], ["archive", "members"])

    return rows.select("name", "text").mapInArrow(run, "archive string, members bigint")


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class MediaArchives(DataSource):
    """``spark.read.format("media_archive").load(folder)``: archive, name, offset and media of every member.

    Options: ``range_bytes`` of a partition, ``batch_bytes`` of an Arrow batch,
    ``retries`` of a member and ``wait`` seconds before the first of them (then twice
    as long each time).
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, name string, offset bigint, media binary"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(dict(self.options))


class MediaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.range_bytes = int(options.get("range_bytes", 32 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 8 << 20))
        self.retries, self.wait = int(options.get("retries", 3)), float(options.get("wait", 0.5))

    def partitions(self) -> list[ByteRange]:
        from pyarrow.fs import FileSelector

        fs, path = open_folder(self.folder)
        files = sorted((f.base_name, f.size) for f in fs.get_file_info(FileSelector(path, allow_not_found=True)) if f.base_name.endswith(".tar"))
        # an empty plan would fail, so that no archive is one empty range
        return [ByteRange(n, i, min(size, i + self.range_bytes)) for n, size in files for i in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def members(self, fs, path: str) -> Iterator[tuple[str, int, int]]:
        """Name, offset and size of the members, from the index, or from the headers where there is none."""
        try:
            with fs.open_input_file(f"{path}.idx") as f:
                yield from zip(*(c.to_pylist() for c in pa.ipc.open_file(f).read_all().columns), strict=True)
                return
        except FileNotFoundError:
            pass
        with fs.open_input_file(path) as f:
            at = 0
            while at + 512 <= f.size() and (head := f.read_at(512, at)).strip(b"\0"):
                info = tarfile.TarInfo.frombuf(head, "utf-8", "strict")
                yield info.name, at, info.size
                at += 512 + -(-info.size // 512) * 512

    def member(self, fs, path: str, name: str, offset: int, size: int) -> bytes:
        """One member, whose header must name it."""
        with fs.open_input_file(path) as f:
            data = f.read_at(512 + size, offset)
        info = tarfile.TarInfo.frombuf(data[:512], "utf-8", "strict")
        if (info.name, info.size, len(data)) != (name, size, 512 + size):
            raise OSError(f"{path} has no {name} at {offset}")
        return data[512:]

    def retried(self, *args) -> bytes:
        for k in range(self.retries + 1):
            try:
                return self.member(*args)
            except (OSError, tarfile.TarError):
                if k == self.retries:
                    raise
                time.sleep(self.wait * 2**k)
        raise AssertionError

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, path = open_folder(self.folder)
        path, held, size = f"{path}/{partition.archive}", [], 0
        for name, offset, n in self.members(fs, path):
            if partition.start <= offset < partition.end:
                held.append((partition.archive, name, offset, self.retried(fs, path, name, offset, n)))
                size += n
                if size >= self.batch_bytes:
                    yield self.batch(held)
                    held, size = [], 0
        if held:
            yield self.batch(held)

    def batch(self, held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), MEMBERS, strict=True)], schema=MEMBERS)


def store(docs: DataFrame, folder: str | None = None) -> str:
    """Write the texts of ``docs`` (doc_id, text) as images into archives; returns their folder."""
    from pyarrow.fs import FileSelector

    folder = folder or shared_dir(docs.sparkSession)
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".png"))
    written = materialize(write_archives(docs.select(name.alias("name"), "text"), folder))
    kept = {r.archive for r in written.select("archive").collect()}  # one row per archive of 64 MB
    fs, path = open_folder(folder)
    for f in fs.get_file_info(FileSelector(path, allow_not_found=True)):
        if f.base_name.removesuffix(".idx") not in kept:
            fs.delete_file(f.path)
    return folder


READ = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_features(docs: DataFrame) -> DataFrame:
    """Store every text of ``docs`` (doc_id, text) as an image, read the images back, and describe them.

    Null and empty texts are 64 bytes 0. All columns but doc_id depend on the text
    only. Null ids, repeated ids and rows each give a row; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = store(docs)
    spark.dataSource.register(MediaArchives)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for b in slices(batches):
            out: list[tuple] = []
            for name, media in zip(b.column("name").to_pylist(), b.column("media").to_pylist(), strict=True):
                samples, n = from_png(media)
                payload, doc = samples.tobytes(), name.removesuffix(".png")
                out.append((None if doc == "null" else int(doc), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            names, kinds = zip(*(x.split() for x in READ.split(", ")), strict=True)
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "bigint" else pa.string()) for c, k in zip(columns, kinds, strict=True)], list(names))

    return spark.read.format("media_archive").load(folder).select("name", "media").mapInArrow(run, READ)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back of every text of ``documents`` stored as an image: sizes, hashes, the crc of the last samples, a feature.

    Null and empty texts are 64 bytes 0; texts of any length are stored whole; null ids,
    repeated ids and rows each give a row; an empty table gives none; other columns are not read.
    """
    return media_features(table(spark, sf_dir, "documents"))
