"""WARC archives: writing, reading, and resolving revisits.

Captures are first written as they come, one response each. Only their headers then
meet: digests are pre-aggregated to the record that stays, joined back to the headers,
and a second pass copies the staying records by byte range into new archives, where
all other captures become revisit records with fresh headers and no payload. Files are
bounded in size, and every attempt of a task writes files of its own, of which only
those that the successful attempt reports are ever read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_kept, materialize, open_folder, shared_dir, slices, table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

HEADERS = "page_id bigint, uri string, digest string, length bigint, file string, offset bigint, size bigint"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def response_record(page_id: int | None, uri: str | None, payload: bytes, digest: str, record_id: str) -> bytes:
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("WARC-Target-URI", clean(uri)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", "" if page_id is None else str(page_id)), ("Content-Type", "application/http; msgtype=response")]
    return record_bytes(fields, http_head(len(payload)) + payload)


def revisit_record(page_id: int | None, uri: str | None, length: int, digest: str, record_id: str, refers_id: str, refers_uri: str | None) -> bytes:
    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("WARC-Target-URI", clean(uri)), ("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_id), ("WARC-Refers-To-Target-URI", clean(refers_uri)), ("WARC-Refers-To-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", "" if page_id is None else str(page_id)), ("Content-Type", "application/http; msgtype=response")]
    return record_bytes(fields, http_head(length))


def clean(value: str | None) -> str:
    """A header value on one line: line breaks are percent-encoded, all else stays."""
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def record_name(file: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{offset}')}>"


class Writer:
    """Appends records to archives of at most ``limit`` bytes (one record may exceed it)."""

    def __init__(self, folder: str, kind: str, limit: int):
        self.fs, self.path = open_folder(folder)
        self.fs.create_dir(self.path, recursive=True)
        context = TaskContext.get()
        self.stem = f"{kind}-{context.partitionId():06d}-{context.taskAttemptId()}"
        self.limit, self.files, self.out, self.name, self.at = limit, 0, None, "", 0

    def add(self, make: Callable[[str, int], bytes]) -> tuple[str, int, int]:
        """Append the record that ``make`` gives for a file and an offset; returns both and its size."""
        record = make(self.name, self.at) if self.out is not None else b""
        if self.out is None or self.at and self.at + len(record) > self.limit:
            self.close()
            self.name, self.at = f"{self.stem}-{self.files:05d}.warc.gz", 0
            self.files += 1
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
            record = make(self.name, 0)
        self.out.write(record)
        self.at += len(record)
        return self.name, self.at - len(record), len(record)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def unpacked(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of a plain file or of one made of gzip members."""
    z, first, plain = None, True, False
    for chunk in chunks:
        if first:
            plain, first = not chunk.startswith(b"\x1f\x8b"), False
        if plain:
            yield chunk
            continue
        while chunk:
            z = z or zlib.decompressobj(31)
            yield z.decompress(chunk)
            chunk = z.unused_data
            if z.eof:
                z = None
    if z is not None:
        raise ValueError("the archive ends within a record")


def parse(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record of an archive."""
    buffer, source = bytearray(), unpacked(chunks)

    def fill(until) -> bool:
        while not until():
            more = next(source, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while True:
        if not fill(lambda: len(buffer) >= 4):
            return
        searched = 0

        def ended() -> bool:
            nonlocal searched
            at = buffer.find(b"\r\n\r\n", searched)
            searched = max(0, len(buffer) - 3) if at < 0 else at
            return at >= 0

        if not fill(ended):
            raise ValueError("the archive ends within a header")
        lines = bytes(buffer[:searched]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = searched + 4
        end = start + int(fields["content-length"])
        if not fill(lambda: len(buffer) >= end + 4):
            raise ValueError("the archive ends within a record")
        block = bytes(buffer[start:end])
        del buffer[: end + 4]
        yield fields, block


def file_chunks(fs, path: str, size: int = 1 << 20) -> Iterator[bytes]:
    with fs.open_input_stream(path, compression=None) as f:
        while chunk := f.read(size):
            yield chunk


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP message."""
    return block.partition(b"\r\n\r\n")[2]


def write_captures(pages: DataFrame, folder: str, limit: int = 64 << 20) -> DataFrame:
    """Write one response per row of ``pages`` (page_id, url, html); returns the headers with each record's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        writer = Writer(folder, "capture", limit)
        for b in slices(batches):
            rows = []
            for page_id, uri, html in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").cast(pa.large_binary()), strict=True):
                payload = html.as_py() or b""
                digest = digest_of(payload)
                place = writer.add(lambda file, at, of=(page_id, uri, payload, digest): response_record(*of, record_name(file, at)))
                rows.append((page_id, uri, digest, len(payload), *place))
            yield to_batch(rows, HEADERS)
        writer.close()

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, HEADERS)


ARROW = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}


def to_batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in ddl.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Decide, for every header, whether the record stays a response or revisits another.

    Of records with equal payloads (digest and length) of ``min_bytes`` or more, the
    one with the largest page_id stays; among equal ids the last written. Adds
    refers_file, refers_offset, refers_page and refers_uri, all null for responses.
    """
    place = F.struct("page_id", "file", "offset", "uri")
    stays = headers.where(F.col("length") >= min_bytes).groupBy("digest", "length").agg(F.max(place).alias("first"))
    h = headers.join(stays, ["digest", "length"], "left")
    other = F.col("first").isNotNull() & ~((F.col("first.file") == F.col("file")) & (F.col("first.offset") == F.col("offset")))
    return h.select(*headers.columns, *[F.when(other, F.col(f"first.{k}")).alias(f"refers_{to}") for k, to in (("file", "file"), ("offset", "offset"), ("page_id", "page"), ("uri", "uri"))])


def write_resolved(decided: DataFrame, captures: str, folder: str, limit: int = 64 << 20, parts: int = 1) -> DataFrame:
    """Write the deduplicated archives in ``parts`` tasks; returns (file, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        fs, path = open_folder(captures)
        writer, counts, now, source = Writer(folder, "archive", limit), {}, None, None
        for b in slices(batches):
            for r in b.to_pylist():
                own = record_name(r["file"], r["offset"])
                if r["refers_file"] is not None:
                    record = revisit_record(r["page_id"], r["uri"], r["length"], r["digest"], own, record_name(r["refers_file"], r["refers_offset"]), r["refers_uri"])
                else:
                    if now != r["file"]:
                        if source is not None:
                            source.close()
                        now, source = r["file"], fs.open_input_file(f"{path}/{r['file']}")
                    (_, block), *rest = parse([source.read_at(r["size"], r["offset"])])
                    payload = payload_of(block)
                    if rest or len(payload) != r["length"]:
                        raise ValueError(f"{r['file']} has no such record at {r['offset']}")
                    record = response_record(r["page_id"], r["uri"], payload, r["digest"], own)
                name, _, _ = writer.add(lambda *_, record=record: record)
                counts[name] = counts.get(name, 0) + 1
        if source is not None:
            source.close()
        writer.close()
        yield to_batch(list(counts.items()), "file string, records bigint")

    # a file of captures is of bounded size, and its records are copied in order
    return decided.repartition(max(1, parts), "file").sortWithinPartitions("file", "offset").mapInArrow(run, "file string, records bigint")


READ = "record_id string, page_id bigint, record_type string, digest string, length bigint, refers_id string"


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives named in ``files`` (file); a response's digest and length are taken from its payload anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        fs, path = open_folder(folder)
        for b in slices(batches):
            for name in b.column("file").to_pylist():
                rows = []
                for h, block in parse(file_chunks(fs, f"{path}/{name}")):
                    page = int(h["x-page-id"]) if h["x-page-id"] else None
                    said = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response":
                        payload = payload_of(block)
                        if (digest := digest_of(payload)) != said:
                            raise ValueError(f"{name}: the payload of page {page} does not match its digest")
                        rows.append((h["warc-record-id"], page, "response", digest, len(payload), None))
                    else:
                        rows.append((h["warc-record-id"], page, h["warc-type"], said, None, h["warc-refers-to"]))
                yield to_batch(rows, READ)

    return files.select("file").repartition(max(1, files.count()), "file").mapInArrow(run, READ)


def deduplicated_archives(pages: DataFrame, *, min_bytes: int = 0, limit: int = 64 << 20) -> tuple[str, DataFrame]:
    """Write ``pages`` as deduplicated archives; returns their folder and (file, records)."""
    folder = shared_dir(pages.sparkSession)
    headers = materialize(write_captures(pages, f"{folder}/captures", limit))
    parts = headers.agg(F.count_distinct("file")).first()[0]
    return f"{folder}/archives", materialize(write_resolved(resolve(headers, min_bytes), f"{folder}/captures", f"{folder}/archives", limit, parts))


def revisits(pages: DataFrame, *, min_bytes: int = 0, limit: int = 64 << 20) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as deduplicated archives, read them back, and resolve the revisits.

    Returns page_id, payload_bytes, payload_digest (SHA-1 in base32), record_type and
    refers_to per page. Null and empty html are equal payloads of no bytes; null urls
    are empty headers. Null ids come before all others, so that they stay responses
    only among themselves. Of rows that repeat id and payload one is the response and
    the others revisit it. Other columns are ignored; an empty table gives no rows.
    """
    folder, files = deduplicated_archives(pages, min_bytes=min_bytes, limit=limit)
    read = materialize(read_archives(files, folder))
    responses, others = read.where("refers_id is null"), read.where("refers_id is not null")
    first = responses.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("length").alias("of_length"))
    resolved = others.drop("length").join(first, "refers_id").withColumnRenamed("of_length", "length")
    columns = ["page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("bigint")).select(*columns).unionByName(resolved.select(*columns))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every row of ``pages``, read back from archives.

    Null html is an empty payload; null and repeated ids, repeated rows, very long pages and
    an empty table: see ``revisits``. Columns other than page_id, url and html are not read.
    """
    return revisits(table(spark, sf_dir, "pages"))


#: SQL has no base32; octets of the hex digest are regrouped in fives.
OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, payload_bytes::BIGINT AS payload_bytes, hex, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS first,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT, 1) FOR k IN range(32)], '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
