"""Web archives by way of a chunked record table.

Payloads become rows (record, chunk number, bytes) of bounded size; each row carries the digest of the
payload up to its end, so the last row of a record has the payload's digest and a reader can check every
prefix.  Chunks are slices of the Arrow buffer of the text; no worker holds a second copy of a whole record.
The archive writer holds one Arrow batch of chunks (64 MB unless Spark is set otherwise) and a copy of one chunk,
the reader one buffer.

Records with equal payloads of at least ``min_bytes``: the one with the largest id is a response, the others
are revisits of it.  Archives are gzip members, one a record, in files named by task attempt; the manifest,
written by Spark, lists the files of the attempts that were committed, and readers go by it.

Defined results for odd input: a null payload is empty; a null id is smaller than any other and is written
as ``null``; rows with equal ids are records of their own (of equal payloads, one is the response); control
characters and spaces in the address are percent-encoded; null addresses are left out; an empty table gives
an empty manifest and no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, table, written

CHUNK_BYTES = 256 * 1024
#: Bytes of chunks that one Arrow batch holds, about.
BATCH_BYTES = 4 * 1024 * 1024
GZIP_LEVEL = 3
#: Payload bytes that one archive holds, about.
ARCHIVE_BYTES = 64 * 1024 * 1024

CHUNK_SCHEMA = "record_id long, page_id long, url string, n_bytes long, chunk_no int, is_last boolean, digest string, chunk binary"
MANIFEST_SCHEMA = "path string, n_records long, n_payload_bytes long"
RECORD_SCHEMA = "record_id long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(state) -> str:
    return base64.b32encode(state.digest()).decode()


def chunk_table(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table, written once so that record ids (task and place) are fixed."""
    names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = (TaskContext.get().partitionId() << 33) - 1
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.binary()]
        for batch in batches:
            rows, held = [], 0
            for key, address, value in zip(batch.column(0), batch.column(1), batch.column(2)):
                record += 1
                data = memoryview(value.as_buffer() if value.is_valid else b"")
                state, n = hashlib.sha1(), len(data)
                for k, at in enumerate(range(0, max(n, 1), chunk_bytes)):
                    part = data[at : at + chunk_bytes]
                    state.update(part)
                    rows.append((record, key.as_py(), address.as_py(), n, k, at + chunk_bytes >= n, base32_sha1(state.copy()), bytes(part)))
                    held += len(part)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    slim = pages.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{url}`").cast("string"), F.coalesce(F.col(f"`{payload}`"), F.lit("")))
    return written(slim.mapInArrow(run, CHUNK_SCHEMA), "chunks")


def verdicts(chunks: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``record_id, record_type, to_page, to_record``; slim rows only.

    Both sides of the join are plain exchanges, so a hot digest is split over tasks by the adaptive plan.
    """
    last = chunks.where("is_last").select("record_id", "page_id", "n_bytes", "digest")
    shared = last.where(F.col("n_bytes") >= min_bytes)
    top = shared.groupBy("digest", "n_bytes").agg(F.max(F.struct("page_id", "record_id")).alias("top"), F.count("*").alias("n"))
    top = written(top.where("n > 1").select("digest", "n_bytes", F.col("top.page_id").alias("to_page"), F.col("top.record_id").alias("to_record")), "payload-groups")
    joined = last.join(top, ["digest", "n_bytes"], "left")
    revisit = F.col("to_record").isNotNull() & (F.col("to_record") != F.col("record_id"))
    return joined.select(
        "record_id",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("to_page")).alias("to_page"),
        F.when(revisit, F.col("to_record")).alias("to_record"),
    )


def store_of(uri: str):
    """The store and path of an address; Spark's names for S3 are known here too."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def record_uri(page: int | None, record: int) -> str:
    return f"<urn:page:{'null' if page is None else page}:{record}>"


def _clean_uri(address: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", address)


def _head(row: dict, kind: str, to_page: int | None, to_record: int | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_uri(row['page_id'], row['record_id'])}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_clean_uri(row['url'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    lines.append(f"WARC-Payload-Length: {row['n_bytes']}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_uri(to_page, to_record)}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if kind == 'revisit' else row['n_bytes']}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archives(chunks: DataFrame, verdict: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives under ``folder`` (a path all executors share) and returns the manifest.

    Chunks and verdicts of a record meet by one exchange and a sort; the verdict comes first.
    """
    full = chunks.where("is_last").select("record_id", F.col("digest").alias("payload_digest"))
    lead = verdict.join(full, "record_id").select(
        "record_id", F.lit(-1).alias("chunk_no"), "record_type", "to_page", "to_record", "payload_digest",
        F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("long").alias("n_bytes"), F.lit(None).cast("boolean").alias("is_last"), F.lit(None).cast("binary").alias("chunk"),
    )
    body = chunks.select(
        "record_id", "chunk_no", *[F.lit(None).cast("string").alias(c) for c in ("record_type",)], *[F.lit(None).cast("long").alias(c) for c in ("to_page", "to_record")],
        F.lit(None).cast("string").alias("payload_digest"), "page_id", "url", "n_bytes", "is_last", "chunk",
    )
    total = chunks.where("is_last").agg(F.sum("n_bytes")).first()[0] or 0
    n = max(chunks.sparkSession.sparkContext.defaultParallelism, -(-total // archive_bytes))
    dealt = lead.unionByName(body).repartition(int(n), "record_id").sortWithinPartitions("record_id", "chunk_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        out = member = verdict_row = None
        n_records = n_bytes = 0
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: column[at].as_py() for name, column in zip(batch.schema.names, batch.columns)}
                if row["chunk_no"] < 0:
                    verdict_row = row
                    continue
                if out is None:
                    out = store.open_output_stream(name)
                kind = verdict_row["record_type"]
                if row["chunk_no"] == 0:
                    member = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                    head = _head(row | {"payload_digest": verdict_row["payload_digest"]}, kind, verdict_row["to_page"], verdict_row["to_record"])
                    out.write(member.compress(head))
                    n_records += 1
                if kind == "response":
                    out.write(member.compress(row["chunk"]))
                    n_bytes += len(row["chunk"])
                if row["is_last"]:
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"]), pa.array([n_records], pa.int64()), pa.array([n_bytes], pa.int64())], ["path", "n_records", "n_payload_bytes"])

    return written(dealt.mapInArrow(run, MANIFEST_SCHEMA), "manifest")


class _Members:
    """The bytes of an archive of gzip members as one stream, a bounded buffer at a time."""

    def __init__(self, source, block: int = 1 << 18):
        self.source, self.block, self.inner, self.rest, self.buffer, self.ended = source, block, None, b"", b"", False

    def _fill(self) -> bool:
        while True:
            if not self.rest:
                self.rest = self.source.read(self.block)
                if not self.rest:
                    return False
            if self.inner is None:
                self.inner = zlib.decompressobj(31)
            got = self.inner.decompress(self.rest, self.block)
            self.rest = self.inner.unconsumed_tail
            if self.inner.eof:
                self.rest, self.inner = self.inner.unused_data, None
            if got:
                self.buffer += got
                return True

    def until(self, end: bytes) -> bytes | None:
        """What comes before ``end``, which is passed over; None at the end of the stream."""
        while (at := self.buffer.find(end)) < 0:
            if not self._fill():
                return None
        found, self.buffer = self.buffer[:at], self.buffer[at + len(end) :]
        return found

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self._fill():
                raise ValueError("the archive ends within a record")
            part, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(part)
            yield part


def parse_archive(source) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Headers and the payload's pieces of each record; the pieces have to be used before the next record."""
    stream = _Members(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        yield headers, stream.pieces(int(headers["Content-Length"]))
        if stream.until(b"\r\n\r\n") != b"":
            raise ValueError("a record does not end where its length says")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of a manifest's archives; digests are computed again from the payload and compared."""
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def parts(uri: str) -> tuple[int | None, int]:
        _, _, page, record = uri.strip("<>").split(":")
        return None if page == "null" else int(page), int(record)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = store_of(path)
                rows = []
                with store.open_input_stream(name, buffer_size=1 << 18) as source:
                    for headers, payload in parse_archive(source):
                        state, n = hashlib.sha1(), 0
                        for part in payload:
                            state.update(part)
                            n += len(part)
                        kind, said = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and base32_sha1(state) != said:
                            raise ValueError(f"{path}: {headers['WARC-Record-ID']} has another digest than its header")
                        page, record = parts(headers["WARC-Record-ID"])
                        to = parts(headers["WARC-Refers-To"])[0] if kind == "revisit" else None
                        rows.append((record, page, headers.get("WARC-Target-URI"), n if kind == "response" else int(headers["WARC-Payload-Length"]), said, kind, to))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    spark = manifest.sparkSession
    n = max(1, min(manifest.count(), 10_000))
    return manifest.select("path").repartition(n, "path").mapInArrow(run, RECORD_SCHEMA) if n > 1 else manifest.select("path").mapInArrow(run, RECORD_SCHEMA)


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes all pages as archives under ``folder`` (default: in the shared folder); returns the manifest."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    chunks = chunk_table(pages, id_col, url, payload)
    return write_archives(chunks, verdicts(chunks, min_bytes), folder)


def op9_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return read_archives(archive(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
