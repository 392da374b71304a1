"""WARC archives as a chunked record table.

:func:`write_warc` writes one WARC/1.1 record per page into archives under a
shared folder; :func:`read_chunks` reads archives as a table with one row per
(record, chunk number).  A payload is streamed: the reader holds one chunk,
feeds it to a running SHA-1 and emits the digest so far with the chunk, so a
record of any size needs the memory of one chunk.

Scale: archives roll over at a size bound, so a read task has a bounded file
and the number of tasks follows the data.  A retried write task makes files
under a new name; only the files that a finished task reports are read.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsepanel.llm.common import type_of
from pulsepanel.session import checkpoint_dir
from pulsepanel.sources.sinks import materialize

CHUNK_BYTES = 256 * 1024
ARCHIVE_BYTES = 128 * 1024 * 1024
#: Smaller payloads are always stored in full.
REVISIT_BYTES = 1000
#: Bytes of chunks that a reader hands on at once.
BATCH_BYTES = 4 * 1024 * 1024

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_SCHEMA = ("archive string, record_at bigint, record_id string, record_type string, "
                "url string, page_key string, refers_key string, payload_length bigint, "
                "header_digest string, chunk_no bigint, chunk binary, digest_so_far string, "
                "last boolean")


def _open_fs(uri: str):
    """File system and path of a folder URI (``file:``, ``hdfs:``, ``s3:`` ...)."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        uri = "file://" + uri
    return pafs.FileSystem.from_uri(uri)


def _safe(text: str) -> str:
    """A header value: everything but visible ASCII is percent-encoded."""
    return quote(text, safe="%/:=&?~#+!$,;'@()*[]")


def record_head(kind: str, record_id: str, url: str | None, digest: str, length: int,
                page_key: str | None, refers_key: str | None) -> bytes:
    """WARC header and HTTP header of a record; a response's payload follows."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {length}\r\n\r\n").encode()
    block = len(http) + (length if kind == "response" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>",
             "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    if page_key is not None:
        lines.append(f"X-Page-Key: {quote(page_key, safe='')}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
        lines.append(f"X-Refers-To-Page: {quote(refers_key, safe='')}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


class _Roll:
    """The archive a write task is at; a new one once the size bound is reached."""

    def __init__(self, folder: str, prefix: str, limit: int):
        self.fs, self.base = _open_fs(folder)
        self.prefix, self.limit = prefix, limit
        self.made: list[tuple[str, int, int]] = []
        self.out = None

    def write(self, *parts: bytes) -> None:
        if self.out is not None and self.size >= self.limit:
            self.close()
        if self.out is None:
            self.fs.create_dir(self.base, recursive=True)
            self.name = f"{self.prefix}-{len(self.made):05d}.warc"
            self.out = self.fs.open_output_stream(f"{self.base}/{self.name}")
            self.size = self.records = 0
        for part in parts:
            self.out.write(part)
            self.size += len(part)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.made.append((self.name, self.records, self.size))
            self.out = None


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
               body_col: str = "html", revisit_bytes: int = REVISIT_BYTES,
               archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives; returns the manifest (archive, records, bytes).

    Of records with equal payloads (by SHA-1) of at least ``revisit_bytes``
    bytes, the one with the largest id is a response and the others revisit
    it; smaller ones are responses.  A null body is an empty payload.  Null
    ids count as smallest; a group of null ids only is stored in full.  Rows
    that repeat the largest id are each a response.  An empty table gives an
    empty manifest.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"),
                        body.alias("_body"), F.sha1(F.encode(body, "UTF-8")).alias("_sha"),
                        F.octet_length(body).alias("_len"))
    # Only payloads that occur again are joined; the table is narrow.
    again = materialize(
        rows.where(F.col("_len") >= revisit_bytes).groupBy("_sha")
        .agg(F.max("_id").alias("_top"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
        .select("_sha", "_top"), "warc-repeated")
    marked = rows.join(again, "_sha", "left")
    revisit = F.col("_top").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_top")) & (
        F.col("_len") >= revisit_bytes)
    marked = marked.select(F.col("_id").cast("string").alias("key"),
                           F.col("_url").cast("string").alias("url"), "_sha", "_len",
                           F.when(revisit, F.col("_top").cast("string")).alias("refers"),
                           F.when(~revisit, F.col("_body")).alias("body"))

    def write(batches):
        task = TaskContext.get()
        roll = _Roll(folder, f"part-{task.partitionId():06d}-{task.taskAttemptId()}", archive_bytes)
        for batch in batches:
            keys, urls, shas, lens, refers = (batch.column(i).to_pylist() for i in range(5))
            bodies = batch.column(5)
            for i, key in enumerate(keys):
                kind = "response" if refers[i] is None else "revisit"
                head = record_head(kind, str(uuid.uuid4()), urls[i], shas[i], lens[i], key, refers[i])
                payload = bodies[i].as_buffer() if kind == "response" else b""
                roll.write(head, payload, b"\r\n\r\n")
        roll.close()
        names, records, sizes = zip(*roll.made) if roll.made else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{n}" for n in names], pa.string()),
             pa.array(records, pa.int64()), pa.array(sizes, pa.int64())],
            names=["archive", "records", "bytes"])

    manifest = marked.mapInArrow(write, "archive string, records bigint, bytes bigint")
    return materialize(manifest, "warc-manifest")


def _header(stream) -> dict[str, str] | None:
    """The next header block as lower-case names to values; None at the end."""
    fields: dict[str, str] = {}
    while True:
        line = stream.readline()
        if not line:
            return None
        line = line.rstrip(b"\r\n")
        if not line:
            if fields:
                return fields
            continue  # the blank lines after a record
        name, _, value = line.decode().partition(":")
        fields[name.strip().lower()] = value.strip()


def records(stream, chunk_bytes: int = CHUNK_BYTES):
    """Yields (offset, header, payload length, chunk number, chunk, digest so
    far, last) for each chunk of each record; an empty payload has one empty
    chunk."""
    while True:
        at = stream.tell()
        head = _header(stream)
        if head is None:
            return
        left = int(head["content-length"])
        length = left
        if head.get("content-type", "").startswith("application/http"):
            began = stream.tell()
            http = _header(stream)
            left -= stream.tell() - began
            length = int(http["content-length"])
        digest, number = hashlib.sha1(), 0
        while True:
            chunk = stream.read(min(chunk_bytes, left)) if left else b""
            left -= len(chunk)
            if left and not chunk:
                raise EOFError(f"record at {at} ends early")
            digest.update(chunk)
            yield at, head, length, number, chunk, digest.hexdigest(), not left
            number += 1
            if not left:
                break


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of the archives that a manifest (column ``archive``) lists."""
    schema = pa.schema([
        ("archive", pa.string()), ("record_at", pa.int64()), ("record_id", pa.string()),
        ("record_type", pa.string()), ("url", pa.string()), ("page_key", pa.string()),
        ("refers_key", pa.string()), ("payload_length", pa.int64()), ("header_digest", pa.string()),
        ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("digest_so_far", pa.string()),
        ("last", pa.bool_())])

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                folder, _, leaf = name.rpartition("/")
                store, base = _open_fs(folder)
                rows, held = [], 0
                with io.BufferedReader(store.open_input_file(f"{base}/{leaf}"), 64 * 1024) as raw:
                    for at, head, length, number, chunk, digest, last in records(raw, chunk_bytes):
                        rows.append((name, at, head["warc-record-id"], head["warc-type"],
                                     head.get("warc-target-uri"), head.get("x-page-key"),
                                     head.get("x-refers-to-page"), length,
                                     head.get("warc-payload-digest", "").removeprefix("sha1:"),
                                     number, chunk, digest, last))
                        held += len(chunk) + 400
                        if held >= BATCH_BYTES:
                            yield _batch(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, schema)

    spread = manifest.select("archive").repartition(
        max(1, manifest.count()), F.xxhash64("archive"))
    return spread.mapInArrow(read, CHUNK_SCHEMA)


def _batch(rows, schema):
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)],
                                      schema=schema)


def page_records(pages: DataFrame, folder: str | None = None, id_col: str = "page_id",
                 url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Writes the archives, reads them back and returns one row per record.

    Length and digest of a response are measured on its chunks; a revisit
    has those of the response that it refers to.
    """
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
    manifest = write_warc(pages, folder, id_col, url_col, body_col)
    kind = type_of(pages, id_col)
    # A record's chunks are neighbours in one task, so its last chunk has the
    # running digest and, with the chunk number, the measured length.
    chunks = read_chunks(manifest)
    found = materialize(
        chunks.where("last").select(
            F.expr("url_decode(page_key)").cast(kind).alias(id_col), "record_type",
            F.expr("url_decode(refers_key)").cast(kind).alias("refers_to"),
            (F.col("chunk_no") * CHUNK_BYTES + F.octet_length("chunk")).alias("_bytes"),
            F.col("digest_so_far").alias("_digest"), "payload_length", "header_digest"),
        "warc-records")
    answers = (found.where("record_type = 'response'")
               .groupBy(F.col(id_col).alias("_rid"), F.col("_digest").alias("_rdigest"))
               .agg(F.first("_bytes").alias("_rbytes")))
    answers = materialize(answers.join(
        found.where("record_type = 'revisit'").select(
            F.col("refers_to").alias("_rid"), F.col("header_digest").alias("_rdigest")).distinct(),
        ["_rid", "_rdigest"]), "warc-referred")
    revisits = found.where("record_type = 'revisit'").join(
        answers, (F.col("refers_to") == F.col("_rid")) & (F.col("header_digest") == F.col("_rdigest")))
    own = found.where("record_type = 'response'")
    return (own.select(id_col, F.col("_bytes").alias("payload_bytes"),
                       F.col("_digest").alias("payload_digest"), "record_type", "refers_to")
            .unionByName(revisits.select(id_col, F.col("_rbytes").alias("payload_bytes"),
                                         F.col("_rdigest").alias("payload_digest"), "record_type",
                                         "refers_to")))
