"""WARC archives: a writer of one gzip member a record, and a sequential reader.

The reader decompresses piece by piece, so it holds one record at a time: a member ends where its zlib stream does, the
header ends at the empty line, Content-Length frames the block, and the block's digest is verified.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, durable, map_batches, record_batch, releasing, shared_dir

VERSION = b"WARC/1.1"
#: A payload of at least so many bytes is written once and else referred to.
REVISIT_BYTES = 1000
#: A task begins another archive after so many bytes.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 20
DATE = "2000-01-01T00:00:00Z"


def digest_field(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def hex_digest(field: str) -> str:
    return base64.b32decode(field.removeprefix("sha1:")).hex()


def member(fields: dict[str, str], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member; line ends within a field become spaces."""
    head = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in ({**fields, "Content-Length": str(len(block))}).items())
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


class FormatError(ValueError):
    pass


def read_records(stream: BinaryIO, read_bytes: int = READ_BYTES) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record, in order; field names are lower-case. A FormatError names what doesn't hold."""
    rest = b""
    while True:
        rest = rest or stream.read(read_bytes)
        if not rest:
            return
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not rest and not (rest := stream.read(read_bytes)):
                raise FormatError("an archive ends within a member")
            try:
                parts.append(unpacker.decompress(rest))
            except zlib.error as error:
                raise FormatError(f"no gzip member: {error}") from error
            rest = unpacker.unused_data
        data = b"".join(parts)
        head, gap, body = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not gap or lines[0] != VERSION.decode():
            raise FormatError("a member has no WARC header")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields.get("content-length", -1))
        if size < 0 or body[size:] != b"\r\n\r\n":
            raise FormatError("Content-Length does not frame the block")
        block = body[:size]
        if "warc-block-digest" in fields and fields["warc-block-digest"] != digest_field(block):
            raise FormatError("the block does not match its digest")
        yield fields, block


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def assign(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload binary, refers_to): refers_to is null for a response, else the page that has the payload.

    The largest page_id of each payload comes from an aggregate over (digest, size), so that one payload with very many
    pages is reduced before the shuffle; the join that follows has that payload as a skewed key of its left side.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.length("payload")})
    last = rows.select("page_id", "digest", "size").where(F.col("size") >= revisit_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    rows = rows.join(last.where("n > 1").drop("n"), ["digest", "size"], "left")
    return rows.select("page_id", "url", "payload", F.when(~F.coalesce("page_id", F.lit(-(1 << 63))).eqNullSafe(F.coalesce("last", "page_id", F.lit(-(1 << 63)))), F.col("last")).alias("refers_to"))


def write(assigned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of the rows of `assign` in the folder (a URI that every executor reaches); returns (archive, records) once
    all are written. A task names its archives by its partition and attempt, so an attempt never meets another's files;
    only archives of this list are read."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out, name, records, size, n = None, "", 0, 0, 0
        for batch in batches:
            payloads = as_bytes(batch.column(2))
            for i in range(batch.num_rows):
                if out is None:
                    name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.gz"
                    out, n = store.open_output_stream(f"{base}/{name}", compression=None), n + 1
                page, url, to = (batch.column(k)[i].as_py() for k in (0, 1, 3))
                payload = payloads[i].as_py()
                block = payload if to is None else b""
                fields = {
                    "WARC-Type": "response" if to is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>", "WARC-Date": DATE, "WARC-Target-URI": url,
                    "WARC-Payload-Digest": digest_field(payload), "WARC-Block-Digest": digest_field(block), "Content-Type": "text/html; charset=utf-8", "X-Payload-Length": str(len(payload)),
                }
                if to is not None:
                    fields |= {"WARC-Refers-To": f"<urn:page:{to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                data = member(fields, block)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    yield record_batch(archive=[name], records=[records])
                    out, records, size = None, 0, 0
        if out is not None:
            out.close()
            yield record_batch(archive=[name], records=[records])

    return durable(assigned.select("page_id", "url", "payload", "refers_to").mapInArrow(releasing(run), "archive string, records long"))


def read(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, url, payload]) of every record, one archive after
    the other in each task. A record that is damaged, and an archive that lacks records, raise."""

    def make():
        store, base = _open(folder)
        page = lambda x: int(y) if (y := (x or "").removeprefix("<urn:page:").removesuffix(">")) else None

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, n = [], 0, 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for fields, block in read_records(stream):
                        if fields["warc-type"] == "response" and digest_field(block) != fields["warc-payload-digest"]:
                            raise FormatError(f"{name}: a payload does not match its digest")
                        rows.append((page(fields["warc-record-id"]), int(fields["x-payload-length"]), hex_digest(fields["warc-payload-digest"]), fields["warc-type"], page(fields.get("warc-refers-to")), fields["warc-target-uri"], block))
                        held, n = held + len(block), n + 1
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield _rows(rows, with_payload)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows, with_payload)
                if n != expected:
                    raise FormatError(f"{name}: {n} records instead of {expected}")

        return each

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload
    return map_batches(archives, make, schema)


def _rows(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True), kinds[: 7 if with_payload else 5], strict=False)], names=[k for k, _ in kinds[: 7 if with_payload else 5]])


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages' archives, then read them back: `read`'s columns, a row for every page.

    Of pages with equal payloads of at least 1000 bytes the one with the largest page_id is the response (each one, if that
    id repeats; a missing id is the smallest); the others revisit it. A null html is an empty payload. An empty table
    gives no rows; columns but page_id, url and html are not read.
    """
    if folder is None:
        import uuid

        folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
        folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read(write(assign(pages), folder), folder)
