"""WARC archives by way of a chunked record table.

Payloads move as rows ``(record_id, chunk, data, bytes_so_far, digest, last)``.
The scan's row is the last place that holds a payload whole: Spark cuts it
into chunks there, and no Python worker, shuffle, writer or reader after it
holds more than chunks.  The SHA-1 is carried forward chunk by chunk, and
``digest`` on the last row is the payload's.  Written archives hold one gzip
member per record, in files that tasks write straight to the shared folder; a
manifest table names the files of the attempts that succeeded, so a retried or
lost task leaves nothing that a reader would see.

Of records with equal payloads the one with the largest identifier is the
response and the others are revisits that refer to it; payloads below
``revisit_from`` bytes are always responses.  Payloads are equal when length,
SHA-1 and a 128-bit xxhash agree.  Null payloads are empty.  A null identifier
is written as ``null`` and ranks below all others.  Rows with equal
identifiers and payloads are all responses if any of them is.  Extra columns
are ignored, an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import attempt_name, broadcast_if_small, materialize, open_input, open_output, scratch, shared_dir

CHUNK_BYTES = 1 << 20
REVISIT_FROM = 0
#: Rows of about 300 bytes that are broadcast at most: 60 MB.
MOST_BROADCAST = 200_000
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_CHUNKS = "uid long, record_id long, url string, payload_key string, chunk int, data binary, bytes_so_far long, digest string, identity binary, last boolean"
_CHUNK_SCHEMA = pa.schema(
    [("uid", pa.int64()), ("record_id", pa.int64()), ("url", pa.string()), ("payload_key", pa.string()), ("chunk", pa.int32()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest", pa.string()), ("identity", pa.binary()), ("last", pa.bool_())]
)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _batches(rows, schema, most: int = 8 << 20):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def chunk_table(df: DataFrame, record_id: str, url: str, payload: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of ``df``; an empty payload has one empty chunk.

    Without data only the last row of each record is given, which has its
    length, digest and identity.  ``uid`` tells the rows of a record apart
    within one job; ``payload_key`` finds the record again in another.
    """
    body = F.coalesce(F.col(payload).cast("string").cast("binary"), F.lit(b""))
    whole = df.select(
        F.monotonically_increasing_id().alias("uid"), F.col(record_id).cast("long").alias("record_id"), F.col(url).cast("string").alias("url"),
        F.concat_ws(":", F.octet_length(body).cast("string"), F.hex(F.xxhash64(body))).alias("payload_key"), body.alias("body"), F.octet_length(body).alias("total"),
    )
    last = F.floor((F.greatest(F.col("total"), F.lit(1)) - 1) / chunk_bytes).cast("int")
    pieces = whole.withColumn("last_chunk", last).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("last_chunk"))))
    cut = pieces.select("uid", "record_id", "url", "payload_key", "chunk", F.col("chunk") == F.col("last_chunk"), F.substr("body", (F.col("chunk") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes)).alias("data"))

    def run(batches):
        import xxhash

        sha = other = None

        def rows():
            nonlocal sha, other, done
            for batch in batches:
                uids, ids, urls, keys, chunks, lasts = (batch.column(k).to_pylist() for k in range(6))
                for i, data in enumerate(batch.column(6)):
                    if chunks[i] == 0:
                        sha, other, done = hashlib.sha1(), xxhash.xxh3_128(), 0
                    piece = memoryview(data.as_buffer())
                    sha.update(piece)
                    other.update(piece)
                    done += len(piece)
                    if with_data or lasts[i]:
                        yield uids[i], ids[i], urls[i], keys[i], chunks[i], bytes(piece) if with_data else None, done, base32_sha1(sha.digest()), other.digest() if lasts[i] else None, lasts[i]

        done = 0
        yield from _batches(rows(), _CHUNK_SCHEMA)

    return cut.mapInArrow(run, _CHUNKS)


def record_types(ends: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """From the last chunks of all records, one row for each different ``(record_id, payload_key)``.

    Adds ``total, payload_digest, record_type, refers_to``.
    """
    payload = ["payload_key", "bytes_so_far", "digest", "identity"]
    rows = materialize(ends.groupBy("record_id", *payload).agg(F.count("*").alias("copies")), "records")
    best = materialize(rows.groupBy(*payload).agg(F.max("record_id").alias("best"), F.count("*").alias("n")).filter("n > 1").select(*payload, "best"), "responses")
    revisit = F.col("best").isNotNull() & (F.col("bytes_so_far") >= revisit_from) & ~F.col("record_id").eqNullSafe(F.col("best"))
    return rows.join(broadcast_if_small(best, MOST_BROADCAST), payload, "left").select(
        F.col("record_id").alias("_r"), F.col("payload_key").alias("_k"),
        F.col("bytes_so_far").alias("total"), F.col("digest").alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("best")).alias("refers_to"),
    )


class _Member:
    """One gzip member of a file, written piece by piece."""

    def __init__(self, out):
        self.out, self.deflate = out, zlib.compressobj(1, zlib.DEFLATED, 31)

    def write(self, data) -> None:
        self.out.write(self.deflate.compress(data))

    def close(self) -> None:
        self.out.write(self.deflate.flush())


_MANIFEST = "path string, records long, bytes long"


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write chunk rows that carry ``record_type`` and ``refers_to``; returns the manifest, one row per archive.

    The rows of a record must lie together and in order within a partition.
    Content-Length comes from ``total``, the digest from ``payload_digest``.
    """

    def run(batches):
        out = path = member = None
        records = 0
        for batch in batches:
            for uid, record_id, url, chunk, data, total, digest, kind, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                del uid
                if out is None:
                    path = f"{folder}/{attempt_name()}.warc.gz"
                    out = open_output(path)
                if chunk == 0:
                    records += 1
                    length = len(HTTP_HEAD) + (total if kind == "response" else 0)
                    head = [
                        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{'null' if record_id is None else record_id}>",
                        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
                        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {total}",
                        *([f"WARC-Refers-To: <urn:record:{'null' if refers is None else refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
                        "Content-Type: application/http; msgtype=response", f"Content-Length: {length}", "", "",
                    ]
                    member = _Member(out)
                    member.write("\r\n".join(head).encode())
                    member.write(HTTP_HEAD)
                    written = 0
                elif kind == "revisit":
                    continue
                if kind == "response":
                    member.write(data)
                    written += len(data)
                    if written < total:
                        continue
                member.write(b"\r\n\r\n")
                member.close()
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

    columns = ["uid", "record_id", "url", "chunk", "data", "total", "payload_digest", "record_type", "refers_to"]
    return chunks.select(*columns).mapInArrow(run, _MANIFEST)


def read_records(path: str, piece: int = CHUNK_BYTES):
    """Stream one archive: yield ("head", headers) and then ("data", bytes) pieces of the payload for each record."""
    source = open_input(path)
    inflate, buffer, state, left, skip = zlib.decompressobj(31), bytearray(), "head", 0, 0
    while True:
        raw = source.read(piece)
        while raw:
            buffer += inflate.decompress(raw)
            raw = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            else:
                raw = b""
        ended = source.tell() >= source.size()
        while True:
            if state == "head":
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                lines = bytes(buffer[:end]).decode().split("\r\n")
                del buffer[: end + 4]
                headers = dict(x.split(": ", 1) for x in lines[1:])
                left, state = int(headers["Content-Length"]), "http"
                yield "head", headers
            elif state == "http":
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                left -= end + 4
                del buffer[: end + 4]
                state = "body"
            elif state == "body":
                take = min(left, len(buffer))
                if take:
                    yield "data", bytes(buffer[:take])
                    del buffer[:take]
                    left -= take
                if left:
                    break
                state, skip = "tail", 4
            else:
                take = min(skip, len(buffer))
                del buffer[:take]
                skip -= take
                if skip:
                    break
                state = "head"
        if ended and not raw:
            break
    source.close()


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean"
_READ_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("verified", pa.bool_())])


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives that a manifest names; a response's digest is computed anew from its payload."""

    def number(urn: str | None):
        text = (urn or "").removeprefix("<urn:record:").removesuffix(">")
        return int(text) if text not in ("", "null") else None

    def run(batches):
        def rows():
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    headers, sha, size = None, None, 0

                    def row():
                        digest, total = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["WARC-Payload-Length"])
                        whole = headers["WARC-Type"] == "response"
                        own = base32_sha1(sha.digest()) if whole else digest
                        return number(headers["WARC-Record-ID"]), size if whole else total, own, headers["WARC-Type"], number(headers.get("WARC-Refers-To")), own == digest and (size == total or not whole)

                    for kind, x in read_records(path):
                        if kind == "data":
                            sha.update(x)
                            size += len(x)
                            continue
                        if headers is not None:
                            yield row()
                        headers, sha, size = x, hashlib.sha1(), 0
                    if headers is not None:
                        yield row()

        yield from _batches(rows(), _READ_SCHEMA, 2 << 20)

    files = max(1, manifest.count())
    return manifest.repartition(min(files, 10_000)).select("path").mapInArrow(run, _READ)


def archive(
    df: DataFrame, record_id: str, url: str, payload: str, folder: str | None = None, revisit_from: int = REVISIT_FROM, chunk_bytes: int = CHUNK_BYTES, most_broadcast: int = MOST_BROADCAST
) -> DataFrame:
    """Write ``df`` as WARC files; returns the manifest as a table.

    The payloads are read twice, first for their digests, then to be written
    where they lie; they are shuffled only if the table of record types, of about
    300 bytes a row, has more than ``most_broadcast`` rows.
    """
    with scratch() as keep:
        ends = chunk_table(df, record_id, url, payload, chunk_bytes, with_data=False).select("record_id", "payload_key", "bytes_so_far", "digest", "identity")
        types = materialize(record_types(ends, revisit_from), "types")
        chunks = chunk_table(df, record_id, url, payload, chunk_bytes)
        same = F.col("record_id").eqNullSafe(F.col("_r")) & (F.col("payload_key") == F.col("_k"))
        if types.count() <= most_broadcast:
            rows = chunks.join(F.broadcast(types), same)
        else:
            rows = chunks.join(types, same).sortWithinPartitions("uid", "chunk")
        manifest = materialize(write_archives(rows, folder or f"{shared_dir(df.sparkSession)}/warc"), "manifest")
        keep.append(manifest)
    return manifest
