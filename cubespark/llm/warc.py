"""WARC archives: written as whole-file gzip streams, normalised to a member for each record, and read by offset.

``write`` puts records in archives of about ``archive_bytes`` and compresses each
archive as one gzip stream, as careless writers do.  ``normalise`` inflates such a
stream once, from start to end, and rewrites every record as a gzip member of its
own beside a sidecar index of offsets; ``read`` opens members at those offsets.
Files lie in the folder that driver and executors share; a task that is run again
writes files of other names, and only those that a finished task reports count.

Of records with equal payloads of at least ``least_bytes`` bytes the one with the
smallest key is a response, the others revisit it and carry no payload: their
headers tell the digest and length of the full one.

Null payloads count as empty; records without a key are revisits where a keyed
record has the same payload, else responses; rows that repeat the smallest key are
all responses; null or odd URIs are escaped; very long payloads are one record like
any other (a record is held whole, an archive never); an empty table gives no archive
and no rows; extra columns stay out.  An archive that is cut off, at the edge of a
record or inside one, or that holds another number of records than were written, raises.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import as_rows, renamed, shared_folder, stored

ARCHIVES = pa.schema([("archive", pa.string()), ("records", pa.int64())])
READ = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("archive", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])
READ_DDL = "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, archive string, offset bigint, size bigint"
PIECE = 1 << 20
NAME = re.compile(rb"<urn:page:(-?\d+|none)>")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _named(key: int | None) -> str:
    return f"<urn:page:{'none' if key is None else key}>"


def record_bytes(key: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit has headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_named(key)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(uri or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_named(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """Headers, payload and payload length of one record."""
    end = record.index(b"\r\n\r\n")
    lines = record[:end].split(b"\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
    block = record[end + 4 : end + 4 + int(headers[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length:\s*(\d+)", http)[1])
    return {"headers": headers, "payload": payload, "payload_bytes": size}


def records_of(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream, by the lengths that they state."""
    have = bytearray()
    for piece in pieces:
        have += piece
        at = 0
        while (end := have.find(b"\r\n\r\n", at)) >= 0:
            size = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", have[at : end + 2])
            stop = end + 4 + int(size[1]) + 4
            if stop > len(have):
                break
            yield bytes(have[at:stop])
            at = stop
        del have[:at]
    if have:
        raise ValueError("the archive ends inside a record")


def inflated(file) -> Iterator[bytes]:
    """A gzip file, of one member or many, in pieces of at most ``PIECE`` bytes; a file that ends inside a member raises."""
    z, begun = zlib.decompressobj(31), False
    while piece := file.read(PIECE):
        while piece:
            begun = True
            if out := z.decompress(piece, PIECE):
                yield out
            piece = z.unconsumed_tail
            if z.eof:
                piece, z, begun = z.unused_data, zlib.decompressobj(31), False
    while begun and (out := z.decompress(b"", PIECE)):
        yield out
    if begun and not z.eof:
        raise ValueError("the archive ends inside a gzip member")


def member(record: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def write(records: DataFrame, folder: str, archive_bytes: int = 16 << 20) -> DataFrame:
    """(archive, records): archives of records (key, uri, payload, digest, refers_to, revisit), each one gzip stream."""

    def written(batches):
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        name, out, z, size, n = None, None, None, 0, 0

        def closed():
            out.write(z.flush())
            out.close()
            return as_rows(ARCHIVES, archive=[name], records=[n])

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for row in batch.slice(lo, 64).to_pylist():
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, z, size, n = system.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                    one = record_bytes(row["key"], row["uri"], row["payload"], row["digest"], row["refers_to"], row["revisit"])
                    out.write(z.compress(one))
                    size, n = size + len(one), n + 1
                    if size >= archive_bytes:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    return stored(records.mapInArrow(written, "archive string, records bigint"), "archives")


def _normalised(system, root: str, name: str) -> tuple[str, int]:
    fresh, index, at = f"{uuid.uuid4().hex}.warc.gz", [], 0
    with system.open_input_stream(f"{root}/{name}", compression=None) as source, system.open_output_stream(f"{root}/{fresh}", compression=None) as target:
        for record in records_of(inflated(source)):
            packed = member(record)
            target.write(packed)
            found = NAME.search(record)
            index.append({"record": found[0].decode(), "offset": at, "size": len(packed)})
            at += len(packed)
    with system.open_output_stream(f"{root}/{fresh}.idx", compression=None) as sidecar:
        sidecar.write("".join(json.dumps(x) + "\n" for x in index).encode())
    return fresh, len(index)


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, records): each archive rewritten with a gzip member for every record and a sidecar ``.idx`` of offsets."""

    def rewritten(batches):
        system, root = _open(folder)
        for batch in batches:
            for name, wanted in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist()):
                fresh, n = _normalised(system, root, name)
                if n != wanted:
                    raise ValueError(f"{name} has {n} records, {wanted} were written")
                yield as_rows(ARCHIVES, archive=[fresh], records=[n])

    n = max(1, min(archives.count(), 4 * archives.sparkSession.sparkContext.defaultParallelism))
    return stored(archives.repartition(n).mapInArrow(rewritten, "archive string, records bigint"), "members")


def _members(system, root: str, name: str):
    with system.open_input_stream(f"{root}/{name}.idx", compression=None) as f:
        places = [json.loads(x) for x in f.read().decode().splitlines()]
    with system.open_input_file(f"{root}/{name}") as f:
        for x in places:
            f.seek(x["offset"])
            yield x, zlib.decompress(f.read(x["size"]), 31)


def read(archives: DataFrame, folder: str) -> DataFrame:
    """A row for each record of normalised archives, opened at the offsets of the index.

    The digest of a response is computed from its payload, and one that differs from the header raises.
    """
    import hashlib

    def opened(batches):
        system, root = _open(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows = []
                for place, raw in _members(system, root, name):
                    one = parse(raw)
                    headers = one["headers"]
                    kind, key, other = headers[b"warc-type"].decode(), NAME.search(headers[b"warc-record-id"])[1], headers.get(b"warc-refers-to")
                    digest = headers[b"warc-payload-digest"].decode().removeprefix("sha256:")
                    if kind == "response" and (hashlib.sha256(one["payload"]).hexdigest() != digest or len(one["payload"]) != one["payload_bytes"]):
                        raise ValueError(f"record {key} of {name} is damaged")
                    rows.append((None if key == b"none" else int(key), kind, int(NAME.search(other)[1]) if other else None, one["payload_bytes"], digest, one["payload"] if kind == "response" else None, name, place["offset"], place["size"]))
                    if len(rows) == 256:
                        yield as_rows(READ, **{n: [r[i] for r in rows] for i, n in enumerate(READ.names)})
                        rows = []
                if rows:
                    yield as_rows(READ, **{n: [r[i] for r in rows] for i, n in enumerate(READ.names)})

    n = max(1, min(archives.count(), 4 * archives.sparkSession.sparkContext.defaultParallelism))
    return archives.repartition(n).mapInArrow(opened, READ_DDL)


def records(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", least_bytes: int = 100) -> DataFrame:
    """Rows for ``write``: digests, and which records revisit which."""
    rows = renamed(pages, key, uri, payload).select(F.col(key).cast("bigint").alias("key"), F.col(uri).cast("string").alias("uri"), F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("long_digest", F.when(F.octet_length("payload") >= least_bytes, F.col("digest")))
    # Short payloads meet nothing: each has a join key of its own, so that they do not gather where a null would be sent.
    rows = rows.withColumn("long_digest", F.coalesce("long_digest", F.concat(F.lit("short "), F.xxhash64("key", "uri", "digest").cast("string"))))
    first = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("long_digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = rows.join(first, "long_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return joined.select("key", "uri", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Writes, normalises and reads back all pages."""
    folder = shared_folder(pages.sparkSession, "warc")
    return read(normalise(write(records(pages, **columns), folder), folder), folder)
