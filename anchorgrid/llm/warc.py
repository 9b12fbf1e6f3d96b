"""WARC archives: one gzip member per record, written by tasks and read back as a stream.

Writing: repeats of a payload become revisit records of the row with the smallest id. Every task writes files
of its own under a fresh name and returns their paths; the list of paths is kept as a table. A task
that is run again leaves files nobody lists.

Reading: a file is read front to back in small blocks. A decompressor takes one gzip member at a time, headers end at
the empty line, Content-Length frames the block, and both digests are computed while bytes pass. Memory does not
depend on the size of a record unless its payload is asked for.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from anchorgrid.llm.common import slices, stash
from anchorgrid.session import scratch

BLOCK = 1 << 16
_LISTED = "path string, n_records long"
_RECORD = "path string, offset long, record_id string, record_type string, target_uri string, refers_to string, block_bytes long, payload_bytes long, payload_digest string, page_id long, payload binary"


def _store(uri: str):
    """(file system, path) of a URI, any store pyarrow knows; a plain path is local."""
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.removeprefix("file:") if uri.startswith("file:") else uri)


def _record_uri(page_id) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One gzip member holding a response record, or a revisit record that leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_uri(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or 'about:blank').replace(chr(13), ' ').replace(chr(10), ' ')}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_uri(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _writer(folder: str, file_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        out, size, n = None, 0, 0
        for batch in slices(batches, "html"):
            for row in batch.to_pylist():
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, size, n = store.open_output_stream(path, compression=None), 0, 0
                data = record_bytes(row["page_id"], row["url"], (row["html"] or "").encode("utf-8"), row["payload_digest"], row["refers_to"], date)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield pa.record_batch([pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]), pa.array([n], pa.int64())], names=["path", "n_records"])
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]), pa.array([n], pa.int64())], names=["path", "n_records"])

    return run


def write_warc(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 100, file_bytes: int = 256 << 20, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of (page_id, url, html) and return the table of files (path, n_records).

    A null html is an empty payload. Payloads of at least ``min_revisit_bytes`` bytes that a smaller page_id holds too become
    revisits of the smallest; rows that share both page_id and payload are alike. A null page_id never
    refers and is never referred to. ``folder`` is a URI all executors can write; by default one in the shared folder.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("payload_digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    held = rows.where((F.octet_length("html") >= min_revisit_bytes) & F.col("page_id").isNotNull())
    firsts = held.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").drop("last")
    rows = rows.join(firsts, "payload_digest", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first"))).drop("first")
    return stash(rows.mapInArrow(_writer(folder, file_bytes, date), _LISTED), "warc-files")


class _Member:
    """Reads one gzip member after another from a stream."""

    def __init__(self, stream):
        self.stream, self.buffer, self.offset = stream, b"", 0

    def chunks(self) -> Iterator[bytes]:
        """Decompressed bytes of the next member; nothing at the end of the file."""
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            if not self.buffer:
                self.buffer = self.stream.read(BLOCK)
                if not self.buffer:
                    raise ValueError("file ends inside a gzip member")
            before = len(self.buffer)
            data = unpack.decompress(self.buffer, BLOCK)
            self.buffer = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            self.offset += before - len(self.buffer)
            if data:
                yield data

    def more(self) -> bool:
        self.buffer = self.buffer or self.stream.read(BLOCK)
        return bool(self.buffer)


def _headers(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC version line but {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def read_records(stream, path: str, with_payload: bool) -> Iterator[dict]:
    """The records of one archive in file order; raises where framing or a digest is wrong."""
    member = _Member(stream)
    while member.more():
        offset, head, fields, left = member.offset, b"", None, 0
        block, payload, kept, http, seen = hashlib.sha256(), hashlib.sha256(), [], b"", 0
        in_payload, tail = False, b""
        for data in member.chunks():
            if fields is None:
                head += data
                end = head.find(b"\r\n\r\n")
                if end < 0:
                    continue
                fields, data = _headers(head[:end]), head[end + 4 :]
                left = int(fields["content-length"])
            here, rest = data[:left], data[left:]
            left -= len(here)
            tail += rest
            block.update(here)
            if not in_payload:
                http += here
                end = http.find(b"\r\n\r\n")
                if end < 0:
                    continue
                in_payload, here, http = True, http[end + 4 :], http[:end]
            payload.update(here)
            seen += len(here)
            if with_payload:
                kept.append(here)
        if fields is None or left or tail != b"\r\n\r\n":
            raise ValueError(f"{path}: record at {offset} is not framed by its length")
        told = fields["warc-payload-digest"].removeprefix("sha256:")
        full = fields["warc-type"] != "revisit"
        if fields["warc-block-digest"] != f"sha256:{block.hexdigest()}" or full and told != payload.hexdigest():
            raise ValueError(f"{path}: record at {offset} does not have the digest it states")
        length = int(dict(x.lower().split(b":", 1) for x in http.split(b"\r\n")[1:])[b"content-length"])
        if full and length != seen:
            raise ValueError(f"{path}: record at {offset} has {seen} of {length} payload bytes")
        number = lambda x: int(x.rsplit(":", 1)[1].rstrip(">")) if x and not x.endswith("none>") else None
        yield {
            "path": path, "offset": offset, "record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "target_uri": fields["warc-target-uri"],
            "refers_to": fields.get("warc-refers-to"), "block_bytes": int(fields["content-length"]), "payload_bytes": length, "payload_digest": told,
            "page_id": number(fields["warc-record-id"]), "payload": b"".join(kept) if with_payload and full else None,
        }


def _reader(with_payload: bool, rows: int = 500, most: int = 16 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _RECORD.split(", "))])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = _store(path)
                held, size = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for record in read_records(stream, path, with_payload):
                        held.append(record)
                        size += len(record["payload"] or b"")
                        if len(held) >= rows or size >= most:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return run


def read_warc(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archives listed in ``files`` (column path), each archive in a task of its own; a revisit has no payload of its own."""
    paths = files.select("path")
    # a path is a few bytes and its archive hundreds of megabytes: a count of partitions that is given is not coalesced
    paths = paths.repartitionByRange(max(1, paths.count()), "path")
    return paths.mapInArrow(_reader(with_payload), _RECORD)


def archive_round_trip(pages: DataFrame, **parameters) -> DataFrame:
    """Write ``pages`` and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    records = read_warc(write_warc(pages, **parameters), with_payload=False)
    refers = F.regexp_extract("refers_to", r"(-?\d+)>$", 1)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), refers.cast("long")).alias("refers_to"))
