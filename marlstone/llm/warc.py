"""WARC archives compressed with Zstandard, one frame a record.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself compressed as one frame. Every record is a frame of its own,
so a reader needs no more memory than one record. The dictionary is trained on
the first records of the archive; it changes the size, never the content.

Defined results: null html is an empty payload; a null url gives a record
without a target; a null page_id gives a record without a page, which can only
be referred to by none; of equal payloads every row with the largest page_id is
a response; an empty table gives no archive. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, filesystem, partitions, scratch, ship

SKIPPABLE = 0x184D2A5D
#: Bytes of records that the dictionary is trained on, and its size.
TRAIN_BYTES, DICT_BYTES = 1 << 20, 1 << 15
#: Payloads from this length on are written once.
LEAST_SHARED = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = b"\r\n"


def _safe(value: str) -> str:
    """Percent-encode what can't stand in a header line."""
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def _page_uri(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<urn:x-page:{page_id}>"


def _page_of(uri: str) -> int | None:
    return int(uri[12:-1]) if uri.startswith("<urn:x-page:") else None


def _b32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_page_uri(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{_b32(digest)}")
    lines.append(f"WARC-Block-Digest: sha1:{_b32(hashlib.sha1(block).hexdigest())}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_page_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + _CRLF * 2


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(_CRLF):
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        out[name.decode().lower()] = value.strip().decode()
    return out


def parse(raw: bytes) -> dict:
    """A record's fields; raises ValueError on a bad header, length or digest."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(_CRLF)
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError(f"bad version line {version[:40]!r}")
    fields = _headers(lines)
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in fields:
            raise ValueError(f"no {need}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != _CRLF * 2:
        raise ValueError(f"content length {size}, found {len(rest) - 4}")
    block = rest[:size]
    if _b32(hashlib.sha1(block).hexdigest()) != fields.get("warc-block-digest", "")[5:]:
        raise ValueError("block digest differs")
    status, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    length = int(_headers(status.partition(_CRLF)[2])["content-length"])
    digest = base64.b32decode(fields["warc-payload-digest"][5:]).hex()
    kind = fields["warc-type"]
    if kind == "response":
        if len(payload) != length or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("payload differs from its length or digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise ValueError(f"bad record of type {kind!r}")
    return {
        "page_id": _page_of(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page_of(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


class ArchiveWriter:
    """Writes records to a stream; trains the dictionary on the first ones."""

    def __init__(self, out):
        self.out, self.waiting, self.held, self.codec, self.n = out, [], 0, None, 0

    def add(self, raw: bytes) -> None:
        self.n += 1
        if self.codec is not None:
            self.out.write(self.codec.compress(raw))
            return
        self.waiting.append(raw)
        self.held += len(raw)
        if self.held >= TRAIN_BYTES:
            self._begin()

    def _begin(self) -> None:
        trained = None
        if len(self.waiting) >= 16:
            try:
                trained = zstandard.train_dictionary(DICT_BYTES, self.waiting)
            except zstandard.ZstdError:  # too few or too uniform samples: the archive goes without
                trained = None
        content = zstandard.ZstdCompressor().compress(trained.as_bytes()) if trained else b""
        self.out.write(struct.pack("<II", SKIPPABLE, len(content)) + content)
        self.codec = zstandard.ZstdCompressor(level=3, dict_data=trained) if trained else zstandard.ZstdCompressor(level=3)
        for raw in self.waiting:
            self.out.write(self.codec.compress(raw))
        self.waiting = []

    def close(self) -> None:
        if self.codec is None:
            self._begin()


def frames(stream, chunk: int = 1 << 16):
    """The content of each frame of an archive, one at a time."""
    head = stream.read(8)
    if len(head) < 8:
        raise ValueError("archive has no leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError(f"archive starts with frame {magic:#x}")
    content = stream.read(size)
    if len(content) != size:
        raise ValueError("dictionary frame is cut short")
    if content[:4] == b"\x28\xb5\x2f\xfd":
        content = zstandard.ZstdDecompressor().decompress(content)
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content)) if content else zstandard.ZstdDecompressor()
    data = b""
    while True:
        data = data or stream.read(chunk)
        if not data:
            return
        one, out = codec.decompressobj(), io.BytesIO()
        while True:
            out.write(one.decompress(data))
            if one.eof:
                data = one.unused_data
                break
            data = stream.read(chunk)
            if not data:
                raise ValueError("archive ends within a frame")
        yield out.getvalue()


def assign(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """page_id, url, html, digest and the page that a revisit refers to (else null).

    Only ids and digests meet by digest, pre-aggregated on the map side; the
    html is joined by page afterwards.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    shared = rows.filter((F.octet_length("html") >= least) & F.col("page_id").isNotNull())
    first = shared.groupBy("digest").agg(F.max("page_id").alias("_first"), F.min("page_id").alias("_least"))
    first = first.filter("_first <> _least").select("digest", "_first")
    found = shared.select("page_id", "digest").join(first, "digest").filter("page_id <> _first")
    found = found.groupBy("page_id", "digest").agg(F.max("_first").alias("refers_to"))
    return rows.join(found, ["page_id", "digest"], "left")


def write_warc(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record per row; return the archives' manifest (path, n_records).

    A name is new for every task attempt and only the manifest names it, so
    what a lost executor leaves behind is never read.
    """
    folder = folder or scratch(pages.sparkSession, "warc")

    def write(batches):
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        out = writer = None
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    out = fs.open_output_stream(f"{at}/{name}")
                    writer = ArchiveWriter(out)
                writer.add(record(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["refers_to"]))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": pa.array([writer.n], pa.int64())})

    rows = assign(pages).select("page_id", "url", "html", "digest", "refers_to")
    return cut(rows.mapInArrow(write, "path string, n_records long"), "warc-manifest")


_FIELDS = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: Records and payload bytes that a result batch of the reader holds at most.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def read_warc(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """A validated row per record of the archives."""
    names = [n for n in _FIELDS if payload or n != "payload"]

    def read(batches):
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                fs, at = filesystem(path)
                rows, held, n = [], 0, 0
                with fs.open_input_stream(at) as stream:
                    for raw in frames(stream):
                        rows.append(parse(raw))
                        held, n = held + len(raw), n + 1
                        if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], _FIELDS[k]) for k in names})
                            rows, held = [], 0
                if n != expected:
                    raise ValueError(f"{path} holds {n} records of {expected}")
                if rows:
                    yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], _FIELDS[k]) for k in names})

    schema = ", ".join(f for f in _READ.split(", ") if f.split()[0] in names)
    ship(manifest.sparkSession)
    return manifest.repartition(partitions(manifest.sparkSession)).mapInArrow(read, schema)
