"""WARC records in seekable Zstandard bundles, and reading them back.

A bundle is a file of independent Zstandard frames, each of a few records, with a seek table
in a skippable frame at its end: any Zstandard tool can read it as one stream, and a reader
that knows a record's frame needs that frame alone. The index has for each record the bundle,
the frame's place and the record's place in the frame as it is after decompression.

Bundles are written by tasks under names that hold the attempt, and only the index, which
Spark commits, says which count. A lost executor or a second attempt leaves a file without
entries, never a double record. Folders are reached through Arrow's file systems, so the
shared folder may be on a local disk, HDFS or an object store.
"""

import base64
import hashlib
import struct
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm.tables import slices
from tallow.session import shared_path, stage

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 32 << 20
BUNDLE_RECORDS = 20_000
DATE = "1970-01-01T00:00:00Z"
# Of the seekable format of Zstandard, and of the WARC 1.1 standard.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = pa.schema(
    [
        ("page_id", pa.int64()),
        ("bundle", pa.string()),
        ("frame", pa.int32()),
        ("frame_start", pa.int64()),
        ("frame_bytes", pa.int64()),
        ("start", pa.int64()),
        ("bytes", pa.int64()),
    ]
)
_INDEX_DDL = (
    "page_id bigint, bundle string, frame int, frame_start bigint, frame_bytes bigint, "
    "start bigint, bytes bigint"
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit holds the HTTP head alone."""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    """What a record says of itself; ``payload`` is None for a revisit."""

    page_id: int | None
    kind: str
    digest: str
    refers_to: int | None
    url: str
    payload_bytes: int
    payload: bytes | None


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k: v for k, _, v in (line.partition(": ") for line in lines)}


def parse(data: bytes) -> Record:
    """Read a record; a payload that does not fit its digest or length is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_fields(http)["Content-Length"])
    number = lambda urn: int(urn[10:-1]) if urn and len(urn) > 11 else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and (digest_of(payload) != digest or len(payload) != size):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return Record(
        number(fields["WARC-Record-ID"]),
        fields["WARC-Type"],
        digest,
        number(fields.get("WARC-Refers-To", "")),
        fields["WARC-Target-URI"],
        size,
        payload if response else None,
    )


class BundleWriter:
    """Frames into one file, then the seek table; ``close`` returns the index rows."""

    def __init__(self, root: str, name: str):
        self.files, base = fs.FileSystem.from_uri(root)
        self.files.create_dir(base, recursive=True)
        self.name = name
        self.out = self.files.open_output_stream(f"{base}/{name}", compression=None)  # it is compressed
        self.pack = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []  # compressed and plain bytes
        self.rows: list[tuple] = []
        self.waiting: list[tuple[int | None, int, int]] = []
        self.plain = bytearray()
        self.size = 0

    def add(self, page_id: int | None, data: bytes) -> None:
        self.waiting.append((page_id, len(self.plain), len(data)))
        self.plain += data
        if len(self.plain) >= FRAME_BYTES:
            self._end_frame()

    @property
    def full(self) -> bool:
        return self.size >= BUNDLE_BYTES or len(self.rows) + len(self.waiting) >= BUNDLE_RECORDS

    def _end_frame(self) -> None:
        packed = self.pack.compress(bytes(self.plain))
        self.out.write(packed)
        place = (self.name, len(self.frames), self.size, len(packed))
        self.rows += [(page_id, *place, start, n) for page_id, start, n in self.waiting]
        self.frames.append((len(packed), len(self.plain)))
        self.size += len(packed)
        self.waiting, self.plain = [], bytearray()

    def close(self) -> pa.RecordBatch:
        if self.waiting:
            self._end_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()
        columns = zip(*self.rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, _INDEX.types, strict=True)], schema=_INDEX
        )


def seek_table(file) -> list[tuple[int, int, int]]:
    """(start, compressed bytes, plain bytes) of each frame, from the end of an open bundle."""
    file.seek(file.size() - 9)
    frames, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    file.seek(file.size() - 9 - 8 * frames)
    found, start = [], 0
    for packed, plain in struct.iter_unpack("<II", file.read(8 * frames)):
        found.append((start, packed, plain))
        start += packed
    return found


def read_frame(file, start: int, packed: int) -> bytes:
    file.seek(start)
    return zstandard.ZstdDecompressor().decompress(file.read(packed))


def read_record(root: str, bundle: str, frame: int, start: int, size: int) -> Record:
    """One record by what the index says, through the bundle's seek table and one frame."""
    files, base = fs.FileSystem.from_uri(root)
    with files.open_input_file(f"{base}/{bundle}") as file:
        at, packed, _ = seek_table(file)[frame]
        return parse(read_frame(file, at, packed)[start : start + size])


def _write_batches(root: str):
    def write(batches):
        task = TaskContext.get()
        label = f"part-{task.partitionId():05d}-{task.taskAttemptId()}" if task else "part"
        writer, bundles = None, 0
        for batch in batches:
            for at, pages in slices(batch, "html"):
                part = batch.slice(at, len(pages))
                rest = (part.column(c).to_pylist() for c in ("page_id", "url", "refers_to"))
                for html, page_id, url, refers_to in zip(pages, *rest, strict=True):
                    if writer is None:
                        writer = BundleWriter(root, f"{label}-{bundles:04d}.warc.zst")
                        bundles += 1
                    payload = (html or "").encode("utf-8", "replace")
                    writer.add(page_id, record(page_id, url, payload, refers_to))
                    if writer.full:
                        yield writer.close()
                        writer = None
        if writer:
            yield writer.close()

    return write


def with_first_copies(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to); the last is null for what is to be stored in full.

    Only digests that occur twice are joined, and a digest with a third of all pages is
    split by the join like any other large partition.
    """
    whole = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    ).withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    copies = whole.where(size >= least_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    copies = stage(copies.where("n > 1").drop("n"), "copies")
    first = F.when(size >= least_bytes, F.col("first"))
    own = F.col("page_id").eqNullSafe(first)
    return whole.join(copies, "digest", "left").select(
        "page_id", "url", "html", F.when(~own, first).alias("refers_to")
    )


def write_bundles(pages: DataFrame, root: str | None = None, least_bytes: int = 0) -> tuple[DataFrame, str]:
    """Write one record per row of (page_id, url, html); return the index and the folder.

    Of equal payloads of ``least_bytes`` or more, the row with the smallest page_id is stored
    as response and the others revisit it. A null html is an empty payload and a null url an
    empty one. Rows without an id revisit a row with one; if there is none, they are
    responses, as are rows that repeat both the smallest id and its payload.
    """
    spark = pages.sparkSession
    root = root or shared_path(spark, "bundles")
    rows = with_first_copies(pages, least_bytes)
    return stage(rows.mapInArrow(_write_batches(root), _INDEX_DDL), "bundle-index"), root


def _read_bundle(root: str):
    def read(index: pd.DataFrame) -> pd.DataFrame:
        files, base = fs.FileSystem.from_uri(root)
        rows = []
        index = index.sort_values(["frame", "start"])
        with files.open_input_file(f"{base}/{index['bundle'].iloc[0]}") as file:
            table = seek_table(file)
            for frame, records in index.groupby("frame"):
                at, packed, _ = table[frame]
                data = read_frame(file, at, packed)
                for start, size in zip(records["start"], records["bytes"], strict=True):
                    r = parse(data[start : start + size])
                    rows.append((r.page_id, r.payload_bytes, r.digest, r.kind, r.refers_to, r.url))
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return read


def read_bundles(index: DataFrame, root: str) -> DataFrame:
    """What the archives say of each record; a bundle, of bounded size, is one group."""
    ddl = (
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
        "refers_to bigint, url string"
    )
    return index.groupBy("bundle").applyInPandas(_read_bundle(root), ddl)
