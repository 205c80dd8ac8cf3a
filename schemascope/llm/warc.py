"""WARC records in seekable Zstandard bundles.

A bundle is a row of a written table: independent frames of whole records, then
a skippable frame with the sizes of all frames (the public seekable format).
An index maps each record to its bundle, frame and place in the frame's
content, so that one record is read by decompressing one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stage

# Fixed values of the seekable format.
_SKIPPABLE = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1

_DATE = "1970-01-01T00:00:00Z"
BUNDLE_SCHEMA = "bundle string, bytes binary, record_ids array<long>, frames array<int>, offsets array<long>, lengths array<long>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """A response with its payload, or a revisit that names the response. Both
    keep the HTTP header with the payload's full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {urllib.parse.quote(url or '', safe='%/:?#[]@!$&()*+,;=~-._' + chr(39))}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, HTTP header, payload) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no WARC record here")
        headers = dict(x.split(": ", 1) for x in lines)
        size = int(headers["Content-Length"])
        body = data[end + 4 : end + 4 + size]
        http, _, payload = body.partition(b"\r\n\r\n")
        yield headers, http, payload
        at = end + 4 + size + 4


class BundleWriter:
    """Groups records into frames of about ``frame`` bytes and frames into a bundle."""

    def __init__(self, frame: int = 1 << 18, level: int = 3):
        self.frame, self.zip = frame, zstandard.ZstdCompressor(level=level)
        self.sizes: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.open, self.index, self.total = bytearray(), [], 0

    def add(self, page_id, data: bytes) -> None:
        if self.open and len(self.open) + len(data) > self.frame:
            self._close()
        self.index.append((page_id, len(self.sizes), len(self.open), len(data)))
        self.open += data
        self.total += len(data)

    def _close(self) -> None:
        if self.open:
            self.parts.append(self.zip.compress(bytes(self.open)))
            self.sizes.append((len(self.parts[-1]), len(self.open)))
            self.open = bytearray()

    def finish(self) -> bytes:
        self._close()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        return b"".join(self.parts) + struct.pack("<II", _SKIPPABLE, len(table)) + table


def frames_of(bundle: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed size, size) of each frame, from the footer."""
    n, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    sizes = struct.iter_unpack("<II", bundle[len(bundle) - 9 - 8 * n : len(bundle) - 9])
    out, at = [], 0
    for packed, full in sizes:
        out.append((at, packed, full))
        at += packed
    return out


def read_frame(bundle: bytes, frame: int) -> bytes:
    at, packed, full = frames_of(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=full)


def read_record(bundle: bytes, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes, bytes]:
    return next(parse(read_frame(bundle, frame)[offset : offset + length]))


def write_bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", bundle: int = 8 << 20, frame: int = 1 << 18) -> DataFrame:
    """A staged table of bundles with their indexes.

    Of records with equal payloads the one with the largest page_id is the
    response and the others revisit it; of repeated rows with that id each is
    a response. Null html is an empty payload; a null page_id never refers and
    is written as a response. A record longer than a frame, however long, has
    its own. ids are long integers. Other columns, of any name, are ignored; an
    empty table gives no bundle.

    Only ids and digests are shuffled to find the references; they reach the
    pages by broadcast if they are few, else by a join on id and digest.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("sha", F.unhex(F.sha1("html"))).withColumn("size", F.octet_length("html"))
    # only payloads that occur more than once
    best = keyed.groupBy("sha", "size").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1").select("sha", "size", "best")
    refs = keyed.select("page_id", "sha", "size").join(small(stage(best, "repeated")), ["sha", "size"]).where("page_id < best").select("page_id", "sha", F.col("best").alias("refers_to")).distinct()
    linked = keyed.join(small(stage(refs, "refs")), ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, out = TaskContext.get().partitionId(), 0, BundleWriter(frame)
        types = (pa.string(), pa.binary(), *[pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())])

        def flush() -> pa.RecordBatch:
            data = out.finish()
            cols = [f"{part:06d}-{k:06d}.warc.zst", data, *[list(c) for c in zip(*out.index, strict=True)]]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, types, strict=True)], ["bundle", "bytes", "record_ids", "frames", "offsets", "lengths"])

        for b in batches:
            for page_id, url, html, ref in zip(*[c.to_pylist() for c in b.columns], strict=True):
                out.add(page_id, record(page_id, url, html.encode("utf-8", "surrogatepass"), ref))
                if out.total >= bundle:
                    yield flush()
                    k, out = k + 1, BundleWriter(frame)
        if out.index:
            yield flush()

    return stage(linked.mapInArrow(write, BUNDLE_SCHEMA), "bundles")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, bundle,
    frame, frame_offset of every record, read from the bundles' bytes.

    A response's length and digest are those of the payload read back and must
    be those of its headers; a revisit's stand in its headers.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k in range(len(frames_of(data))):
                    at = 0
                    for headers, http, payload in parse(read_frame(data, k)):
                        kind, said = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(http.rsplit(b"Content-Length: ", 1)[1])
                        if kind == "response" and (len(payload), digest(payload)) != (size, said):
                            raise ValueError(f"a damaged record in {name}")
                        own = headers["WARC-Record-ID"][len("<urn:page:") : -1]
                        ref = headers.get("WARC-Refers-To", "")[len("<urn:page:") : -1]
                        rows.append((int(own) if own else None, size, said, kind, int(ref) if ref else None, name, k, at))
                        at += len("\r\n".join(["WARC/1.0", *[f"{x}: {y}" for x, y in headers.items()]]).encode()) + 8 + int(headers["Content-Length"])
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", "frame_offset"])

    return bundles.select("bundle", "bytes").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, frame_offset long")


def index_of(bundles: DataFrame) -> DataFrame:
    """page_id -> bundle, frame, frame_offset, length."""
    zipped = F.arrays_zip("record_ids", "frames", "offsets", "lengths")
    return bundles.select("bundle", F.explode(zipped).alias("x")).select(F.col("x.record_ids").alias("page_id"), "bundle", F.col("x.frames").alias("frame"), F.col("x.offsets").alias("frame_offset"), F.col("x.lengths").alias("length"))


def export_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle as ``<folder>/<bundle>``, a ``.warc.zst`` file that any
    reader of the seekable format opens; bundle, path, size of every file.

    ``folder`` is a URI that all executors reach (file, hdfs, s3 and so on). A
    file is written under a name of its own and then renamed, so a task that
    runs again leaves one whole file. An empty table writes none.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            out = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(data)
                store.move(part, f"{root}/{name}")
                out.append((name, f"{root}/{name}", len(data)))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], ["bundle", "path", "size"])

    return stage(bundles.select("bundle", "bytes").mapInArrow(write, "bundle string, path string, size long"), "files")


def read_from_file(folder: str, bundle: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes, bytes]:
    """One record of an exported bundle, by its place in the index: reads the
    footer and one frame of the file."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{bundle}") as f:
        n, _, magic = struct.unpack("<IBI", f.read_at(9, f.size() - 9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table")
        sizes = list(struct.iter_unpack("<II", f.read_at(8 * n, f.size() - 9 - 8 * n)))
        packed = f.read_at(sizes[frame][0], sum(x for x, _ in sizes[:frame]))
    data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=sizes[frame][1])
    return next(parse(data[offset : offset + length]))
