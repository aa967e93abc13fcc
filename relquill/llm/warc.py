"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends with a seek table in a skippable frame (the public seekable
format), and an index maps each record to its bundle, frame and offset within the frame. Equal payloads are kept once: the
record with the smallest page_id is a response, the others revisit it.

Payloads are equal if length and SHA-256 are (the SHA-1 of the digest field has known collisions). A null payload is empty, a null
url has no target field; a payload of any length is one record, held in memory once. Rows without a page_id are always
responses, as are repeated rows of the smallest page_id. An empty table gives an empty result; only the three columns are
read, so other names don't matter. Each task writes under a name of its own, and only the index, which Spark commits, says which
bundles count: files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_path, slices, uneven_join

#: Raw bytes of a frame, compressed bytes of a bundle, about; a larger record has a frame of its own.
FRAME_BYTES, BUNDLE_BYTES = 256 * 1024, 64 * 1024 * 1024
MOST_TASKS = 100_000
# fixed values of the seekable format
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame int, offset long, length long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has no payload of its own."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += payload if refers_to is None else b""
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of one record; a payload is hashed anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")

    def number(field: str) -> int | None:
        text = fields.get(field, "<urn:page:>")[len("<urn:page:") : -1]
        return int(text) if text else None

    return {"page_id": number("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To")}


class Bundle:
    """Writes one bundle: frames, then the seek table."""

    def __init__(self, uri: str):
        import pyarrow.fs as pafs
        import zstandard

        store, path = pafs.FileSystem.from_uri(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.out, self.size = uri, store.open_output_stream(path, compression=None), 0
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.raw = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset within it of the record."""
        if self.held and self.raw + len(data) > FRAME_BYTES:
            self.flush()
        place = (len(self.frames), self.raw)
        self.held.append(data)
        self.raw += len(data)
        return place

    def flush(self) -> None:
        if self.held:
            frame = self.zstd.compress(b"".join(self.held))
            self.out.write(frame)
            self.frames.append((len(frame), self.raw))
            self.size += len(frame)
            self.held, self.raw = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Seekable:
    """Reads frames of a bundle by number."""

    def __init__(self, uri: str):
        import pyarrow.fs as pafs
        import zstandard

        store, path = pafs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        self.zstd = zstandard.ZstdDecompressor()
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.at(end - 9, 9))
        if magic != SEEKABLE or flags & 0x7F:
            raise ValueError(f"{uri} has no seek table of the kind written here")
        width = 12 if flags & 0x80 else 8
        table = self.at(end - 9 - n * width, n * width)
        self.frames, start = [], 0
        for k in range(n):
            packed, raw = struct.unpack_from("<II", table, k * width)
            self.frames.append((start, packed, raw))
            start += packed

    def at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        start, packed, raw = self.frames[k]
        return self.zstd.decompress(self.at(start, packed), max_output_size=raw)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) to bundles in ``folder``; gives the committed index.

    Payloads of at least ``min_bytes`` that are equal are kept once.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    source = pages.select("page_id", "url", payload.alias("text"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"))
    small = materialise(source.where(F.col("size") >= min_bytes).select("page_id", "digest", "size"), "digests")
    firsts = small.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    revisits = uneven_join(small, firsts, ["digest", "size"]).where("page_id <> first").select("page_id", "digest", "size", "first").distinct()
    source = source.join(materialise(revisits, "revisits"), ["page_id", "digest", "size"], "left").select("page_id", "url", "text", "first")

    def run(batches):
        import pyarrow as pa

        bundle = None
        rows: list[tuple] = []

        def put():
            bundle.close()
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["page_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            for part in slices(batch):
                for page, url, data, first in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "text", "first")), strict=True):
                    if bundle is None:
                        bundle, rows = Bundle(f"{folder}/{uuid.uuid4().hex}.warc.zst"), []
                    raw = record(page, url, data, first, date)
                    frame, offset = bundle.add(raw)
                    rows.append((page, bundle.uri, frame, offset, len(raw)))
                    if bundle.size > BUNDLE_BYTES:
                        yield put()
                        bundle = None
        if bundle is not None:
            yield put()

    return materialise(source.mapInArrow(run, INDEX), "index")


def read_archives(index: DataFrame) -> DataFrame:
    """Read each record of ``index`` back from its frame: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches):
        import pyarrow as pa

        types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        uri = held = bundle = None
        raw = b""
        for batch in batches:
            out = []
            for path, frame, offset, length in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length")), strict=True):
                if path != uri:
                    uri, held, bundle = path, None, Seekable(path)
                if frame != held:
                    held, raw = frame, bundle.frame(frame)
                out.append(parse(raw[offset : offset + length]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in types.items()], list(types))

    # the index is small and the archives aren't: as many tasks as there are bundles, whatever Spark would coalesce
    bundles = index.agg(F.count_distinct("bundle")).first()[0]
    rows = index.select("bundle", "frame", "offset", "length").repartition(max(1, min(bundles, MOST_TASKS)), "bundle").sortWithinPartitions("bundle", "frame", "offset")
    return rows.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    return read_archives(write_archives(pages, new_path(pages.sparkSession, "warc"), min_bytes))
