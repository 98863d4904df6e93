"""Op 8: WARC records in seekable Zstandard bundles.

Records go into independent Zstandard frames of about FRAME_BYTES; a bundle ends with a skippable
frame that holds the seek table (compressed and plain size of each frame). An index table maps each
record to its bundle, frame and offset in the frame, so one record costs one frame to read.

Of records with equal payloads (equal SHA-256) the one with the smallest page_id is a response, the
others are revisits, written with the HTTP header only; so only ids of repeated payloads are joined.
Nulls: a null html is empty, a null url has no header line; a null page_id is a response only where
its group has no other id. Rows that repeat the smallest id are responses too. An empty table gives no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, new_folder, publish, text_of, written

FRAME_BYTES = 256 << 10
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, file string, frame int, offset long, length long"


class BundleWriter:
    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        from zstandard import ZstdCompressor

        self.out, self.frame_bytes, self.compressor = out, frame_bytes, ZstdCompressor(level=LEVEL)
        self.buffer, self.frames = bytearray(), []

    def add(self, record: bytes) -> tuple[int, int]:
        """Returns the record's frame and its offset there."""
        if self.buffer and len(self.buffer) + len(record) > self.frame_bytes:
            self._flush()
        at = len(self.frames), len(self.buffer)
        self.buffer += record
        return at

    def _flush(self) -> None:
        packed = self.compressor.compress(bytes(self.buffer))
        self.out.write(packed)
        self.frames.append((len(packed), len(self.buffer)))
        self.buffer = bytearray()

    def close(self) -> None:
        if self.buffer:
            self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Bundle:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, uri: str):
        from zstandard import ZstdDecompressor

        files, path = filesystem(uri)
        self.file, self.decompressor, self.held = files.open_input_file(path), ZstdDecompressor(), (-1, b"")
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        self.at, place = [], 0
        for packed, plain in struct.iter_unpack("<II", self.file.read_at(8 * n, size - 9 - 8 * n)):
            self.at.append((place, packed, plain))
            place += packed

    def frame(self, k: int) -> bytes:
        if self.held[0] != k:
            place, packed, plain = self.at[k]
            self.held = k, self.decompressor.decompress(self.file.read_at(packed, place), max_output_size=plain)
        return self.held[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]

    def close(self) -> None:
        self.file.close()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines)


def _page(urn: str) -> int | None:
    found = urn.strip("<>").rpartition(":")[2]
    return None if found == "None" else int(found)


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, digest, record type, refers_to of a record; checks response payloads."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told, kind = warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"]
    size = int(_fields(http)["Content-Length"])
    if kind == "response" and (len(payload) != size or digest(payload) != told):
        raise ValueError(f"record {warc['WARC-Record-ID']} is damaged")
    return _page(warc["WARC-Record-ID"]), size, told, kind, _page(warc["WARC-Refers-To"]) if kind == "revisit" else None


def write_bundles(pages: DataFrame, folder: str, min_payload: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes one bundle a partition; returns the index table."""
    rows = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).cast("string").alias("u"), text_of(html_col).alias("p"))
    rows = rows.withColumn("k", F.when(F.octet_length("p") >= min_payload, F.sha2("p", 256)))
    again = rows.where("k IS NOT NULL").groupBy("k").agg(F.min("i").alias("first"), F.count("*").alias("n")).where("n > 1").select("k", "first")
    again = written(again, "repeats")  # few rows: the join's own size check decides how they travel
    rows = rows.join(again, "k", "left").select("i", "u", "p", F.when(~F.col("i").eqNullSafe(F.col("first")), F.col("first")).alias("r"))
    # in an order of their own, so a second attempt writes the same bundle under the same name
    rows = rows.sortWithinPartitions("i", "u", "p")

    def write(batches):
        from pyspark import TaskContext

        name = f"{folder}/bundle-{TaskContext.get().partitionId():06d}.warc.zst"
        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return
        found: list[tuple] = []

        def fill(out):
            bundle, batch = BundleWriter(out), head
            while batch is not None:
                for i, u, p, r in zip(*batch.columns):
                    raw = record(i.as_py(), u.as_py(), p.as_py().encode(), r.as_py())
                    frame, at = bundle.add(raw)
                    found.append((i.as_py(), name, frame, at, len(raw)))
                batch = next(batches, None)
            bundle.close()

        publish(name, fill)
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        for at in range(0, len(found), 8192):
            cols = zip(*found[at : at + 8192])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "file", "frame", "offset", "length"])

    return written(rows.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """Reads every record of the index back and checks it."""

    def read(batches):
        bundle, name = None, None
        for batch in batches:
            out = []
            for file, frame, at, length in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                if file != name:
                    if bundle:
                        bundle.close()
                    bundle, name = Bundle(file), file
                out.append(parse(bundle.record(frame, at, length)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if bundle:
            bundle.close()

    return index.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, min_payload: int = 0, folder: str | None = None) -> DataFrame:
    return read_records(write_bundles(pages, folder or new_folder(pages.sparkSession, "warc"), min_payload))
