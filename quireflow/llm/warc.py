"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle is its frames and, in a skippable frame at the
end, a seek table with each frame's compressed and uncompressed size. The index maps a record's identifier to its
bundle, frame and offset inside the frame, so one record costs one frame. Bundles go to the shared folder through the
file system that its address names, and are read back by Spark.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_dir, in_batches

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 32 << 20
LEAST_REVISIT = 0
# Fixed values of the seekable format
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

INDEX = "record_id string, page_id long, bundle string, frame int, frame_start long, frame_size long, offset long, length long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(" " if c in "\r\n" else c for c in value)


def make_record(page_id, url, payload: bytes, refers_to) -> bytes:
    """A response record, or a revisit record without the payload where refers_to is given."""
    name = "none" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    body = payload
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        body = b""
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_records(data: bytes):
    """(start, length, headers, body) of each record of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        body = data[end + 4 : (stop := end + 4 + int(headers["Content-Length"]))]
        yield at, stop + 4 - at, headers, body
        at = stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", c, d) for c, d in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """(compressed, uncompressed) size of each frame, from a bundle's last bytes."""
    n, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    return [struct.unpack("<II", tail[k : k + 8]) for k in range(len(tail) - 9 - 8 * n, len(tail) - 9, 8)]


def _file_system(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)


class _Bundle:
    """Collects records into frames and frames into one file, which appears under its name only when it is whole."""

    def __init__(self, folder: str, name: str):
        import zstandard

        self.fs, path = _file_system(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
        self.fs.create_dir(path, recursive=True)
        self.path = posixpath.join(path, name)
        self.temporary = posixpath.join(path, f"_{name}.{uuid.uuid4().hex}")
        self.out = self.fs.open_output_stream(self.temporary)
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.starts: list[int] = []
        self.frame, self.size = bytearray(), 0

    def add(self, record: bytes) -> tuple[int, int]:
        place = len(self.frames), len(self.frame)
        self.frame += record
        if len(self.frame) >= FRAME_BYTES:
            self.flush()
        return place

    def flush(self) -> None:
        if self.frame:
            packed = self.zstd.compress(bytes(self.frame))
            self.out.write(packed)
            self.starts.append(self.size)
            self.frames.append((len(packed), len(self.frame)))
            self.size += len(packed)
            self.frame = bytearray()

    def close(self) -> None:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.fs.move(self.temporary, self.path)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write records (page_id, url, html, refers_to; sorted within partitions) as bundles below folder.

    Returns their index. A bundle's name is its partition's number and its place in it; a task that runs again writes
    the same records under the same names.
    """

    def write(batches):
        from pyspark import TaskContext

        part, count, bundle, rows = TaskContext.get().partitionId(), 0, None, []

        def finish():
            bundle.close()
            for row, (frame, offset) in rows:
                start, (size, _) = bundle.starts[frame], bundle.frames[frame]
                yield (*row[:2], f"{part:06d}-{count:04d}.warc.zst", frame, start, size, offset, row[2])

        columns = [c.split(" ")[0] for c in INDEX.split(", ")]
        for pdf in batches:
            out = []
            for page, url, html, ref in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], strict=True):
                page = None if pd.isna(page) else int(page)
                record = make_record(page, url, (html or "").encode("utf-8", "surrogatepass"), None if pd.isna(ref) else int(ref))
                bundle = bundle or _Bundle(folder, f"{part:06d}-{count:04d}.warc.zst")
                rows.append(((f"urn:page:{'none' if page is None else page}", page, len(record)), bundle.add(record)))
                if bundle.size >= BUNDLE_BYTES:
                    out += finish()
                    bundle, rows, count = None, [], count + 1
            yield pd.DataFrame(out, columns=columns).astype({"page_id": "Int64"})
        if bundle:
            yield pd.DataFrame(list(finish()), columns=columns).astype({"page_id": "Int64"})

    return cut(in_batches(records.select("page_id", "url", "html", "refers_to")).mapInPandas(write, INDEX))


def _page_number(urn: str | None):
    name = urn and urn.strip("<>").rpartition(":")[2]
    return None if name in (None, "none") else int(name)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the bundles below folder, each frame found by the seek table and checked against its digest."""

    def read(batches):
        import zstandard

        zstd = zstandard.ZstdDecompressor()
        for pdf in batches:
            for content in pdf["content"]:
                at, out = 0, []
                for packed, plain in read_seek_table(content):
                    data = zstd.decompress(content[at : at + packed], max_output_size=plain)
                    at += packed
                    for _, _, h, body in parse_records(data):
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if h["WARC-Type"] == "response" and payload_digest(body) != digest:
                            raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its digest")
                        out.append((_page_number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), h["WARC-Type"], int(h["X-Payload-Length"]), digest, _page_number(h.get("WARC-Refers-To")), body if payloads else None))
                    if len(out) >= 512:
                        yield _frame(out)
                        out = []
                yield _frame(out)

    def _frame(rows):
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in RECORDS.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInPandas(read, RECORDS)


def read_record(folder: str, bundle: str, frame_start: int, frame_size: int, offset: int, length: int) -> tuple[dict, bytes]:
    """Headers and body of one record, by its index entry: one seek, one frame."""
    import zstandard

    fs, path = _file_system(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    with fs.open_input_file(posixpath.join(path, bundle)) as f:
        f.seek(frame_start)
        data = zstandard.ZstdDecompressor().decompress(f.read(frame_size))
    _, _, headers, body = next(parse_records(data[offset : offset + length]))
    return headers, body


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, refers_to, sorted by page_id within partitions.

    Of records with equal payloads of at least `least` bytes the one with the smallest page_id is the response, and
    the others refer to it; a null page_id ranks last. A null html is an empty payload. Rows that repeat the smallest
    page_id are all responses.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("_sha"), F.octet_length(html).alias("_n"))
    first = rows.filter(F.col("_n") >= least).groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_same"))
    first = cut(first.filter("_same > 1").select("_sha", "_first"))
    marked = rows.join(first, "_sha", "left")
    refers = F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return marked.select("page_id", "url", "html", refers.cast("long").alias("refers_to")).sortWithinPartitions("page_id", "url")


def archive_and_read(pages: DataFrame, *, least: int = LEAST_REVISIT, folder: str | None = None) -> DataFrame:
    """Write every row of pages and read the archives back: page_id, url, record_type, payload_bytes, payload_digest, refers_to."""
    spark = pages.sparkSession
    folder = folder or fresh_dir(spark, "warc")
    index = write_archives(with_revisits(pages, least), folder)
    if index.isEmpty():
        return spark.createDataFrame([], RECORDS).drop("payload")
    return read_archives(spark, folder, payloads=False).drop("payload")
