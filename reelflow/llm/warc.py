"""WARC archives as seekable Zstandard bundles.

A bundle is a series of independent zstandard frames, each holding whole WARC
records of about ``frame_bytes``, and ends with a seek table in a skippable
frame: per frame its compressed and decompressed size, then the number of
frames, a descriptor byte and the seekable magic.  Any zstandard reader can read
the bundle from the start; a reader of one record reads the table and one frame.
The index maps a record's id to its bundle, frame, place in the decompressed
frame and length.

Of rows with equal payloads of at least ``revisit_bytes`` bytes, the one with
the smallest id is a ``response``; the others are ``revisit`` records without a
payload that refer to it.  The choice is a partial aggregate per digest and a
join, which Spark may split where one digest holds many rows.  Payloads are
shuffled once, by their own id.

Defined cases: a null payload is empty; a null id keeps its record and is never
what others refer to (among rows with null ids only, all are responses); rows
that repeat an id stay separate records with ids of their own, and of rows with
the smallest id in common all are responses; an empty table writes no bundle and
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.llm.shared import filesystem, partitions_for, publish, shared_folder, slices, written

SKIPPABLE = 0x184D2A5E            # fixed values of the seekable format
SEEKABLE = 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"     # pages carry no time
INDEX = ("page_id bigint, record_id string, bundle string, frame int, frame_start bigint, frame_bytes bigint, "
         "at bigint, length bigint")
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", packed, raw) for packed, raw in frames)
    body += struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(source) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of every frame, from the bundle's end."""
    size = source.size()
    n, descriptor, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if descriptor & 0x80 else 8
    body = source.read_at(n * width, size - 9 - n * width)
    frames, at = [], 0
    for k in range(n):
        packed, raw = struct.unpack_from("<II", body, k * width)
        frames.append((at, packed, raw))
        at += packed
    return frames


def record(record_id: str, kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str,
           refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit has an empty block and names the full payload's digest and length."""
    block = payload if kind == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"X-Refers-To-Page-ID: {refers_to}"]
    else:
        lines.append("Content-Type: text/html; charset=utf-8")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("torn WARC record")
    return fields, rest[:n]


class BundleWriter:
    """Writes records into frames of about ``frame_bytes``; holds one frame."""

    def __init__(self, out, frame_bytes: int, level: int):
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.waiting: list[bytes] = []
        self.size = self.start = 0
        self.entries: list[list] = []

    def add(self, page_id: int | None, record_id: str, data: bytes) -> None:
        if self.size and self.size + len(data) > self.frame_bytes:
            self.flush()
        self.entries.append([page_id, record_id, len(self.frames), self.start, 0, self.size, len(data)])
        self.waiting.append(data)
        self.size += len(data)

    def flush(self) -> None:
        if not self.size:
            return
        packed = self.zstd.compress(b"".join(self.waiting))
        self.out.write(packed)
        for entry in reversed(self.entries):
            if entry[2] != len(self.frames):
                break
            entry[4] = len(packed)
        self.frames.append((len(packed), self.size))
        self.start += len(packed)
        self.waiting, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.out.write(seek_table(self.frames))


def decide(pages: DataFrame, revisit_bytes: int = 100, id_col: str = "page_id", payload_col: str = "html",
           url_col: str = "url") -> DataFrame:
    """page_id, url, payload, digest, kind, refers_to of every row."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = (rows.select("digest", "page_id", F.length("payload").alias("n")).where(f"n >= {revisit_bytes}")
              .groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
              .where("copies > 1"))
    # one row per (id, digest) that refers elsewhere, so that the join back adds no rows
    later = (rows.select("digest", "page_id").join(firsts.select("digest", "first"), "digest")
             .where("first is not null and not (page_id <=> first)")
             .select("page_id", "digest", "first").distinct()
             .withColumnsRenamed({"page_id": "later_id", "digest": "later_digest"}))
    return (rows.join(later, F.col("page_id").eqNullSafe(F.col("later_id")) & (F.col("digest") == F.col("later_digest")), "left")
            .select("page_id", "url", "payload", "digest",
                    F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("kind"),
                    F.col("first").alias("refers_to")))


def write_bundles(pages: DataFrame, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3,
                  revisit_bytes: int = 100, id_col: str = "page_id", payload_col: str = "html",
                  url_col: str = "url") -> tuple[str, DataFrame]:
    """Write a record for every row; the folder of bundles and the index of its records."""
    folder = shared_folder(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("page_id", "url", "payload", "digest", "kind", "refers_to")
        rows = (r for b in slices(batches, 64) for r in zip(*(b.column(c).to_pylist() for c in columns)))
        row = next(rows, None)
        while row is not None:                           # one bundle a turn
            entries: list[list] = []

            def fill(out) -> None:
                nonlocal row
                writer = BundleWriter(out, frame_bytes, level)
                while row is not None and writer.start < bundle_bytes:
                    page_id, url, payload, digest, kind, refers_to = row
                    record_id = str(uuid.uuid4())
                    writer.add(page_id, record_id, record(record_id, kind, page_id, url, payload, digest, refers_to))
                    row = next(rows, None)
                writer.close()
                entries.extend(writer.entries)

            bundle = publish(folder, "bundle.warc.zst", fill)
            page_ids, record_ids, frame, start, packed, at, length = zip(*entries)
            long, n = pa.int64(), len(entries)
            yield pa.RecordBatch.from_arrays(
                [pa.array(page_ids, long), pa.array(record_ids), pa.array([bundle] * n), pa.array(frame, pa.int32()),
                 pa.array(start, long), pa.array(packed, long), pa.array(at, long), pa.array(length, long)],
                names=["page_id", "record_id", "bundle", "frame", "frame_start", "frame_bytes", "at", "length"])

    decided = decide(pages, revisit_bytes, id_col, payload_col, url_col)
    return folder, written(decided.mapInArrow(write, INDEX), "warc-index")


def fetch(folder: str, bundle: str, frame: int, at: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by the bundle's own seek table: reads the table and one frame."""
    fs, root = filesystem(folder)
    with fs.open_input_file(f"{root}/{bundle}") as source:
        start, packed, raw = read_seek_table(source)[frame]
        data = zstandard.ZstdDecompressor().decompress(source.read_at(packed, start), max_output_size=raw)
    return parse(data[at:at + length])


def read_bundles(folder: str, index: DataFrame) -> DataFrame:
    """Every record, read back through the index; tasks take frames, whichever bundle they are in."""
    frames = (index.groupBy("bundle", "frame", "frame_start", "frame_bytes")
              .agg(F.sort_array(F.collect_list(F.struct("at", "length", "record_id"))).alias("records"))
              .repartition(partitions_for(index)))      # a frame's records are bounded by its bytes

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        unpack, sources = zstandard.ZstdDecompressor(), {}
        try:
            for batch in batches:
                columns = ("bundle", "frame", "frame_start", "frame_bytes", "records")
                for bundle, frame, start, packed, records in zip(*(batch.column(c).to_pylist() for c in columns)):
                    if bundle not in sources:
                        source = fs.open_input_file(f"{root}/{bundle}")
                        sources[bundle] = source, read_seek_table(source)
                    source, table = sources[bundle]
                    if table[frame][:2] != (start, packed):
                        raise ValueError("index and seek table differ")
                    data = unpack.decompress(source.read_at(packed, start), max_output_size=table[frame][2])
                    rows = [digest_row(parse(data[r["at"]:r["at"] + r["length"]]), r["record_id"]) for r in records]
                    page, size, digest, kind, refers, record_id = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(digest), pa.array(kind),
                         pa.array(refers, pa.int64()), pa.array(record_id)],
                        names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"])
        finally:
            for source, _ in sources.values():
                source.close()

    return frames.mapInArrow(load, READ)


def digest_row(read: tuple[dict[str, str], bytes], record_id: str) -> tuple:
    """What a record says of its payload; a response's digest is taken from the payload itself."""
    fields, block = read
    if fields["WARC-Record-ID"] != f"<urn:uuid:{record_id}>":
        raise ValueError("the index names another record")
    kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
    if kind == "response" and (hashlib.sha256(block).hexdigest() != digest or len(block) != size):
        raise ValueError("payload and digest differ")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    return None if page is None else int(page), size, digest, kind, None if refers is None else int(refers), record_id
