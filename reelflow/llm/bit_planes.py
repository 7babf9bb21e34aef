"""Token ids in chunked plane files: fixed-size id blocks, transposed into bit or byte planes.

File layout (all integers little-endian):

    "IDPLANE1"                                  magic
    planes of chunk 0, planes of chunk 1, ...   each plane one zstandard frame
    zstandard frame of the document table       int64 doc_id, uint8 id is null, int64 ids of the document
    zstandard frame of the chunk index          uint32 ids in the chunk, then uint32 bytes of each plane
    footer: uint32 chunks, uint32 planes per chunk, uint8 bits per plane row (1 or 8), uint64 bytes of the
            document table, uint64 bytes of the chunk index, uint64 documents, "IDPLANE1"

A chunk holds ``block`` ids (the last may hold fewer).  Byte planes put byte k of
every id together; bit planes do so with bit k.  High planes of small ids are
constant and compress to nothing.  The index gives every plane's place, so any
chunk is read without those before it.

Defined cases: null and empty texts have only the end id; a null doc_id sorts
first; rows that repeat a doc_id stay separate rows, ordered by their text's
hash; an empty table writes no file and gives no rows; other columns are not
read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.llm.shared import filesystem, id_and_text, partitions_for, publish, shared_folder, slices, written
from reelflow.llm.tokenizing import text_ids

MAGIC = b"IDPLANE1"
FOOTER = struct.Struct("<IIBQQQ8s")
MANIFEST = "part int, file string, n_docs bigint, n_ids bigint"
RESULT = "doc_id bigint, part int, at bigint, n_tokens bigint, ids_crc32 bigint"


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """Planes of a block of uint32 ids: 32 bit planes (``bits`` 1) or 4 byte planes (``bits`` 8)."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(4)]
    return [row.tobytes() for row in np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    """The block of ``n`` ids that ``to_planes`` took apart."""
    if bits == 8:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    cells = np.unpackbits(np.stack([np.frombuffer(p, np.uint8) for p in planes]), axis=1, count=n)
    return np.packbits(cells.T, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file; holds one block of ids and the table of its documents' lengths."""

    def __init__(self, out, block: int, bits: int, level: int):
        self.out, self.block, self.bits = out, block, bits
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.index: list[tuple[int, ...]] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.block:
            rest = np.concatenate(self.waiting)
            whole = len(rest) // self.block * self.block
            for at in range(0, whole, self.block):
                self.chunk(rest[at:at + self.block])
            self.waiting, self.n_waiting = [rest[whole:]], len(rest) - whole

    def chunk(self, ids: np.ndarray) -> None:
        frames = [self.zstd.compress(p) for p in to_planes(ids, self.bits)]
        self.index.append((len(ids), *map(len, frames)))
        for frame in frames:
            self.out.write(frame)

    def close(self) -> None:
        if self.n_waiting:
            self.chunk(np.concatenate(self.waiting))
        docs = self.zstd.compress(
            np.array([d or 0 for d in self.doc_ids], "<i8").tobytes()
            + np.array([d is None for d in self.doc_ids], np.uint8).tobytes()
            + np.array(self.lengths, "<i8").tobytes())
        index = self.zstd.compress(np.array(self.index, "<u4").tobytes())
        self.out.write(docs)
        self.out.write(index)
        self.out.write(FOOTER.pack(len(self.index), 32 // self.bits, self.bits, len(docs), len(index),
                                   len(self.doc_ids), MAGIC))


class PlaneReader:
    """Reads a plane file by its footer, one chunk at a time."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        chunks, self.planes, self.bits, n_docs, n_index, docs, magic = FOOTER.unpack(
            source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a plane file")
        at = size - FOOTER.size - n_index
        unpack = zstandard.ZstdDecompressor()
        index = unpack.decompress(source.read_at(n_index, at)) if chunks else b""
        self.index = np.frombuffer(index, "<u4").reshape(chunks, 1 + self.planes).astype(np.int64)
        self.starts = len(MAGIC) + np.concatenate([[0], np.cumsum(self.index[:, 1:].sum(axis=1))]).astype(np.int64)
        table = unpack.decompress(source.read_at(n_docs, at - n_docs))
        null = np.frombuffer(table, np.uint8, docs, 8 * docs)
        self.lengths = np.frombuffer(table, "<i8", docs, 9 * docs)
        self.doc_ids = [None if n else int(d) for d, n in zip(np.frombuffer(table, "<i8", docs), null)]

    def chunk(self, k: int) -> np.ndarray:
        n, *sizes = (int(x) for x in self.index[k])
        data = self.source.read_at(sum(sizes), int(self.starts[k]))
        unpack, planes, at = zstandard.ZstdDecompressor(), [], 0
        for size in sizes:
            planes.append(unpack.decompress(data[at:at + size]))
            at += size
        return from_planes(planes, n, self.bits)

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """doc_id, place of its first id in the file, ids, and their CRC-32; bounded by one chunk."""
        k, chunk, used, at = 0, np.zeros(0, "<u4"), 0, 0
        for doc_id, length in zip(self.doc_ids, self.lengths.tolist()):
            crc, left = 0, length
            while left:
                if used == len(chunk):
                    chunk, used, k = self.chunk(k), 0, k + 1
                take = min(left, len(chunk) - used)
                crc = zlib.crc32(chunk[used:used + take].tobytes(), crc)
                used, left = used + take, left - take
            yield doc_id, at, length, crc
            at += length


def write_planes(docs: DataFrame, vocabulary_path: str, end_id: int = 0, block: int = 65536, bits: int = 8,
                 level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Encode every whole text, append ``end_id``, write plane files in ascending id order.

    Returns the folder and its manifest (part, file, n_docs, n_ids); part p holds
    smaller ids than part p + 1.  One range shuffle of the texts; each task
    writes one file and holds one block.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "planes")
    ordered = (id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
               .repartitionByRange(partitions_for(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = (r for b in slices(batches) for r in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()))
        first = next(rows, None)
        if first is None:
            return
        encode, end = text_ids(vocabulary_path, "byte").ids, np.array([end_id], "<u4").tobytes()
        part, made = TaskContext.get().partitionId(), {}

        def fill(out) -> None:
            writer = PlaneWriter(out, block, bits, level)
            for doc_id, text in (r for head in ([first], rows) for r in head):
                writer.add(doc_id, np.frombuffer(encode(text) + end, "<u4"))
            writer.close()
            made.update(n_docs=len(writer.doc_ids), n_ids=writer.n_ids)

        name = publish(folder, f"part-{part:05d}", fill)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name],
                                          "n_docs": pa.array([made["n_docs"]], pa.int64()),
                                          "n_ids": pa.array([made["n_ids"]], pa.int64())})

    return folder, written(ordered.mapInArrow(write, MANIFEST), "planes-manifest")


def read_planes(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files themselves.

    The manifest has one row per file; only their totals meet in one place.
    """
    spark = manifest.sparkSession
    parts = sorted((r.part, r.n_ids) for r in manifest.select("part", "n_ids").collect())   # one row per file
    starts, total = [], 0
    for part, n in parts:
        starts.append((part, total))
        total += n
    bases = spark.createDataFrame(starts, "part int, base bigint")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for part, file in zip(batch.column("part").to_pylist(), batch.column("file").to_pylist()):
                with fs.open_input_file(f"{root}/{file}") as source:
                    rows = []
                    for row in PlaneReader(source).documents():
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield table(part, rows)
                            rows = []
                    yield table(part, rows)

    def table(part: int, rows: list[tuple]) -> pa.RecordBatch:
        ids, at, n, crc = zip(*rows) if rows else ([], [], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(at, pa.int64()),
             pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    files = manifest.select("part", "file").repartition(max(1, len(parts)))
    return (files.mapInArrow(load, RESULT).join(F.broadcast(bases), "part")
            .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))
