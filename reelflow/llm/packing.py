"""Best-fit packing of token sequences by the sum-of-squares rule.

A sequence that holds h of its ``capacity`` tokens has the residual gap
capacity - h.  A piece of n tokens goes to a new sequence or to an open one
with enough room, whichever makes the sum over all gaps of the squared number
of open sequences with that gap smallest; a tie goes to the fullest sequence.

On Spark, pieces are dealt evenly over shards of about ``shard_pieces`` pieces
by the hash of their key, and each shard is packed on its own, longest first.
Sequences that stay open are the pieces of the next level, which is packed the
same way, until a level fits in one shard or joins hardly any.  A shard holds
lengths and keys only, never texts or ids, and its size does not grow with the
table.

Defined cases: null and empty texts are one piece that holds the end id alone;
a null doc_id keeps its rows; rows that repeat a doc_id are packed as documents
of their own; an empty table gives no rows; other columns are not read.  Only
documents longer than a sequence are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.llm.shared import ceil_div, id_and_text, slices, written
from reelflow.llm.tokenizing import text_ids

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"
PLACED = "item bigint, bin bigint, offset bigint, filled bigint"


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, packed in the order given, and what each bin holds in the end."""
    counts = np.zeros(capacity + 1, np.int64)            # open bins by what they hold
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        top = capacity - n
        # change of the sum of squares when a bin that holds h takes n more; place 0 stands for a new bin
        change = 2 * counts[n:n + top + 1] - 2 * counts[:top + 1] + 2
        change[0] = 2 * counts[n] + 1
        if n == capacity:
            change[0] = 0
        elif top:
            change[top] = 1 - 2 * counts[top]            # a full bin is no longer open
        change[1:][counts[1:top + 1] == 0] = np.iinfo(np.int64).max
        h = top - int(np.argmin(change[::-1]))           # the fullest among equals
        if h:
            b = open_bins[h].pop()
            counts[h] -= 1
        else:
            b = len(filled)
            filled.append(0)
        bins[k], offsets[k] = b, filled[b]
        filled[b] += n
        if filled[b] < capacity:
            open_bins[filled[b]].append(b)
            counts[filled[b]] += 1
    return bins, offsets, np.array(filled, np.int64)


def token_pieces(docs: DataFrame, vocabulary_path: str, capacity: int = 2048, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids (packed little-endian uint32) of every whole text and its end id."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_ids(vocabulary_path, "word").ids
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text) + end
                rows += [(doc_id, k, at // 4, min(len(ids) - at, 4 * capacity) // 4, ids[at:at + 4 * capacity])
                         for k, at in enumerate(range(0, len(ids), 4 * capacity))]
            if rows:
                doc_id, piece, start, length, ids = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(cut, PIECES)


def pack_items(items: DataFrame, capacity: int, shard_pieces: int, level: int, n_items: int) -> DataFrame:
    """One level: (item, length) -> (item, bin, offset, filled), each shard by the sum-of-squares rule."""
    shards = max(1, ceil_div(n_items, shard_pieces))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "item"], ascending=[False, True], kind="stable")
        bins, offsets, filled = sum_of_squares(frame["length"].to_numpy(), capacity)
        # a bin goes by the number of the first item in it: unique, and the same when a task runs again
        items = frame["item"].to_numpy()
        first = np.full(len(filled), -1, np.int64)
        first[bins[offsets == 0]] = items[offsets == 0]
        return pd.DataFrame({"item": items, "bin": first[bins], "offset": offsets, "filled": filled[bins]})

    return (items.withColumn("shard", F.expr(f"pmod(xxhash64(item, {level}), {shards})"))
            .groupBy("shard").applyInPandas(pack, PLACED))


def pack_pieces(pieces: DataFrame, capacity: int = 2048, shard_pieces: int = 4096) -> DataFrame:
    """Placement (item, sequence_id, offset) of pieces (item bigint, length <= capacity), gapless from 0."""
    todo, places, level = pieces.select("item", "length"), None, 0
    n = todo.count()
    while True:
        placed = written(pack_items(todo, capacity, shard_pieces, level, n), f"packed-{level}")
        if places is None:
            places = placed.select("item", F.col("bin").alias("sequence_id"), "offset")
        else:
            moved = placed.select(F.col("item").alias("sequence_id"), "bin", F.col("offset").alias("shift"))
            places = places.join(moved, "sequence_id", "left").select(
                "item", F.coalesce("bin", "sequence_id").alias("sequence_id"),
                (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
        bins = placed.where("offset = 0").select(F.col("bin").alias("item"), F.col("filled").alias("length"))
        todo = bins.where(F.col("length") < capacity)
        n_before, n = n, todo.count()
        if n_before <= shard_pieces or n > 0.98 * n_before and level:
            return places
        level += 1


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = 2048, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of every piece of every document."""
    cut = token_pieces(docs, vocabulary_path, capacity, end_id, id_col, text_col)
    pieces = written(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")   # numbered once
    places = pack_pieces(pieces, capacity)
    return pieces.join(places, "item").drop("item")
