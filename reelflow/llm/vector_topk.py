"""Exact top-k search by inner product: tiled matrix products, partial selection per tile, tree merging.

1. Every vector is scaled and floored to whole numbers.  Scan tasks pack the
   candidates into shards: matrices of at most ``shard_rows`` rows, all of one
   length, so no vector is padded and no row is shuffled on its own.
2. The queries are dealt to blocks of about ``block_rows`` by their id.
3. The grid of blocks and shard columns is dealt out as cells: a shard goes once
   to each block, a block once to each column.  A cell holds one block and the
   few shards of its column; nothing is broadcast, and none of its sizes grows
   with the table.
4. A tile's scores are one matrix product, in single or double precision where
   the largest possible sum is a whole number that the type holds exactly, else
   in Python's integers.  Each tile keeps the best ``k`` per query by partial
   selection; the lists of a cell, then of the columns, are merged as a tree.

Defined cases: rows whose id is null, or whose vector is null or holds a null or
non-finite component (also one that scaling makes so), take no part.  Vectors of
unlike lengths are compared as if the shorter went on in zeros; an empty vector
scores 0.  Rows that repeat an id are candidates of their own, but never of a
query with that id; a query id with several vectors asks with the greatest.
Scores outside of 64 bits count as the nearest 64-bit number.  An empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow.llm.shared import ceil_div, written
from reelflow.llm.toplists import LIST, as_lists, best, merged, ranked
from reelflow.session import ship_package

MATRIX = "seq bigint, length int, ids binary, kind string, cells binary"
BIGGEST = 2 ** 63 - 1
#: Values of a packed matrix, at most (a matrix of longer vectors has fewer rows).
CELLS = 1 << 22
#: Scores that a tile holds at once, at most.
SCORES = 1 << 21


def whole_vectors(ids: pa.Array, vectors: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrices of floored, scaled vectors, one pair for each vector length in the batch."""
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * scale)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    valid = vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    valid &= bad[offsets[1:]] == bad[offsets[:-1]]
    keys = ids.fill_null(0).to_numpy()
    lengths = np.diff(offsets)
    for length in np.unique(lengths[valid]).tolist():
        rows = np.flatnonzero(valid & (lengths == length))
        yield keys[rows], values[offsets[rows][:, None] + np.arange(length)]


def packed(seq: int, ids: np.ndarray, cells: np.ndarray) -> tuple:
    """A matrix as a row, its rows by ascending id; single precision where that is exact."""
    order = np.argsort(ids, kind="stable")
    kind = "<f4" if np.abs(cells).max(initial=0) <= 1 << 24 else "<f8"
    return seq, cells.shape[1], ids[order].astype("<i8").tobytes(), kind, cells[order].astype(kind).tobytes()


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["cells"], row["kind"]).reshape(len(ids), row["length"])


def matrices(batches: Iterator[pa.RecordBatch], scale: float, rows: int, first: int) -> Iterator[tuple]:
    """Packed matrices of a task's vectors, numbered from ``first``; holds ``CELLS`` values of each length at most."""
    held: dict[int, list] = {}
    seq = first

    def flush(length):
        nonlocal seq
        ids, cells = map(np.concatenate, zip(*held.pop(length)))
        seq += 1
        return packed(seq - 1, ids, cells)

    for batch in batches:
        for ids, cells in whole_vectors(batch.column(0), batch.column(1), scale):
            length = cells.shape[1]
            full = max(1, min(rows, CELLS // max(1, length)))
            for at in range(0, len(ids), full):
                held.setdefault(length, []).append((ids[at:at + full], cells[at:at + full]))
                if sum(len(i) for i, _ in held[length]) >= full:
                    yield flush(length)
            if sum(c.size for part in held.values() for _, c in part) > 2 * CELLS:
                yield flush(max(held, key=lambda n: sum(c.size for _, c in held[n])))
    for length in list(held):
        yield flush(length)


def rows_of(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.binary()]
    columns = list(zip(*found)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                      names=["seq", "length", "ids", "kind", "cells"])


def shards_of(scale: float, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in matrices(batches, scale, rows, TaskContext.get().partitionId() << 32):
            yield rows_of([shard])

    return run


def blocks_of(scale: float, rows: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = matrices(table.select(["id", "vector"]).combine_chunks().to_batches(), scale, rows, 0)
        made = pa.Table.from_batches([rows_of(list(found))])
        return made.append_column("block", pa.array([key[0].as_py()] * made.num_rows, pa.int64()))

    return run


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """All inner products, exact: whole numbers in float32, float64 or, saturated, int64."""
    common = min(queries.shape[1], shard.shape[1])
    queries, shard = queries[:, :common], shard[:, :common]
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0)) * max(1, common)
    if bound < 1 << 53:
        kind = np.float32 if bound < 1 << 24 else np.float64
        return queries.astype(kind) @ shard.astype(kind).T
    exact = whole_numbers(queries) @ whole_numbers(shard).T
    return np.clip(exact, -BIGGEST, BIGGEST).astype(np.int64)


def whole_numbers(cells: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in cells.ravel().tolist()] or [0], dtype=object)[:cells.size].reshape(cells.shape)


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, shard: np.ndarray, k: int):
    """The best ``k`` of a shard for every query: (place of the query, score, id); the query's own id is left out."""
    step = max(1, SCORES // max(1, len(ids)))
    for at in range(0, len(query_ids), step):
        own = query_ids[at:at + step]
        scores = products(queries[at:at + step], shard)
        allowed = np.ones(scores.shape, bool)
        lo, hi = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
        for row in np.flatnonzero(hi > lo):
            allowed[row, lo[row]:hi[row]] = False
        least = -np.inf if scores.dtype.kind == "f" else -BIGGEST - 1
        scores[~allowed] = least
        if len(ids) > k:
            allowed &= scores >= np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k, None]
        row, column = np.nonzero(allowed)
        yield best(row + at, scores[row, column].astype(np.int64), ids[column], k)


def cell(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("part", pa.int64()),
                        ("top", pa.list_(pa.struct([("behind", pa.int64()), ("id", pa.int64())])))])

    def run(key: tuple, shards: pa.Table, blocks: pa.Table) -> pa.Table:
        found = []
        for block in blocks.to_pylist():
            query_ids, queries = unpacked(block)
            parts = [part for n in range(shards.num_rows)
                     for part in tile(query_ids, queries, *unpacked(shards.slice(n, 1).to_pylist()[0]), k)]
            if parts:
                place, top = as_lists(*best(*map(np.concatenate, zip(*parts)), k))
                found.append(pa.Table.from_arrays(
                    [pa.array(query_ids[place], pa.int64()), pa.array(np.full(len(place), key[1].as_py()), pa.int64()), top], schema=schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id",
          vector_col: str = "embedding", block_rows: int = 4096, shard_rows: int = 4096) -> DataFrame:
    """The ``k`` rows of highest inner product for each query row: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the rows of ``vectors``.
    """
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
                          is_query.alias("asks"))
    shards = rows.select("id", "vector").mapInArrow(shards_of(scale, shard_rows), MATRIX)
    usable = F.col("asks") & F.col("vector").isNotNull() & F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    asked = written(rows.where(usable).groupBy("id").agg(F.max("vector").alias("vector")), "queries")
    n_blocks, columns = max(1, ceil_div(asked.count(), block_rows)), max(1, ceil_div(vectors.count(), shard_rows))
    blocks = (asked.withColumn("block", F.expr(f"pmod(xxhash64(id), {n_blocks})"))
              .groupBy("block").applyInArrow(blocks_of(scale, block_rows), MATRIX + ", block bigint"))
    shards = (shards.withColumn("col", F.expr(f"pmod(xxhash64(seq), {columns})"))
              .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))))
    blocks = blocks.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))))
    lists = (shards.groupBy("block", "col").cogroup(blocks.groupBy("block", "col"))
             .applyInArrow(cell(k), f"query_id bigint, part bigint, top {LIST}"))
    return ranked(merged(lists, "query_id", columns, k), "query_id", "vec_id")
