"""Greedy cuts of an ordered sequence by a size budget, without a task that holds a whole key (WIN-6).

A greedy cut depends on every cut before it: a part starts at a row, takes rows
while they fit, and the first that does not fit starts the next part. So a
running sum alone cannot place the cuts. What a stretch of rows does to the cut
before it is a small function, though, and functions can be composed:

1. Rows get the running total of their sizes (blocked running sum) and are put
   into blocks of ``BLOCK_BUDGETS`` budgets of that total.
2. Inside a block every row points at the row that would start the next part if
   a part started here; following the pointers by doubling gives, for every row
   at which a part from an earlier block can end, how far the block's last part
   reaches and how many parts start in the block.
3. These functions are composed from the last block of a super-block to its
   first, and the super-blocks of a key, one short row each, are walked in order.
4. Down again: every super-block's, then every block's incoming reach gives its
   actual parts, and each row its part number.

Only numbers take part; a block, a super-block and a walk are bounded. A super-block
is one row, and so is a key's walk: Python takes them in batches of rows, not in a
call for each, as most keys have one short block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelflow.operators.blocked import SUPER_BLOCK, running_sum
from reelflow.session import checkpoint_root, ship_package

BLOCK_BUDGETS = 64
NO_END = np.iinfo(np.int64).max
LONGS = pa.list_(pa.int64())


def _next_starts(before: np.ndarray, upto: np.ndarray, forced: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: the total that a part starting here may reach, and the row that starts the next part."""
    rows, breaks = np.arange(len(before)), np.append(np.flatnonzero(forced), len(before))
    reach = before + budget
    return reach, np.minimum(np.maximum(np.searchsorted(upto, reach, "right"), rows + 1),
                             breaks[np.searchsorted(breaks[:-1], rows, "right")])


def _block_function(before: np.ndarray, upto: np.ndarray, forced: np.ndarray, base: int, budget: int):
    """Per row at which a part can enter the block: total up to it, reach of the last part then, parts started."""
    n = len(before)
    reach, following = _next_starts(before, upto, forced, budget)
    end, count, ahead = np.append(np.arange(n), n), np.append(np.ones(n, np.int64), 0), np.append(following, n)
    while (ahead < n).any():
        end, count, ahead = np.where(ahead < n, end[ahead], end), count + count[ahead], ahead[ahead]
    entries = max(1, int(np.searchsorted(before, base + budget, "right")))
    first_break = int(forced.argmax()) if forced.any() else n
    entries = min(entries, first_break + 1)
    totals = upto[:entries].copy()
    if first_break < entries:
        totals[-1] = NO_END                               # a break is entered whatever the part before could reach
    return totals, reach[end[:entries]], count[:entries]


def _entry(totals: np.ndarray, reach: int) -> int:
    """The entry of a block after a part that may reach ``reach``; its length where that part takes the whole block."""
    return int(np.searchsorted(totals, reach, "right"))


def _arrays(batch: pa.RecordBatch | pa.Table, name: str) -> list[np.ndarray]:
    return [np.asarray(x.values) for x in batch.column(name)]


def _functions(budget: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_block_function(b, u, np.asarray(f, bool), no * width, budget) for b, u, f, no in zip(
                _arrays(batch, "before"), _arrays(batch, "upto"), [x.as_py() for x in batch.column("forced")],
                batch.column("_bno").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_bk"), *(pa.array([m[k].tolist() for m in made], LONGS) for k in range(3))],
                names=["_bk", "totals", "reach", "parts"])

    return run


def _sequences(column: pa.ListArray) -> Iterator[list[list[np.ndarray]]]:
    """Totals, reaches and parts of the functions in each row of a column of sequences."""
    at, fields = column.offsets.to_numpy(), [column.values.field(name) for name in ("totals", "reach", "parts")]
    fields = [(f.offsets.to_numpy(), f.values.to_numpy()) for f in fields]
    for first, end in zip(at[:-1].tolist(), at[1:].tolist()):
        yield [[values[starts[k]:starts[k + 1]] for k in range(first, end)] for starts, values in fields]


def _composed(totals: list, reach: list, parts: list) -> list[list]:
    """A sequence of functions as one."""
    for k in range(len(totals) - 2, -1, -1):
        at = np.searchsorted(totals[k + 1], reach[k], "right")
        on = at < len(totals[k + 1])
        at = np.where(on, at, 0)
        reach[k], parts[k] = np.where(on, reach[k + 1][at], reach[k]), parts[k] + np.where(on, parts[k + 1][at], 0)
    return [totals[0].tolist(), reach[0].tolist(), parts[0].tolist()]


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of every super-block as one function."""
    for batch in batches:
        made = [_composed(*s) for s in _sequences(batch.column("blocks"))]
        yield pa.RecordBatch.from_arrays([batch.column("_sk"), *(pa.array([m[k] for m in made], LONGS) for k in range(3))],
                                         names=["_sk", "totals", "reach", "parts"])


def _walked(totals: list, reach: list, parts: list, came: int, count: int) -> tuple[list, list]:
    """What each function of a sequence is met with: the reach that comes in, and the parts before it."""
    reaches, counts = [], []
    for t, r, p in zip(totals, reach, parts):
        reaches.append(came)
        counts.append(count)
        at = _entry(t, came)
        if at < len(t):
            came, count = int(r[at]), count + int(p[at])
    return reaches, counts


def _walk(key: str, blocks: str, order: str):
    """Every sequence walked in order, from what comes into it (nothing at the start of a key)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, column = batch.num_rows, batch.column(blocks)
            starts = [batch.column(c).to_pylist() if c in batch.schema.names else [d] * n for c, d in (("came", -1), ("count", 0))]
            made = [_walked(*s, came, count) for s, came, count in zip(_sequences(column), *starts)]
            numbers = pa.ListArray.from_arrays(column.offsets, column.values.field(order))
            yield pa.RecordBatch.from_arrays([batch.column(key), numbers, *(pa.array([m[k] for m in made], LONGS) for k in range(2))],
                                             names=[key, order, "came", "count"])

    return run


def _numbers(budget: int):
    """Part numbers of a block's rows, from 0."""
    def number(before, upto, forced, came, count):
        _, following = _next_starts(before, upto, forced, budget)
        at = int(np.searchsorted(upto, came, "right"))
        at = min(at, int(forced.argmax())) if forced.any() else at
        starts = np.zeros(len(before), np.int64)
        while at < len(before):
            starts[at] = 1
            at = int(following[at])
        return count - 1 + np.cumsum(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [number(b, u, np.asarray(f, bool), c, n).tolist() for b, u, f, c, n in zip(
                _arrays(batch, "before"), _arrays(batch, "upto"), [x.as_py() for x in batch.column("forced")],
                batch.column("came").to_pylist(), batch.column("count").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("_bk"), batch.column("order"), pa.array(made, LONGS)],
                                             names=["_bk", "order", "part"])

    return run


def budget_parts(rows: DataFrame, keys: list[str], order: str, size: Column, budget: int, forced: Column,
                 super_size: int = SUPER_BLOCK, block_budgets: int = BLOCK_BUDGETS) -> DataFrame:
    """``keys + [order, part]``: the greedy part, from 0, of every row of ``rows``.

    A part takes rows, by the whole number ``order`` (unique per key), while their
    sizes (1 or more) add up to at most ``budget``; a larger row is a part alone,
    and a row that is ``forced`` starts a part in any case.
    """
    ship_package(rows.sparkSession)
    width = budget * block_budgets
    d = running_sum(rows.select(*keys, order, size.cast("bigint").alias("_size"), forced.alias("_forced")), keys, order, "_size", "_upto")
    d = d.withColumn("_before", F.col("_upto") - F.col("_size")).withColumn("_bno", F.floor(F.col("_before") / width))
    d = d.withColumn("_bk", F.struct(*keys, "_bno"))
    blocks = d.groupBy("_bk").agg(F.array_sort(F.collect_list(F.struct("_before", "_upto", "_forced", order))).alias("_rows")).select(
        "_bk", F.col("_bk._bno").alias("_bno"), F.col("_rows._before").alias("before"), F.col("_rows._upto").alias("upto"),
        F.col("_rows._forced").alias("forced"), F.col(f"_rows.{order}").alias("order"))
    checkpoint_root(rows.sparkSession)
    blocks = blocks.checkpoint()                          # read three times below: numbers alone, one row a block
    shape = "totals array<bigint>, reach array<bigint>, parts array<bigint>"

    def key(of: str) -> Column:
        return F.struct(*[F.col(of).getField(k) for k in keys])

    def with_(frame: DataFrame, columns: list[str], more: str) -> T.StructType:
        return T.StructType([*[frame.schema[c] for c in columns], *T.StructType.fromDDL(more).fields])

    def sequences(frame: DataFrame, by: str, order: str) -> DataFrame:
        return frame.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "totals", "reach", "parts"))).alias("blocks"))

    def walked(frame: DataFrame, by: str, order: str) -> DataFrame:
        shape = f"{order} array<bigint>, came array<bigint>, count array<bigint>"
        return (frame.mapInArrow(_walk(by, "blocks", order), with_(frame, [by], shape))
                .select(by, F.explode(F.arrays_zip(order, "came", "count")).alias("_x")).select(by, "_x.*"))

    made = blocks.drop("order").mapInArrow(_functions(budget, width), with_(blocks, ["_bk"], shape))
    made = made.withColumn("_bno", F.col("_bk._bno")).withColumn(
        "_sk", F.struct(key("_bk").alias("_key"), F.floor(F.col("_bno") / super_size).alias("_sb")))
    made = sequences(made, "_sk", "_bno")
    supers = made.mapInArrow(_compose, with_(made, ["_sk"], shape)).withColumns({"_key": F.col("_sk._key"), "_sb": F.col("_sk._sb")})
    came = walked(sequences(supers, "_key", "_sb"), "_key", "_sb").select(F.struct("_key", "_sb").alias("_sk"), "came", "count")
    came = walked(made.join(came, "_sk"), "_sk", "_bno").select(
        F.struct(*[F.col("_sk._key").getField(k).alias(k) for k in keys], "_bno").alias("_bk"), "came", "count")
    numbered = blocks.join(came, "_bk").mapInArrow(_numbers(budget), with_(blocks, ["_bk", "order"], "part array<bigint>"))
    return (numbered.select("_bk", F.explode(F.arrays_zip("order", "part")).alias("_row"))
            .select(*[F.col("_bk").getField(k).alias(k) for k in keys], F.col("_row.order").alias(order), F.col("_row.part").alias("part")))
