"""Skew-safe ordered window helpers.

A window ``PARTITION BY video_id ORDER BY pos`` puts a whole video in one task;
if one video holds a third of the corpus that task is the job. These helpers
split every key into blocks of the order column, do the row-level work inside
``(key, block)`` partitions (bounded size), and carry what crosses a block
boundary through a small per-block table (one row per block, so a few rows
per key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POS_BLOCK = 4096          # rows per block for dense list positions
TIME_BLOCK_S = 60.0       # seconds per block for media-time ordering
SUPER_BLOCK = 4096        # blocks per super-block in the two-level carry tables


def pos_block(col: str = "pos", size: int = POS_BLOCK) -> Column:
    return F.floor(F.col(col) / F.lit(size))


def time_block(col: str, width: float = TIME_BLOCK_S) -> Column:
    return F.floor(F.col(col) / F.lit(width))


def join_on(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Equi join on ``cols`` that also matches NULL with NULL (``<=>``), keeping one copy of each column.

    Grouping keeps NULL keys together, so joining a per-group table back must
    not drop them.
    """
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in cols], *[c for c in right.columns if c not in cols])
    cond = None
    for c in cols:
        e = left[c].eqNullSafe(r[f"_r_{c}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in cols])


def _block_key(keys: list[str]) -> Column:
    """One struct key per (key…, block). Struct equality treats NULL fields as equal, so NULL keys
    survive the join back, and windows, aggregates and joins on it share one hash partitioning."""
    return F.struct(*[F.col(k) for k in keys], F.col("_blk").alias("_blk"))


def _key_only(keys: list[str]) -> Column:
    return F.struct(*[F.col("_bk").getField(k) for k in keys])


def _super(table: DataFrame, super_size: int) -> DataFrame:
    """Add the super-block (``_sb``) of each block and its key ``_sk = struct(_key, _sb)``."""
    return (table.withColumn("_sb", F.floor(F.col("_bno") / F.lit(super_size)))
                 .withColumn("_sk", F.struct(F.col("_key").alias("_key"), F.col("_sb").alias("_sb"))))


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column | str, out: str,
                block: Column | None = None, key_totals: dict[str, Column] | None = None,
                super_size: int = SUPER_BLOCK) -> DataFrame:
    """Inclusive running sum of ``value`` per ``keys`` ordered by the unique ``order`` column.

    Rows are shuffled once, on ``(keys, block)``; the in-block sum, the block
    totals and the join with the per-block offsets all reuse that partitioning.
    Block offsets are prefix sums in two levels — inside super-blocks of
    ``super_size`` blocks, then over one row per super-block — so no task
    orders more than ``super_size`` blocks of one key. ``key_totals``
    (``name → column``) attaches each key's grand total of those columns the
    same way, instead of a join of the rows on the key alone.
    """
    value = F.col(value) if isinstance(value, str) else value
    key_totals = key_totals or {}
    d = df.withColumns({"_blk": pos_block(order) if block is None else block, "_val": value,
                        **{f"_t_{n}": c for n, c in key_totals.items()}})
    d = d.withColumn("_bk", _block_key(keys))
    inside = Window.partitionBy("_bk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_loc", F.sum("_val").over(inside))
    sums = ["_bt", *[f"_t_{n}" for n in key_totals]]
    totals = (d.groupBy("_bk").agg(F.sum("_val").alias("_bt"), *[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in key_totals])
               .withColumns({"_key": _key_only(keys), "_bno": F.col("_bk").getField("_blk")}))
    t = _super(totals, super_size)
    within = Window.partitionBy("_sk").orderBy("_bno").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_offa", F.coalesce(F.sum("_bt").over(within), F.lit(0)))
    st = (t.groupBy("_sk").agg(*[F.sum(c).alias(c) for c in sums])
           .withColumns({"_key": F.col("_sk").getField("_key"), "_sb": F.col("_sk").getField("_sb")}))
    over = Window.partitionBy("_key").orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_key")
    st = st.select("_sk", F.coalesce(F.sum("_bt").over(over), F.lit(0)).alias("_offb"),
                   *[F.sum(f"_t_{n}").over(whole).alias(n) for n in key_totals])
    offsets = t.join(st, "_sk").select("_bk", (F.col("_offa") + F.col("_offb")).alias("_off"), *key_totals)
    return (d.drop(*[f"_t_{n}" for n in key_totals]).join(offsets, "_bk")
             .withColumn(out, F.col("_off") + F.col("_loc"))
             .drop("_bk", "_blk", "_val", "_off", "_loc"))


def next_in_order(df: DataFrame, keys: list[str], order: list[str], cols: list[str], block: Column,
                  prefix: str = "next_", super_size: int = SUPER_BLOCK) -> DataFrame:
    """``lead(c) OVER (PARTITION BY keys ORDER BY order)`` for every ``c`` in ``cols``.

    ``block`` must be monotone in ``order`` (e.g. a time bucket of the first
    order column). Inside a block ``lead`` is exact; the last row of a block
    takes the first row of the next non-empty block of the same key, found in
    two levels like the offsets of :func:`running_sum`.
    """
    return _neighbour(df, keys, order, cols, block, prefix, forward=True, super_size=super_size)


def prev_in_order(df: DataFrame, keys: list[str], order: list[str], cols: list[str], block: Column,
                  prefix: str = "prev_", super_size: int = SUPER_BLOCK) -> DataFrame:
    """``lag(c) OVER (PARTITION BY keys ORDER BY order)``, blocked like :func:`next_in_order`:
    the first row of a block takes the last row of the previous non-empty block."""
    return _neighbour(df, keys, order, cols, block, prefix, forward=False, super_size=super_size)


def _neighbour(df: DataFrame, keys: list[str], order: list[str], cols: list[str], block: Column, prefix: str,
               forward: bool, super_size: int) -> DataFrame:
    d = df.withColumn("_blk", block).withColumn("_bk", _block_key(keys))
    inside = Window.partitionBy("_bk").orderBy(*order)
    shift = F.lead if forward else F.lag
    pick = F.min_by if forward else F.max_by
    d = d.withColumn("_nb", shift(F.struct(*cols)).over(inside))
    edge = (d.groupBy("_bk").agg(pick(F.struct(*cols), F.struct(*order)).alias("_edge"))
             .withColumns({"_key": _key_only(keys), "_bno": F.col("_bk").getField("_blk")}))
    t = _super(edge, super_size)
    t = t.withColumn("_inner", shift("_edge").over(Window.partitionBy("_sk").orderBy("_bno")))
    se = (t.groupBy("_sk").agg(pick("_edge", "_bno").alias("_sedge"))
           .withColumns({"_key": F.col("_sk").getField("_key"), "_sb": F.col("_sk").getField("_sb")}))
    se = se.select("_sk", shift("_sedge").over(Window.partitionBy("_key").orderBy("_sb")).alias("_outer"))
    carry = t.join(se, "_sk", "left").select("_bk", F.coalesce("_inner", "_outer").alias("_carry"))
    d = d.join(carry, "_bk", "left").withColumn("_nb", F.coalesce("_nb", "_carry"))
    d = d.withColumns({prefix + c: F.col("_nb").getField(c) for c in cols})
    return d.drop("_bk", "_blk", "_carry", "_nb")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: str, block: Column,
                  super_size: int = SUPER_BLOCK) -> DataFrame:
    """``df`` with ``value`` replaced by its last non-NULL value at or before the row, per ``keys`` in ``order``.

    Inside a ``(key, block)`` a running ``last``; what enters a block from before
    is the last value of the blocks before it, in two levels like the offsets of
    :func:`running_sum`. Blocks come from rows, so empty stretches cost nothing.
    """
    d = df.withColumn("_blk", block).withColumn("_bk", _block_key(keys))
    inside = Window.partitionBy("_bk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_own", F.last(value, ignorenulls=True).over(inside))
    edge = (d.groupBy("_bk").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_edge"))
             .withColumns({"_key": _key_only(keys), "_bno": F.col("_bk").getField("_blk")}))
    t = _super(edge, super_size)
    before = Window.partitionBy("_sk").orderBy("_bno").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_inner", F.last("_edge", ignorenulls=True).over(before))
    se = (t.groupBy("_sk").agg(F.max_by("_edge", F.when(F.col("_edge").isNotNull(), F.col("_bno"))).alias("_sedge"))
           .withColumns({"_key": F.col("_sk").getField("_key"), "_sb": F.col("_sk").getField("_sb")}))
    outer = Window.partitionBy("_key").orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1)
    se = se.select("_sk", F.last("_sedge", ignorenulls=True).over(outer).alias("_outer"))
    carry = t.join(se, "_sk", "left").select("_bk", F.coalesce("_inner", "_outer").alias("_carry"))
    return (d.join(carry, "_bk", "left").withColumn(value, F.coalesce("_own", "_carry"))
             .drop("_bk", "_blk", "_own", "_carry"))
