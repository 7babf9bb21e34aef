"""Order-preserving concatenation per key, in two levels.

``collect_list`` has no order, so rows are collected as ``struct(pos, text)``
and sorted. To keep a hot key from sorting millions of rows in one task, rows
are first joined inside blocks of ``POS_BLOCK`` positions (many tasks), then
the per-block strings (a few per key) are joined in block order. Only the
final string of a key — the output itself — is held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow.operators.blocked import POS_BLOCK, pos_block


def _sorted_join(order: str, value: str, sep: str) -> Column:
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return F.array_join(F.transform(items, lambda x: x.getField("v")), sep)


def _sorted_joins(order: str, values: dict[str, str]) -> list[Column]:
    """Several ordered string joins from one sorted collection (``out → (column, sep)``)."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"),
                                                 *[F.col(c).alias(f"v{i}") for i, (c, _) in enumerate(values.values())])))
    def field(i: int):
        return lambda x: x.getField(f"v{i}")
    return [F.array_join(F.transform(items, field(i)), sep).alias(out)
            for i, (out, (_, sep)) in enumerate(values.items())]


def ordered_chunks(df: DataFrame, keys: list[str], order: str, value: Column | str, sep: str,
                   block_size: int = POS_BLOCK) -> DataFrame:
    """First level only: ``(keys, block, chunk)`` — the document as ordered pieces.

    Use this instead of :func:`ordered_concat` when one key's document could
    outgrow a single value (Spark strings stop at 2 GB): writing the chunks
    sorted by ``(key, block)`` produces the same file without one task ever
    holding the whole document.
    """
    value = F.col(value) if isinstance(value, str) else value
    d = df.select(*keys, F.col(order).alias("_o"), value.alias("_v"), pos_block(order, block_size).alias("block"))
    return d.groupBy(*keys, "block").agg(_sorted_join("_o", "_v", sep).alias("chunk"))


def ordered_concat(df: DataFrame, keys: list[str], order: str, value: Column | str, sep: str, out: str,
                   count_as: str | None = None, firsts: dict[str, str] | None = None,
                   lasts: dict[str, str] | None = None, more: dict[str, tuple[Column | str, str]] | None = None,
                   block_size: int = POS_BLOCK) -> DataFrame:
    """``string_agg(value, sep ORDER BY order)`` per ``keys``; ``order`` is unique per key.

    Returns ``keys + [out]``, plus the row count as ``count_as``, for each
    ``firsts``/``lasts`` entry ``name → column`` that column's value on the
    first/last row by ``order``, and for each ``more`` entry
    ``name → (column, sep)`` another ordered join — all in the same two
    aggregation passes.
    """
    firsts, lasts, more = firsts or {}, lasts or {}, more or {}
    strings = {out: (value, sep), **more}
    cols = {n: (F.col(v) if isinstance(v, str) else v) for n, (v, _) in strings.items()}
    extra = {**{f"_f_{n}": c for n, c in firsts.items()}, **{f"_l_{n}": c for n, c in lasts.items()}}
    d = df.select(*keys, F.col(order).alias("_o"), pos_block(order, block_size).alias("_blk"),
                  *[c.alias(f"_v_{n}") for n, c in cols.items()],
                  *[F.col(c).alias(a) for a, c in extra.items()])
    parts = d.groupBy(*keys, "_blk").agg(
        *_sorted_joins("_o", {f"_p_{n}": (f"_v_{n}", sep) for n, (_, sep) in strings.items()}),
        F.count(F.lit(1)).alias("_n"),
        *[F.min_by(f"_f_{n}", "_o").alias(f"_f_{n}") for n in firsts],
        *[F.max_by(f"_l_{n}", "_o").alias(f"_l_{n}") for n in lasts])
    aggs = _sorted_joins("_blk", {n: (f"_p_{n}", sep) for n, (_, sep) in strings.items()})
    if count_as:
        aggs.append(F.sum("_n").alias(count_as))
    aggs += [F.min_by(f"_f_{n}", "_blk").alias(n) for n in firsts]
    aggs += [F.max_by(f"_l_{n}", "_blk").alias(n) for n in lasts]
    return parts.groupBy(*keys).agg(*aggs)


def ordered_collect(df: DataFrame, keys: list[str], order: str, value: Column, out: str,
                    sums: dict[str, Column] | None = None, block_size: int = POS_BLOCK) -> DataFrame:
    """``array_agg(value ORDER BY order)`` per ``keys`` in two levels (sorted per block, then blocks in order).

    ``value`` may be any column (e.g. a struct); ``order`` must be an integer
    list position, unique per key. ``sums`` are additive per-key totals
    (counts, count-ifs, DECIMAL sums) computed in the same two passes, so no
    extra aggregation and join is needed for them.
    """
    sums = sums or {}
    d = df.select(*keys, F.col(order).alias("_o"), value.alias("_v"), pos_block(order, block_size).alias("_blk"),
                  *[c.alias(f"_s_{n}") for n, c in sums.items()])
    parts = d.groupBy(*keys, "_blk").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_o", "_v"))), lambda x: x.getField("_v")).alias("_part"),
        *[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums])
    return parts.groupBy(*keys).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_blk", "_part"))),
                              lambda x: x.getField("_part"))).alias(out),
        *[F.sum(f"_s_{n}").alias(n) for n in sums])
