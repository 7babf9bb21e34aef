"""Top lists: the best ``k`` entries of a key, selected in parts and merged as a tree.

An entry is (behind, id) with ``behind`` the negated score, so lists ascend by
score from the highest and by id where scores are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = pa.struct([("behind", pa.int64()), ("id", pa.int64())])
LIST = "array<struct<behind: bigint, id: bigint>>"


def best(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` entries of every key, ordered by key, score from the highest, id."""
    order = np.lexsort((ids, -scores, keys))
    keys, scores, ids = keys[order], scores[order], ids[order]
    new = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    place = np.arange(len(keys)) - np.repeat(new, np.diff(new, append=len(keys)))
    held = place < k
    return keys[held], scores[held], ids[held]


def as_lists(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The keys of ``best`` entries, once each, and their lists."""
    new = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    entries = pa.StructArray.from_arrays([pa.array(-scores, pa.int64()), pa.array(ids, pa.int64())], fields=list(ENTRY))
    return keys[new], pa.ListArray.from_arrays(pa.array([*new, len(keys)], pa.int32()), entries)


def merged(lists: DataFrame, key: str, parts: int, k: int, fan_in: int = 16) -> DataFrame:
    """One list of the best ``k`` per key from lists (key, part, top): up to ``fan_in`` meet in a group at each level.

    ``part`` is below ``parts``; a group holds at most ``fan_in * k`` entries per list and part, however many parts there are.
    """
    left = max(1, parts)
    while True:
        left = -(-left // fan_in)
        lists = (lists.groupBy(key, F.expr(f"part div {fan_in}").cast("long").alias("part"))
                 .agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")))
        if left == 1:
            return lists.select(key, "top")


def ranked(lists: DataFrame, key: str, id_name: str) -> DataFrame:
    """Rows (key, rank from 1, id, score) of merged lists."""
    return (lists.select(key, F.posexplode("top").alias("at", "entry"))
            .select(key, (F.col("at") + 1).cast("int").alias("rank"), F.col("entry.id").alias(id_name),
                    (-F.col("entry.behind")).alias("score")))
