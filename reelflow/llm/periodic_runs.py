"""Periodic runs of words: maximal pairs in a bottom-up walk of the LCP-interval tree.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) of at least ``max(min_words, times * q)`` words that no
neighbouring word extends with period q kept.

1. Words of a few documents at a time become numbers.  Suffixes are sorted within
   their document by prefix doubling, in which only suffixes that still share
   their prefix with another are sorted again.  Suffixes that share fewer words
   than any run needs leave here.
2. Kasai's scan gives the longest common prefix (LCP) of neighbours in that order.
3. The LCP-interval tree is walked bottom-up.  An interval with value l holds the
   positions of its suffixes in order, and lists of them by the word to their
   left.  When a child joins, its positions meet those of other children: a pair
   (i, j) of unlike left words is maximal, with lcp exactly l.  Only distances
   d = j - i with l >= (times - 1) * d and l + d >= min_words are looked at; the
   pair's words i to j + l then are a stretch of period d that neither side
   extends, so it is a run as it stands.  A run is also met at multiples of its
   period; of pairs with one stretch the smallest distance is the period.

Within l / (times - 1) words of a position the occurrences of one prefix are an
arithmetic progression (``times`` is 3 at least, so that they overlap by half),
and all but its first have the same word to their left.  So a position needs to
look at its successor and at the first position of its window alone, and the
partners are the members of one class list; the smaller child is always put into
the larger, and the work stays near n log n.

Defined cases: null, empty and blank texts have no words and no runs; words are
maximal runs of bytes other than space and 0x09 to 0x0D; rows that repeat an id,
or have none, are documents of their own; an empty table gives no rows; columns
other than the two read are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.llm.shared import slices
from reelflow.session import ship_package

SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: Words sorted at a time (more only where one document has more).
BATCH_WORDS = 400_000


def suffix_groups(words: np.ndarray, least: int) -> np.ndarray:
    """Suffixes that share ``least`` words or more with another, rounded down to a power of two, in suffix order.

    ``words`` numbers the words so that those of unlike documents differ and each document ends with a word of its own.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(np.diff(words[order], prepend=-1))
    rank[order] = np.repeat(first, np.diff(first, append=n))          # a group's rank is its first place
    places, width, kept = np.arange(n), 1, None
    while True:
        group = rank[order[places]]
        alone = np.ones(len(places), bool)
        same = group[1:] == group[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        places, group = places[~alone], group[~alone]
        if kept is None and 2 * width > least:
            kept = places
        if not len(places):
            break
        suffix = order[places]
        after = rank[suffix + width]                                   # shared words never reach past the document's end
        sub = np.lexsort((after, group))
        suffix, group, after = suffix[sub], group[sub], after[sub]
        order[places] = suffix
        new = np.ones(len(places), bool)
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        heads = np.flatnonzero(new)
        rank[suffix] = np.repeat(places[heads], np.diff(heads, append=len(places)))
        width *= 2
    return order[places if kept is None else kept]


def common_prefixes(words: list[int], order: list[int], least: int) -> list[int]:
    """Shared words of each suffix and the one before it in the order (Kasai).

    Suffixes that share ``least`` words with no other are missing from the order, so no smaller count is carried on.
    """
    before = dict(zip(order[1:], order))
    shared, found, last = 0, {}, 0
    for i in sorted(before):
        shared -= i - last
        if shared < least:
            shared = 0
        j = before[i]
        while words[i + shared] == words[j + shared]:
            shared += 1
        found[i], last = shared, i
    return [0, *(found[i] for i in order[1:])]


class Positions:
    """Positions of an interval's suffixes in order, and by the word to their left."""

    __slots__ = ("all", "by_left")

    def __init__(self, position: int, left: int):
        self.all, self.by_left = [position], {left: [position]}


def join(a: Positions, b: Positions, shared: int, times: int, min_words: int, left: list[int], found: dict) -> Positions:
    """``a`` and ``b``, children of an interval of value ``shared``, as one; the maximal pairs between them go to ``found``."""
    if len(a.all) < len(b.all):
        a, b = b, a
    reach = shared // (times - 1)
    everywhere, classes = a.all, a.by_left
    pairs = []
    if reach:
        for word, members in b.by_left.items():
            for p in members:
                at = bisect_left(everywhere, p)
                if at < len(everywhere):
                    s = everywhere[at]
                    if s - p <= reach and left[s] != word:             # p is first, its partners are one class
                        others = classes[left[s]]
                        for k in range(bisect_left(others, s), len(others)):
                            if others[k] - p > reach:
                                break
                            pairs.append((p, others[k]))
                if at:
                    low = bisect_left(everywhere, p - reach, 0, at)
                    if low < at and left[everywhere[low]] != word:     # only the first of the window can differ from p
                        pairs.append((everywhere[low], p))
        for i, j in pairs:
            if shared + j - i >= min_words:
                span = (i, j + shared)
                if found.get(span, reach + 1) > j - i:
                    found[span] = j - i
    if len(b.all) > 16:
        everywhere.extend(b.all)
        everywhere.sort()
        for word, members in b.by_left.items():
            mine = classes.setdefault(word, [])
            mine.extend(members)
            mine.sort()
    else:
        for word, members in b.by_left.items():
            mine = classes.setdefault(word, [])
            for p in members:
                insort(everywhere, p)
                insort(mine, p)
    return a


def runs_of_order(words: list[int], order: list[int], times: int, min_words: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one document from its suffix order; ``words`` starts with a word found nowhere else."""
    least, found = min_words - min_words // times, {}
    left = [-1, *words]                                                # the word left of position i
    stack: list[tuple[int, Positions]] = []                            # open intervals: value, positions so far
    shared = common_prefixes(words, order, least)
    shared.append(0)
    for place, position in enumerate(order):
        held, value, level = Positions(position, left[position]), len(words), shared[place + 1]
        while stack and stack[-1][0] > level:
            value, below = stack.pop()
            held = join(below, held, value, times, min_words, left, found)
        if level < least:
            stack.clear()
        elif stack and stack[-1][0] == level:
            stack[-1] = (level, join(stack[-1][1], held, level, times, min_words, left, found))
        else:
            stack.append((level, held))
    return sorted((i, end - i, d) for (i, end), d in found.items())


def runs_of_documents(documents: list[list[bytes]], times: int = 4, min_words: int = 6) -> list[list[tuple[int, int, int]]]:
    """The runs of each document's words."""
    numbers = {w: n for n, w in enumerate({w for d in documents for w in d})}
    sizes = np.array([len(d) + 1 for d in documents], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    words = np.zeros(int(starts[-1]), np.int64)
    for at, d in zip(starts.tolist(), documents):
        words[at:at + len(d)] = np.fromiter(map(numbers.__getitem__, d), np.int64, len(d))
        words[at + len(d)] = len(numbers)
    words += np.repeat(np.arange(len(documents)), sizes) * (len(numbers) + 1)
    order = suffix_groups(words, min_words - min_words // times)
    owner = np.searchsorted(starts, order, "right") - 1                # the order keeps documents together
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    bounds = np.flatnonzero(np.diff(owner, prepend=-1, append=-1)) if len(owner) else np.zeros(0, np.int64)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        doc = int(owner[lo])
        at, stop = int(starts[doc]), int(starts[doc + 1])
        found[doc] = runs_of_order(words[at:stop].tolist(), (order[lo:hi] - at).tolist(), times, min_words)
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: those of a run after its first period go."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, gone in zip(words, np.cumsum(drop).tolist()) if not gone]


def detect(times: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            ids, texts = batch.column("doc_id"), batch.column("text")
            lo, words, size = 0, [], 0
            for k in range(batch.num_rows):
                words.append((texts[k].as_py() or b"").split())
                size += len(words[-1])
                if size >= BATCH_WORDS or k == batch.num_rows - 1:
                    yield result(ids.slice(lo, len(words)), words, runs_of_documents(words, times, min_words))
                    lo, words, size = k + 1, [], 0

    return run


def result(ids: pa.Array, words: list[list[bytes]], runs: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    cells = np.array([r for part in runs for r in part], np.int64).reshape(-1, 3)
    entries = pa.StructArray.from_arrays([pa.array(cells[:, k]) for k in range(3)], fields=list(RUN))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries),
         pa.array([b" ".join(collapsed(w, r)).decode() for w, r in zip(words, runs)], pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, times: int = 4, min_words: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, its runs by start and period, and its words without their repeats; no shuffle.

    ``times`` (3 or more) is the least number of periods in a run.
    """
    if times < 3 or min_words < times:
        raise ValueError("runs need three periods or more, and as many words")
    ship_package(docs.sparkSession)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
            .mapInArrow(detect(times, min_words), SCHEMA))
