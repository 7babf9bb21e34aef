"""Benchmark decontamination by SimHash over windows of each item's size.

A benchmark item of m words is compared with every window of m words of every
text.  Words are runs of letters and digits in lower case.  The shingles of an
item or window are its runs of five words (all its words, when it has fewer),
weighted by how often they occur in it.

1. An index of the items' shingles finds the candidates: a window that holds no
   shingle of an item has similarity 0 with it, so only windows that hold one
   are fingerprinted, for the items it belongs to: the 64-bit SimHash adds each
   shingle's weight to or from every bit.
2. Fingerprints within ``radius`` of each other agree in at least one of four
   16-bit blocks up to radius // 4 bits, so the block tables lose none of them;
   nor do they change a result, as the whole distance is computed for every
   fingerprint of step 1.
3. A candidate whose whole fingerprint is within the radius is verified by the
   exact weighted similarity: the sum of the smaller weights over the sum of the
   larger ones must be at least ``similarity``.

Items go to the tasks in blocks of at most ``block_items``, each a broadcast of
bounded size; every block meets every text.  A text's windows are kept as flat
arrays of its words; one document is at one task, with memory in proportion to
its length.

Defined cases: a null or empty text has no window; a null or empty item has no
shingle and matches nothing; a text shorter than an item has no window of its
size; an equal item text under several item_ids is found under each; a null
doc_id keeps its matches; repeated rows each give their matches; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.llm.shared import id_and_text, slices

SHINGLE = 5
BLOCKS, BLOCK_BITS = 4, 16
SCHEMA = "doc_id bigint, item_id bigint, first_word bigint, n_words bigint, similarity double, distance int"
findwords = re.compile(r"[^\W_]+").findall


def word_number(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


class WordNumbers(dict):
    """Word -> 64-bit hash, kept while there is room."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = n = word_number(word)
        return n


_NUMBERS = WordNumbers()


def shingles(text: str) -> tuple[np.ndarray, int]:
    """Shingle hashes in order of place, and the number of words."""
    words = findwords(text.lower())
    ids = np.fromiter(map(_NUMBERS.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    if not width:
        return ids, 0
    n = len(ids) - width + 1
    mix = np.full(n, width, np.uint64)
    for k in range(width):
        mix = (mix ^ ids[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(32)
    return mix, len(words)


def simhash(marks: np.ndarray) -> np.ndarray:
    """Fingerprint of each row of bit sums (rows, 64): a bit is set where the sum is positive."""
    return np.packbits(marks > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash, as (n, 64)."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


class Items:
    """A block of benchmark items: shingles, fingerprints and the Hamming block tables."""

    def __init__(self, rows: list[tuple[int, str]], radius: int):
        self.ids, self.sizes, self.bags, prints = [], [], [], []
        by_shingle: dict[int, list[int]] = {}
        for item_id, text in rows:
            hashes, n = shingles(text or "")
            if not n:
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.sizes.append(n)
            self.bags.append(Counter(hashes.tolist()))
            prints.append(simhash(signs(hashes).sum(axis=0, keepdims=True))[0])
            for h in self.bags[-1]:
                by_shingle.setdefault(h, []).append(k)
        self.by_shingle, self.radius = by_shingle, radius
        self.known = np.array(sorted(by_shingle), np.uint64)
        #: one bit a value of the low 20 bits: whether any item shingle has them
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.known & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.short = sorted({n for n in self.sizes if n < SHINGLE})
        self.prints = np.array(prints, np.uint64)
        self.reach = radius // BLOCKS
        self.tables: list[dict[int, np.ndarray]] = [{} for _ in range(BLOCKS)]

    def near(self, block: int, value: int) -> np.ndarray:
        """Items whose block is within the reach of the value; each value is looked up once."""
        table = self.tables[block]
        if value not in table:
            own = (self.prints >> np.uint64(BLOCK_BITS * block)) & np.uint64((1 << BLOCK_BITS) - 1)
            table[value] = np.bitwise_count(own ^ np.uint64(value)) <= self.reach
        return table[value]

    def candidates(self, prints: np.ndarray, item: int) -> np.ndarray:
        """Which fingerprints are within the radius of the item, by the block tables first."""
        hit = np.zeros(len(prints), bool)
        for block in range(BLOCKS):
            values = ((prints >> np.uint64(BLOCK_BITS * block)) & np.uint64((1 << BLOCK_BITS) - 1)).tolist()
            hit |= np.fromiter((self.near(block, v)[item] for v in values), bool, len(values))
        close = np.bitwise_count(prints ^ self.prints[item]) <= self.radius
        return hit & close


def weighted_similarity(bag: Counter, hashes: list[int]) -> float:
    other = Counter(hashes)
    both = sum(min(n, other[h]) for h, n in bag.items() if h in other)
    return both / (sum(bag.values()) + len(hashes) - both)


def matches(text: str | None, items: Items, similarity: float) -> list[tuple[int, int, int, float, int]]:
    """(item_id, first word, words, similarity, distance) of the best window per item that reaches the similarity."""
    if not text or not items.ids:
        return []
    hashes, n = shingles(text)
    found = short_matches(text, items, n) if items.short else []
    if n < SHINGLE:
        return found
    maybe = np.flatnonzero(items.sieve[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
    if not len(maybe):
        return found
    at = np.searchsorted(items.known, hashes[maybe])
    at[at == len(items.known)] = 0
    maybe = maybe[items.known[at] == hashes[maybe]]
    places: dict[int, list[int]] = {}
    for place, h in zip(maybe.tolist(), hashes[maybe].tolist()):
        for item in items.by_shingle[h]:
            places.setdefault(item, []).append(place)
    for item, held in places.items():
        size = items.sizes[item]
        width = size - SHINGLE + 1                       # shingles of the item and of each window
        if size < SHINGLE or n < size:
            continue
        near = np.array(held)
        first = np.unique((near[:, None] - np.arange(width)[None, :]).reshape(-1))
        first = first[(first >= 0) & (first <= n - size)]
        if not len(first):
            continue
        best = None
        for part in np.split(first, np.flatnonzero(np.diff(first) > 1) + 1):    # runs of neighbouring windows
            lo, hi = int(part[0]), int(part[-1]) + width
            sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(hashes[lo:hi]), axis=0, dtype=np.int32)])
            prints = simhash(sums[width:] - sums[:-width])
            for k in np.flatnonzero(items.candidates(prints, item)).tolist():
                score = weighted_similarity(items.bags[item], hashes[lo + k:lo + k + width].tolist())
                if score >= similarity and (best is None or score > best[0]):
                    best = (score, lo + k, int(np.bitwise_count(prints[k] ^ items.prints[item])))
        if best:
            found.append((items.ids[item], best[1], size, best[0], best[2]))
    return found


def short_matches(text: str, items: Items, n: int) -> list[tuple[int, int, int, float, int]]:
    """Items of fewer than five words are one shingle: a window's similarity is 1 or 0, its distance 0 where 1."""
    words = findwords(text.lower())
    ids = np.fromiter(map(_NUMBERS.__getitem__, words), np.uint64, len(words))
    found = []
    for width in items.short:
        m = n - width + 1
        if m < 1:
            continue
        mix = np.full(m, width, np.uint64)
        for k in range(width):
            mix = (mix ^ ids[k:k + m]) * np.uint64(0x9E3779B97F4A7C15)
            mix ^= mix >> np.uint64(32)
        for item, size in enumerate(items.sizes):
            if size == width:
                at = np.flatnonzero(mix == np.uint64(next(iter(items.bags[item]))))
                if len(at):
                    found.append((items.ids[item], int(at[0]), size, 1.0, 0))
    return found


_ITEMS: dict[int, Items] = {}


def item_blocks(benchmark: DataFrame, block_items: int, item_id_col: str, item_text_col: str) -> list:
    """Broadcasts of at most about ``block_items`` distinct items each."""
    items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"),
                             F.col(item_text_col).cast("string").alias("text"))
    n_blocks, sent = max(1, -(-items.count() // block_items)), []
    for block in range(n_blocks):                        # the stated query set, a block at a time
        rows = items.where(F.expr(f"pmod(xxhash64(item_id, text), {n_blocks}) = {block}")).distinct().collect()
        held = sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        sent.append(benchmark.sparkSession.sparkContext.broadcast(held))
    return sent


def items_of(sent, radius: int) -> Items:
    """The block's tables, made once per Python worker."""
    rows = sent.value
    key = hash((tuple(rows), radius))
    if key not in _ITEMS:
        _ITEMS.clear()
        _ITEMS[key] = Items(rows, radius)
    return _ITEMS[key]


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 20,
                 block_items: int = 10_000, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item found in it, with the best window; no shuffle of texts."""
    texts, found = id_and_text(docs, id_col, text_col), None
    for sent in item_blocks(benchmark, block_items, item_id_col, item_text_col):
        here = texts.mapInArrow(search(sent, similarity, radius), SCHEMA)
        found = here if found is None else found.unionAll(here)
    return found


def search(sent, similarity: float, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = items_of(sent, radius)
        for batch in slices(batches):
            found = [(doc_id, *m) for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                     for m in matches(text, items, similarity)]
            if found:
                doc, item, first, n, score, far = zip(*found)
                long = pa.int64()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, long), pa.array(item, long), pa.array(first, long), pa.array(n, long),
                     pa.array(score, pa.float64()), pa.array(far, pa.int32())],
                    names=["doc_id", "item_id", "first_word", "n_words", "similarity", "distance"])

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 20,
                    block_items: int = 10_000, text_col: str = "text", item_id_col: str = "item_id",
                    item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns; no shuffle."""
    def without(sent):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = items_of(sent, radius)
            for batch in slices(batches):
                clean = [not matches(t, items, similarity) for t in batch.column(text_col).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return keep

    for sent in item_blocks(benchmark, block_items, item_id_col, item_text_col):
        docs = docs.mapInArrow(without(sent), docs.schema)
    return docs
