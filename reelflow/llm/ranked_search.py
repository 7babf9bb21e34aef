"""Ranked lexical search: accumulator-limited term-at-a-time evaluation over document shards.

1. Items (the query set) are taken in blocks of about ``block_terms`` distinct
   terms; only a block's terms are sent to the tasks.
2. One pass over the whole texts writes each document's length and its counts
   of the block's terms.  Numbers of documents, terms and documents per term
   come from that table, over all documents.
3. A second pass inverts the table shard by shard (``shard_docs`` documents) and
   evaluates every item term-at-a-time, rarest term first.  A new accumulator
   is made only while the bounds of the terms left (the greatest impact of each
   in the shard) reach the kth partial score; from then on the survivors alone
   are updated, exactly, by looking them up in the postings.
4. A task merges its shards' lists, and the tasks' lists are merged as a tree.

A document outside of its shard's best ``k`` is not among the best ``k`` of all,
so the result is whole.  Bounds that equal the kth score still make
accumulators, because an equal score may win by its smaller id.

Scores: term weight w = floor(1000 ln((2N+2)/(2df+1))), document norm
m = 75 + (25 n N) div L, sum over the item's terms, repeats included, of
w * ((10^9 tf) div (1000 tf + 12 m)).

Defined cases: null and empty texts hold no term and are no documents to N and
L; a document with a null id counts in N, L and df but is not ranked; rows that
repeat a doc_id are documents of their own; an item with a null id or without
terms has no rows; an item id with several texts asks with the smallest; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.llm.shared import ceil_div, slices, written
from reelflow.llm.toplists import LIST, as_lists, best, merged, ranked
from reelflow.session import ship_package

#: Bytes of a term stay (letters in lower case, digits, all bytes beyond ASCII), others become spaces.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LONG = pa.int64()


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(TERM_BYTES).split() if text else []


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        bags = [Counter(terms(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id"), pa.array([list(b) for b in bags], pa.list_(pa.binary())),
             pa.array([list(b.values()) for b in bags], pa.list_(LONG))], names=["item_id", "terms", "counts"])


def postings(sent):
    """Documents that hold a term: id, number of terms, and the block's terms in them with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in slices(batches):
            ids, sizes, found, counts = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = terms(text)
                if words:
                    bag = Counter(map(number, words))
                    bag.pop(None, None)
                    ids.append(doc_id)
                    sizes.append(len(words))
                    found.append(list(bag))
                    counts.append(list(bag.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, LONG), pa.array(sizes, LONG), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(LONG))],
                names=["doc_id", "n", "terms", "counts"])

    return run


def documents_per_term(n_terms: int):
    """A task's documents per term: one row for each of the block's terms that it met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], LONG)], names=["term", "df"])

    return run


class Shard:
    """Postings of a few thousand documents, by term, with the impact of each."""

    def __init__(self, tables: list[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_terms: int):
        table = pa.Table.from_batches(tables).combine_chunks()
        self.ids = table.column("doc_id").to_numpy()
        sizes = table.column("n").to_numpy()
        lists = table.column("terms").chunk(0)
        found, counts = lists.flatten().to_numpy(), table.column("counts").chunk(0).flatten().to_numpy()
        doc = np.repeat(np.arange(len(self.ids)), np.diff(lists.offsets.to_numpy()))
        if 25 * int(sizes.max()) * n_docs < 2 ** 63:
            norms = 75 + 25 * sizes * n_docs // n_terms
        else:
            norms = np.array([75 + 25 * n * n_docs // n_terms for n in sizes.tolist()], np.int64)
        order = np.argsort(found, kind="stable")
        found, doc, counts = found[order], doc[order], counts[order]
        self.doc, self.impact = doc, weights[found] * (10 ** 9 * counts // (1000 * counts + 12 * norms[doc]))
        self.present, self.starts = np.unique(found, return_index=True)
        self.stops = np.append(self.starts[1:], len(found))
        self.bounds = np.maximum.reduceat(self.impact, self.starts) if len(found) else self.impact

    def search(self, item: np.ndarray, repeats: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of at least the best ``k``; ``item`` rarest first, ``least`` the kth score known so far."""
        at = np.searchsorted(self.present, item)
        at[at == len(self.present)] = 0
        here = self.present[at] == item if len(self.present) else np.zeros(len(item), bool)
        at, repeats = at[here], repeats[here]
        bounds = self.bounds[at] * repeats
        left = int(bounds.sum())
        scores, peak, open_, survivors = np.zeros(len(self.ids), np.int64), 0, True, None
        for term, times, bound in zip(at.tolist(), repeats.tolist(), bounds.tolist()):
            docs, impact = self.doc[self.starts[term]:self.stops[term]], self.impact[self.starts[term]:self.stops[term]]
            if open_ and left < max(peak, least):
                kth = int(np.partition(scores, len(scores) - k)[-k]) if len(scores) >= k else 0
                if left < max(kth, least):
                    open_, survivors = False, np.flatnonzero(scores)
            if open_:
                scores[docs] += times * impact
                peak = max(peak, int(scores[docs].max()))
            elif len(survivors) < len(docs):
                place = np.searchsorted(docs, survivors)
                place[place == len(docs)] = 0
                hit = docs[place] == survivors
                scores[survivors[hit]] += times * impact[place[hit]]
            else:
                hit = scores[docs] > 0
                scores[docs[hit]] += times * impact[hit]
            left -= bound
        held = np.flatnonzero(scores)
        if len(held) > k:
            held = held[scores[held] >= np.partition(scores[held], len(held) - k)[-k]]
        return scores[held], self.ids[held]


def search(sent, k: int, shard_docs: int):
    """Lists of the best ``k`` of a task's documents for every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_terms = sent.value
        keys, scores, ids = (np.zeros(0, np.int64) for _ in range(3))
        least = np.zeros(len(items), np.int64)
        waiting, rows, size = [], 0, 0

        def evaluate():
            nonlocal keys, scores, ids
            shard = Shard(waiting, weights, n_docs, n_terms)
            found = [(keys, scores, ids)]
            for n, (_, item, repeats) in enumerate(items):
                s, i = shard.search(item, repeats, k, int(least[n]))
                found.append((np.full(len(s), n), s, i))
            keys, scores, ids = best(*map(np.concatenate, zip(*found)), k)
            full = np.bincount(keys, minlength=len(items)) == k
            last = np.searchsorted(keys, np.flatnonzero(full), "right") - 1
            least[full] = scores[last]

        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            for piece in slices([batch], 1024):
                waiting.append(piece)
                rows, size = rows + piece.num_rows, size + len(piece.column("terms").flatten())
                if rows >= shard_docs or size >= 64 * shard_docs:
                    evaluate()
                    waiting, rows, size = [], 0, 0
        if rows:
            evaluate()
        place, top = as_lists(keys, scores, ids)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([items[p][0] for p in place.tolist()], LONG), pa.array([part] * len(place), LONG), top], names=["item_id", "part", "top"])

    return run


def item_blocks(items: DataFrame, block_terms: int, id_col: str, text_col: str) -> Iterator[list[tuple[int, dict[bytes, int]]]]:
    """The items with their terms and counts, about ``block_terms`` distinct terms of items at a time."""
    bags = written(items.where(F.col(id_col).isNotNull())
                   .groupBy(F.col(id_col).cast("long").alias("item_id")).agg(F.min(F.col(text_col).cast("string")).alias("text"))
                   .withColumn("text", F.col("text").cast("binary"))
                   .mapInArrow(item_terms, "item_id bigint, terms array<binary>, counts array<bigint>").where("size(terms) > 0"), "items")
    n_blocks = ceil_div(bags.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0], block_terms)
    for block in range(n_blocks):
        rows = bags.where(F.expr(f"pmod(xxhash64(item_id), {n_blocks}) = {block}")).collect()
        yield sorted((r.item_id, {bytes(t): c for t, c in zip(r.terms, r.counts)}) for r in rows)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = 500_000, shard_docs: int = 16_384,
                   id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                   item_text_col: str = "text") -> DataFrame:
    """The ``k`` documents of highest score above 0 for each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    result = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in item_blocks(items, block_terms, item_id_col, item_text_col):
        numbers = {t: n for n, t in enumerate(sorted({t for _, bag in block for t in bag}))}
        table = written(texts.mapInArrow(postings(spark.sparkContext.broadcast(numbers)),
                                         "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"), "postings")
        n_docs, n_terms = table.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        df = np.zeros(len(numbers), np.int64)
        for row in (table.select("terms").mapInArrow(documents_per_term(len(numbers)), "term int, df bigint")
                    .groupBy("term").agg(F.sum("df").alias("df")).collect()):     # at most a row for each term of the block
            df[row.term] = row.df
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        asked = []
        for item_id, bag in block:
            rarest = sorted((numbers[t] for t in bag), key=lambda n: (df[n], n))
            names = {numbers[t]: c for t, c in bag.items()}
            asked.append((item_id, np.array(rarest), np.array([names[n] for n in rarest], np.int64)))
        sent = spark.sparkContext.broadcast((asked, weights, n_docs, n_terms))
        lists = table.mapInArrow(search(sent, k, shard_docs), f"item_id bigint, part bigint, top {LIST}")
        result = result.unionAll(ranked(merged(lists, "item_id", table.rdd.getNumPartitions(), k), "item_id", "doc_id"))
    return result
