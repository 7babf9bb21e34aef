"""Cross-entropy difference: how much better a target model predicts a text than a background model.

Both models are class-based bigram models of the same form over one vocabulary,
all words of the corpus.  A word that makes up at least one in ``share`` of all
tokens is a class of its own, and so is the mark before the first and after the
last word; all other words share one class, within which each has its own
probability.  The target model counts the documents whose label says good quality
and not toxic, the background model counts all documents, matched to the target's
number of tokens.  For each model, with classes u of w and t of v,

    p(u)     = (c(u) + 1) / (n + classes)
    p(u | t) = (c(t, u) + ``back_off`` * p(u)) / (c(t) + back_off)
    p(w | v) = p(u | t), times (c(w) + 1) / (c(u) + words of u) in the shared class

with background counts c scaled by (target tokens / background tokens).  A
document's score is the mean over its tokens, the end mark included, of target
loss minus background loss in nats; lower is more like the target.

All documents are counted and scored, whole, and every word moves the scores.  At
most ``share`` words can have a class of their own, whatever the corpus, so the
table of class pairs that tasks read has a proven bound: one dense file of losses
in the shared folder, which each Python worker holds in memory.  The counts of
all other words grow with the corpus and stay a Spark table: a document's
distinct ones are joined to their losses.  Texts become numbers once, in a table
that all steps read.

Defined cases: a null or empty text has one token, the end mark; a null doc_id
keeps its row, and its text counts as background; rows that repeat an id are
counted and scored each; without any target document the target has no counts
and the score shows the background's losses alone; an empty table gives no rows;
further columns are not read.  Words of the shared class are known by 64 bits of
their hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.llm.shared import filesystem, id_and_text, publish, shared_folder, slices, written

NUMBER = np.dtype("<u4")          # a class's number in the tables

NUMBERED = "doc_id bigint, target boolean, ids binary, others array<bigint>, times array<int>"
SCORED = "row bigint, doc_id bigint, n_tokens bigint, ours double, theirs double"


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words between white space (20, 09-0D)."""
    return text.lower().encode().split() if text else []


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all documents; each task sends a row per distinct word it has seen since its last emptying."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                seen.update(words_of(text))
            if len(seen) > 1_000_000:                    # partial counts: emptied when many, summed later
                yield rows(seen)
                seen.clear()
        yield rows(seen)

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()),
                                           pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return docs.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Numbers(dict):
    """Word -> the number of its class; 0 is the shared class, 1 the mark."""

    def __missing__(self, word: bytes) -> int:
        return 0


def class_numbers(words: list[bytes], numbers: Numbers) -> np.ndarray:
    """Classes of the words, the mark before the first and after the last."""
    ids = np.empty(len(words) + 2, NUMBER)
    ids[0] = ids[-1] = 1
    ids[1:-1] = np.fromiter(map(numbers.__getitem__, words), NUMBER, len(words))
    return ids


def signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def number_texts(flagged: DataFrame, numbers) -> DataFrame:
    """The packed classes of a document's tokens, and its distinct words of the shared class with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Numbers(numbers.value)
        for batch in slices(batches):
            ids, others, times = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                ids.append(class_numbers(words, known).tobytes())
                rest = {w: n for w, n in Counter(words).items() if w not in known}
                others.append([signed(xxhash.xxh64_intdigest(w)) for w in rest])
                times.append(list(rest.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("target"), pa.array(ids, pa.binary()),
                 pa.array(others, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))],
                names=["doc_id", "target", "ids", "others", "times"])

    return flagged.mapInArrow(run, NUMBERED)


def count_others(numbered: DataFrame) -> DataFrame:
    """word (its hash), n_target, n_all of the words of the shared class."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in slices(batches):
            flags = np.repeat(batch.column("target").to_numpy(zero_copy_only=False), batch.column("others").value_lengths().to_numpy())
            waiting.append((batch.column("others").flatten().to_numpy(), batch.column("times").flatten().to_numpy(), flags))
            held += len(flags)
            if held > 2_000_000:                         # partial counts, summed later
                yield rows(waiting)
                waiting, held = [], 0
        if held:
            yield rows(waiting)

    def rows(waiting: list[tuple]) -> pa.RecordBatch:
        words, times, flags = map(np.concatenate, zip(*waiting))
        word, at = np.unique(words, return_inverse=True)
        n_all, n_target = (np.bincount(at, weights=w, minlength=len(word)).astype(np.int64) for w in (times, times * flags))
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(n_target), pa.array(n_all)], names=["word", "n_target", "n_all"])

    return (numbered.select("target", "others", "times").mapInArrow(count, "word bigint, n_target bigint, n_all bigint")
            .groupBy("word").agg(F.sum("n_target").alias("n_target"), F.sum("n_all").alias("n_all")))


def losses_within(numbered: DataFrame, scale: float) -> DataFrame:
    """row, ours, theirs: the sums of -log p(w | shared class) over a document's words of that class."""
    counts = written(count_others(numbered), "lm-words")
    n_words, n_target, n_all = counts.agg(F.count("*"), F.coalesce(F.sum("n_target"), F.lit(0)), F.coalesce(F.sum("n_all"), F.lit(0))).first()
    losses = counts.select("word", (-F.log((F.col("n_target") + 1) / F.lit(float(n_target + n_words)))).alias("ours"),
                           (-F.log((F.col("n_all") * scale + 1) / F.lit(float(n_all * scale + n_words)))).alias("theirs"))
    held = numbered.select("row", F.inline(F.arrays_zip("others", "times"))).withColumnsRenamed({"others": "word"})
    return (held.join(losses, "word").groupBy("row")
            .agg(F.sum(F.col("times") * F.col("ours")).alias("ours"), F.sum(F.col("times") * F.col("theirs")).alias("theirs")))


def pairs_of(ids: bytes, size: int) -> np.ndarray:
    """Neighbouring tokens as first * size + second."""
    chain = np.frombuffer(ids, NUMBER).astype(np.int64)
    return chain[:-1] * size + chain[1:]


def count_pairs(numbered: DataFrame, size: int) -> DataFrame:
    """pair, n_target, n_all over numbered texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[bool, list[np.ndarray]] = {True: [], False: []}
        held = 0
        for batch in slices(batches):
            for ids, target in zip(batch.column("ids").to_pylist(), batch.column("target").to_pylist()):
                waiting[target].append(pairs_of(ids, size))
                held += len(waiting[target][-1])
            if held > 4_000_000:                         # partial counts again
                yield from rows(waiting)
                waiting, held = {True: [], False: []}, 0
        yield from rows(waiting)

    def rows(waiting: dict[bool, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for target, pairs in waiting.items():
            if pairs:
                pair, n = np.unique(np.concatenate(pairs), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair), pa.array(n if target else 0 * n), pa.array(n)], names=["pair", "n_target", "n_all"])

    return (numbered.select("ids", "target").mapInArrow(count, "pair bigint, n_target bigint, n_all bigint")
            .groupBy("pair").agg(F.sum("n_target").alias("n_target"), F.sum("n_all").alias("n_all")))


def losses(counts: np.ndarray, scale: float, back_off: float) -> np.ndarray:
    """-log p(w | v) for a square table of pair counts."""
    counts = counts * scale
    words = counts.sum(axis=0)
    alone = (words + 1) / (words.sum() + len(words))
    after = counts.sum(axis=1)
    return -np.log((counts + back_off * alone[None, :]) / (after + back_off)[:, None])


def own_classes(texts: DataFrame, share: int) -> dict[bytes, int]:
    """Numbers, from 2 on, of the words that make up at least one in ``share`` of all tokens: at most ``share`` words."""
    counts = written(count_words(texts), "lm-vocabulary")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.where(F.col("n") * share >= total).collect()
    return {r.word.encode(): k + 2 for k, r in enumerate(sorted(often, key=lambda r: (-r.n, r.word)))}


def fit(numbered: DataFrame, size: int, back_off: float) -> tuple[str, float]:
    """URL of the two loss tables of class pairs, float64, target then background; and the background's scale."""
    target, every = np.zeros(size * size), np.zeros(size * size)
    for batch in count_pairs(numbered, size).toArrow().to_batches():                    # at most size ** 2 rows
        at = batch.column("pair").to_numpy()
        target[at], every[at] = batch.column("n_target").to_numpy(), batch.column("n_all").to_numpy()
    scale = float(target.sum() / every.sum()) if target.sum() else 1.0
    tables = [losses(c.reshape(size, size), s, back_off).astype("<f8") for c, s in ((target, 1.0), (every, scale))]
    folder = shared_folder(numbered.sparkSession, "lm")
    name = publish(folder, "losses", lambda out: [out.write(t.tobytes()) for t in tables])
    return f"{folder}/{name}", scale


_TABLES: dict[str, np.ndarray] = {}


def loss_tables(url: str, size: int) -> np.ndarray:
    if url not in _TABLES:
        fs, path = filesystem(url)
        _TABLES.clear()
        with fs.open_input_file(path) as source:
            _TABLES[url] = np.frombuffer(source.read(), "<f8").reshape(2, size * size)
    return _TABLES[url]


def score(docs: DataFrame, labels: DataFrame, share: int = 4000, back_off: float = 2.0,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score (means per token) of every document."""
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col)
    target = (labels.select(F.col("doc_id").cast("long").alias("target_id"), "quality", "toxic")
              .groupBy("target_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
              .where("quality = 1 and coalesce(toxic, 0) = 0 and target_id is not null").select("target_id"))
    numbers = own_classes(texts, share)
    size = len(numbers) + 2
    # the same join at every size: targets are a share of the documents, so they are no side to broadcast
    flagged = texts.join(target.hint("merge"), F.col("doc_id") == F.col("target_id"), "left").select(
        "doc_id", "text", F.col("target_id").isNotNull().alias("target"))
    numbered = number_texts(flagged, spark.sparkContext.broadcast(numbers)).withColumn("row", F.monotonically_increasing_id())
    numbered = written(numbered, "lm-numbers")
    url, scale = fit(numbered, size, back_off)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = loss_tables(url, size)
        for batch in slices(batches):
            n, ours, theirs = [], [], []
            for ids in batch.column("ids").to_pylist():
                pair = pairs_of(ids, size)
                n.append(len(pair))
                ours.append(float(tables[0][pair].sum()))
                theirs.append(float(tables[1][pair].sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ours, pa.float64()),
                 pa.array(theirs, pa.float64())], names=["row", "doc_id", "n_tokens", "ours", "theirs"])

    between = numbered.select("row", "doc_id", "ids").mapInArrow(run, SCORED)
    within = losses_within(numbered, scale).select("row", F.col("ours").alias("more"), F.col("theirs").alias("more_theirs"))
    mean = [((F.col(a) + F.coalesce(F.col(b), F.lit(0.0))) / F.col("n_tokens")).alias(name)
            for a, b, name in (("ours", "more", "target_loss"), ("theirs", "more_theirs", "background_loss"))]
    return (between.join(within, "row", "left").select("doc_id", "n_tokens", *mean)
            .withColumn("score", F.col("target_loss") - F.col("background_loss")))
