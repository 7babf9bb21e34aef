"""Near-duplicate documents by b-bit MinHash.

A document's set are its distinct two-word shingles (``width``) over words between white
space (20, 09-0D) with A-Z in lower case; with fewer words the whole sequence
is its one shingle.  Equal sets are one class, so copies never meet in pairs.
A class has ``BANDS * ROWS`` minima: each band of minima is a key of its
candidate buckets, and of each minimum only two bits are kept, 32 to a word.
Two signatures that agree in a share m of their cells have the estimate
(m - 1/4) / (1 - 1/4), corrected for cells that agree by chance.  ``components.link_components`` measures each member of a bucket against the
bucket's centre on their full sets, without the estimate, and, by bounds from
those measures, leaves few other pairs.  Only these are screened by the estimate:
one that is ``MARGIN`` or more below the threshold is dropped; the others are
confirmed on their full sets.

At similarity 0.8 a pair shares no band with a chance of (1 - 0.8 ** 6) ** 40,
about 5 in a million, and falls below the margin (4.9 deviations) with one in a
million.

Defined cases: a document without words or text has an empty set and is linked
with nothing; a null id is linked with nothing, has no component and is kept;
rows that repeat an id are one document with the links of all its texts, and
are kept or dropped alike; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow.llm.components import comparison, link_components
from reelflow.llm.shared import id_and_text, slices, written

BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
CELLS = 32                                               # two-bit cells in a word
WORDS = -(-HASHES // CELLS)
MARGIN = 0.15
CHUNK = 256                                              # shingles hashed at a time
GOLD = np.uint64(0x9E3779B97F4A7C15)

_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
FEATURES = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature array<bigint>, band_keys array<bigint>"


class WordNumbers(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = n = xxhash.xxh64_intdigest(word)
        return n


_NUMBERS = WordNumbers()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * GOLD
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, width: int = 2) -> np.ndarray:
    """Sorted 64-bit numbers of the distinct shingles; empty without words."""
    words = text.encode().lower().split() if text else []   # bytes: only A-Z change, only 20 and 09-0D part words
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_NUMBERS.__getitem__, words), np.uint64, len(words))
    width = min(width, len(ids))
    mix = np.full(len(ids) - width + 1, width, np.uint64)
    for k in range(width):
        mix = mixed(mix ^ ids[k:k + len(mix)])
    return np.unique(mix)


def minima(numbers: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(numbers), CHUNK):
        part = (numbers[at:at + CHUNK, None] ^ SHIFTS[None, :]) * FACTORS[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    return least


def signature(least: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, packed 32 to a 64-bit word."""
    cells = np.zeros(WORDS * CELLS, np.uint64)
    cells[:HASHES] = mixed(least) & np.uint64(3)
    return np.bitwise_or.reduce(cells.reshape(WORDS, CELLS) << (np.arange(CELLS, dtype=np.uint64) * np.uint64(2)), axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD
    for column in least.reshape(BANDS, ROWS).T:
        key = mixed(key ^ column)
    return key


def features(docs: DataFrame, width: int = 2) -> DataFrame:
    """Per row: size and name of its set, packed signature, band keys (no signature or keys for an empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, a, b, sig, keys = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                numbers = shingle_set(text, width)
                n.append(len(numbers))
                data = xxhash.xxh3_128_intdigest(numbers.tobytes())      # the class of equal sets
                a.append((data >> 64) - (1 << 63))
                b.append((data & (1 << 64) - 1) - (1 << 63))
                if len(numbers):
                    least = minima(numbers)
                    sig.append(signature(least).view(np.int64))
                    keys.append(band_keys(least).view(np.int64))
                else:
                    sig.append(None)
                    keys.append(None)
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, long), pa.array(a, long), pa.array(b, long),
                 pa.array(sig, pa.list_(long)), pa.array(keys, pa.list_(long))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "signature", "band_keys"])

    return docs.mapInArrow(run, FEATURES)


def full_sets(docs: DataFrame, width: int = 2) -> DataFrame:
    """id and its shingle numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, width).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "numbers"])

    return docs.mapInArrow(run, "id bigint, numbers array<bigint>")


def estimate(x: str, y: str) -> Column:
    """Collision-corrected similarity of two packed signatures, by bit counts."""
    differ = " + ".join(
        f"bit_count(({d} | shiftrightunsigned({d}, 1)) & {0x5555555555555555}L)"
        for d in (f"({x}.signature[{k}] ^ {y}.signature[{k}])" for k in range(WORDS)))
    return F.expr(f"(({HASHES} - ({differ})) / {HASHES}D - 0.25D) / 0.75D")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; linked where 100 * both >= percent * either."""
    texts = id_and_text(docs, id_col, text_col)
    rows = written(features(texts, width), "minhash-features")
    classes = written(rows.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b")
                      .agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"),
                           F.first("band_keys").alias("band_keys")), "minhash-classes")
    signatures = classes.select("id", "signature", "band_keys")
    keys = signatures.select("id", F.explode("band_keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    ids = keys.join(shared.select("key"), "key").select("id").distinct()
    wanted = texts.join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    sets = written(full_sets(wanted, width).distinct(), "minhash-sets")
    least = percent / 100 - MARGIN

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs whose b-bit estimate is not clearly below the threshold."""
        a = signatures.select(F.col("id").alias("a"), F.struct("signature").alias("x"))
        b = signatures.select(F.col("id").alias("b"), F.struct("signature").alias("y"))
        return pairs.join(a, "a").join(b, "b").where(estimate("x", "y") >= least).select("a", "b").distinct()

    parts = link_components(signatures, sets.withColumnRenamed("numbers", "content"), comparison(lambda c: c), percent, "minhash", close)
    # rows that repeat an id may be in several classes: the id's own component joins them
    named = (classes.select("set_a", "set_b", "id").join(parts, "id", "left")
             .select("set_a", "set_b", F.coalesce("component", "id").alias("component")))
    return (rows.join(named, ["set_a", "set_b"], "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id"))).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))))
