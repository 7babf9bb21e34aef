r"""Fuzzy line de-duplication by MinHash.

Lines are the parts of a text between line ends that hold a word; they are
compared trimmed and in lower case.  Equal lines are one candidate.  The set of
a line are its distinct five-character shingles; lines are linked where the
Jaccard similarity of these full sets is at least ``percent`` / 100, and one line
per connected component stays: the first by (doc_id, line number).

1. Distinct lines get dense numbers; their copies find them by 128 bits of hash.
2. Every shingle of a line has a hash, and ``BANDS * ROWS`` multipliers order
   these hashes; a line's signature are its minima, ``ROWS`` of them a band key.
   At similarity 0.8 a pair shares none of the bands with a chance of
   (1 - 0.8 ** 5) ** 12, below 1 in 100; at 0.3 it shares one with 3 in 100.
3. In a bucket of at most ``SMALL`` members every two are a candidate, so a member
   has a bounded number of them.  In a larger one every member is compared with its
   centre; one whose members are then all in one component is done.  Else those
   outside of the centre's component are held against all members, tile by tile of
   ``TILE`` members each: a tile gives the links that join components, not its pairs.
4. Four low bits of every minimum estimate a candidate's similarity by bit counts;
   only one that is ``MARGIN`` or more below the threshold is left out (more than
   four standard deviations).  Then full sets are compared.

Splitting, grouping, joining and choosing are DataFrame functions.  Signatures and
set comparisons run in Arrow batches: in SQL functions the shingles alone, without
anything done with them, took most of the time that the whole query may take (the
README has the figures).

Defined cases: lines without a word stay and are in no component; a null or
empty text has no lines; a null doc_id comes before all others; rows that repeat
an id and text have the same lines kept and dropped; lines shorter than five
characters have themselves as the only shingle; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow.llm.components import connected
from reelflow.llm.shared import discard, id_and_text, slices, written

WIDTH = 5
BANDS, ROWS = 12, 5
SMALL = 64                                              # members of a bucket that are compared two by two
MARGIN = 0.25
TILE = 1024                                             # members of a crowded bucket on either side of a tile
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: One odd multiplier per minimum.
TURNS = (np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * GOLDEN >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
MEASURE = "id bigint, centre bigint, n bigint, n_centre bigint, common bigint"
LINK = "a bigint, b bigint"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all shingles, line by line, and each line's first place among them (one place at least)."""
    sizes = np.array([max(len(t), WIDTH) for t in lines], np.int64)
    points = np.frombuffer("".join(t if len(t) >= WIDTH else t.ljust(WIDTH, "\x00") for t in lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    h = np.zeros(max(0, len(points) - WIDTH + 1), np.uint64)
    for k in range(WIDTH):
        h = mixed(h * GOLDEN + points[k:k + len(h)] + np.uint64(1))
    inside = np.ones(len(h), bool)
    for k in range(1, WIDTH):                              # places whose shingle would reach into the next line
        over = ends[:-1] - k
        inside[over] = False
    counts = sizes - (WIDTH - 1)
    return h[inside], np.concatenate([[0], np.cumsum(counts)])


def hashed(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text.cast("binary")))


def comparable(line: Column) -> Column:
    return F.lower(F.trim(line))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, of (128 bits of the document's text), line_no, line, line_key (128 bits) of the lines that hold a word."""
    lines = docs.where("text is not null").select("doc_id", hashed(F.col("text")).alias("of"),
                                                  F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return (lines.where(F.col("line").rlike(r"[^\x20\t\n\x0b\f\r]"))
            .withColumn("line", comparable(F.col("line"))).withColumn("line_key", hashed(F.col("line"))))


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, band_keys and low (four bits of each minimum, 16 to a number) of lines, from all their shingles."""
    for batch in slices(batches):
        m = batch.num_rows
        hashes, starts = shingle_hashes(batch.column("line").to_pylist())
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        keys, low = np.zeros((BANDS, m), np.uint64), np.zeros((-(-len(TURNS) // 16), m), np.uint64)
        for k, turn in enumerate(TURNS):
            smallest = np.minimum.reduceat(short * turn, starts[:-1]).astype(np.uint64)
            keys[k // ROWS] = mixed(keys[k // ROWS] * GOLDEN + smallest + np.uint64(1 + k // ROWS))
            low[k // 16] |= (mixed(smallest * GOLDEN) & np.uint64(15)) << np.uint64(4 * (k % 16))
        yield pa.RecordBatch.from_arrays([batch.column("id"), rows_as_lists(keys), rows_as_lists(low)], names=["id", "band_keys", "low"])


def rows_as_lists(columns: np.ndarray) -> pa.ListArray:
    """Array (n, m) of unsigned numbers as m lists of n bigints."""
    n, m = columns.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * n, pa.int32()), pa.array(np.ascontiguousarray(columns.T).view(np.int64).ravel()))


def estimate(x: str, y: str) -> Column:
    """Similarity from the minima whose four bits agree, less the agreement by chance."""
    unlike = F.lit(0)
    for k in range(-(-len(TURNS) // 16)):
        bits = F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 1))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 2)).bitwiseAND(F.lit(0x1111111111111111))
        unlike = unlike + F.bit_count(bits)
    return (1 - unlike / F.lit(len(TURNS)) - 1 / 16) / (1 - 1 / 16)


def comparisons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets of pairs of lines: their sizes and what they share.

    One number holds a pair's place in the batch (8 bits), an element (55 bits of its hash) and its side (1 bit), so
    that a plain sort brings equal elements of a pair together, x's before y's.
    """
    for batch in slices(batches, 256):
        m = batch.num_rows
        hashes, starts = shingle_hashes([*batch.column("x").to_pylist(), *batch.column("y").to_pylist()])
        at = np.arange(2 * m, dtype=np.uint64)
        tag = (at % np.uint64(m) << np.uint64(56)) | (at // np.uint64(m))
        keys = np.sort((hashes >> np.uint64(9) << np.uint64(1)) | np.repeat(tag, np.diff(starts)))
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        pair, side = (keys >> np.uint64(56)).astype(np.int64), (keys & np.uint64(1)).astype(bool)
        both = np.zeros(len(keys), bool)
        both[:-1] = ~side[:-1] & (keys[1:] == keys[:-1] + np.uint64(1))
        n, n_centre, common = (np.bincount(pair[f], minlength=m) for f in (~side, side, both))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("centre"), pa.array(n), pa.array(n_centre), pa.array(common)],
                                         names=["id", "centre", "n", "n_centre", "common"])


class Members:
    """One side of a tile: ids, components, low bits, and sets that are made when they are asked for."""

    def __init__(self, table: pa.Table):
        table = table.rename_columns([c.rstrip("_") for c in table.column_names])
        self.ids, self.parts = table.column("id").to_pylist(), table.column("part").to_pylist()
        self.low = np.array(table.column("low").to_pylist(), np.int64).reshape(len(self.ids), -(-len(TURNS) // 16)).view(np.uint64)
        self.lines, self.sets = table.column("line").to_pylist(), {}

    def set_of(self, k: int) -> np.ndarray:
        if k not in self.sets:
            self.sets[k] = np.unique(shingle_hashes([self.lines[k]])[0])
        return self.sets[k]


def tile(percent: int):
    """Links between outer members and all members of a tile, as many as join up their components."""
    def unlike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        found = np.zeros((len(x), len(y)), np.int64)
        for k in range(x.shape[1]):
            bits = x[:, k, None] ^ y[None, :, k]
            bits |= bits >> np.uint64(1)
            bits |= bits >> np.uint64(2)
            found += np.bitwise_count(bits & np.uint64(0x1111111111111111))
        return found

    def run(outer: pa.Table, every: pa.Table) -> pa.Table:
        x, y = Members(outer), Members(every)
        up = {p: p for p in (*x.parts, *y.parts)}

        def root(p):
            while up[p] != p:
                up[p] = up[up[p]]
                p = up[p]
            return p

        links = []
        if x.ids and y.ids:
            likely = (1 - unlike(x.low, y.low) / len(TURNS) - 1 / 16) / (1 - 1 / 16)
            likely[np.array(x.parts)[:, None] == np.array(y.parts)[None, :]] = -1
            rows, columns = np.nonzero(likely >= percent / 100 - MARGIN)
            for at in np.argsort(-likely[rows, columns], kind="stable").tolist():     # the likeliest first, then most need no look
                i, j = int(rows[at]), int(columns[at])
                a, b = root(x.parts[i]), root(y.parts[j])
                if a != b:
                    p, q = x.set_of(i), y.set_of(j)
                    both = len(np.intersect1d(p, q, assume_unique=True)) if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)) else 0
                    if 100 * both >= percent * (len(p) + len(q) - both):
                        links.append((x.ids[i], y.ids[j]))
                        up[max(a, b)] = min(a, b)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def crowd_links(crowds: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of crowded buckets, as far as ``links`` and their stars leave components apart.

    crowds: key, size, id, low, line.
    """
    parts = connected(links, "crowd-parts")
    centre = crowds.groupBy("key").agg(F.min("id").alias("centre"))
    members = (crowds.join(parts, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
               .join(centre, "key").join(parts.select(F.col("id").alias("centre"), F.col("component").alias("hub")), "centre", "left")
               .withColumn("outer", F.col("part") != F.coalesce("hub", "centre")))
    open_ = members.where("outer").select("key").distinct()
    members = members.join(open_, "key").withColumn("chunks", F.ceil(F.col("size") / TILE).cast("int"))
    chunk, every = F.expr("cast(pmod(xxhash64(id), chunks) AS int)"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    members = written(members, "crowd-members")
    held = ("key", "id", "part", "low", "line")
    left = members.where("outer").select(chunk.alias("i"), every.alias("j"), *held)
    right = members.select(every.alias("i_"), chunk.alias("j_"), *[F.col(c).alias(f"{c}_") for c in held])
    return left.groupBy("key", "i", "j").cogroup(right.groupBy("key_", "i_", "j_")).applyInArrow(tile(percent), LINK)


def line_components(docs: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """All lines (doc_id, of, line_no, line_key), and per line_key the first place of its component."""
    lines = lines_of(docs)
    # copies of a line meet as partial minima
    distinct = lines.groupBy("line_key").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.first("line").alias("line"))
    distinct = written(distinct.withColumn("id", F.monotonically_increasing_id()), "lines")
    signed = written(distinct.select("id", "line").mapInArrow(signatures, "id bigint, band_keys array<bigint>, low array<bigint>"), "line-signatures")

    def compare(pairs: DataFrame) -> DataFrame:
        return pairs.mapInArrow(comparisons, MEASURE)

    bands = signed.select("id", F.explode("band_keys").alias("key"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = written(bands.join(sizes, "key"), "line-buckets")
    few = buckets.where(F.col("size") <= SMALL).select("key", "id")
    # only members of buckets go on, each table with what the next step reads
    lows = written(signed.select("id", "low").join(buckets.select("id").distinct(), "id", "left_semi"), "line-lows")
    discard(signed)
    few, crowds = buckets.where(F.col("size") <= SMALL), buckets.where(F.col("size") > SMALL)
    pairs = few.alias("x").join(few.alias("y"), F.expr("x.key = y.key and x.id < y.id")).select(
        F.col("x.id").alias("id"), F.col("y.id").alias("centre"))
    stars = crowds.join(crowds.groupBy("key").agg(F.min("id").alias("centre")), "key").where("id <> centre").select("id", "centre")
    x, y = (lows.select(F.col("id").alias(name), F.col("low").alias(side)) for name, side in (("id", "x"), ("centre", "y")))
    pairs = (pairs.unionAll(stars).distinct().join(x, "id").join(y, "centre")
             .where(estimate("x", "y") >= percent / 100 - MARGIN).select("id", "centre"))
    pairs = written(pairs, "line-pairs")
    wanted = pairs.select("id").unionAll(pairs.select("centre")).unionAll(crowds.select("id")).distinct()
    texts = written(distinct.select("id", "line").join(wanted, "id", "left_semi"), "line-texts")
    x, y = (texts.select(F.col("id").alias(name), F.col("line").alias(side)) for name, side in (("id", "x"), ("centre", "y")))
    near = F.expr(f"100 * common >= {percent} * (n + n_centre - common)")
    links = written(compare(pairs.join(x, "id").join(y, "centre").select("id", "centre", "x", "y")).where(near)
                    .select(F.col("id").alias("a"), F.col("centre").alias("b")), "line-links")
    more = written(crowd_links(crowds.join(lows, "id").join(texts, "id"), links, percent), "line-crowds")
    discard(texts, pairs, buckets, lows)
    parts = connected(links.unionAll(more), "line-parts")
    named = distinct.select("line_key", "id", "first").join(parts, "id", "left").select(
        "line_key", "first", F.coalesce("component", "id").alias("component"))
    firsts = named.groupBy("component").agg(F.min("first").alias("keeper"))
    keepers = written(named.join(firsts, "component").select("line_key", "keeper"), "line-keepers")
    discard(distinct, links, more)
    return lines.select("doc_id", "of", "line_no", "line_key"), keepers


def label_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, of, line_no, keeper_doc_id, keeper_line_no, kept of every line that holds a word."""
    lines, keepers = line_components(id_and_text(docs, id_col, text_col), percent)
    return lines.join(keepers, "line_key").select(
        "doc_id", "of", "line_no", F.col("keeper.doc_id").alias("keeper_doc_id"), F.col("keeper.line_no").alias("keeper_line_no"),
        F.struct("doc_id", "line_no").eqNullSafe(F.col("keeper")).alias("kept"))


def without_repeats(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with only the kept lines in their texts; those that lose all their words leave.

    Other columns stay as they are, whatever their names.  A document without any word before stays.
    """
    labelled = written(label_lines(docs, percent, id_col, text_col), "line-labels")
    drops = (labelled.groupBy("doc_id", "of").agg(F.collect_set(F.when(~F.col("kept"), F.col("line_no"))).alias("drops"),
                                                  F.max("kept").alias("some")).where("size(drops) > 0"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))       # no name of theirs meets one of ours
    text = F.col("row").getField(text_col)
    parts = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("drops"))
    rest = F.array_join(F.transform(kept, lambda k: F.get(parts, k)), "\n")
    here = F.col("row").getField(id_col).cast("long").eqNullSafe(F.col("doc_id")) & (hashed(text.cast("string")) == F.col("of"))
    joined = (whole.join(drops, here, "left").where(F.coalesce("some", F.lit(True)))
              .select("row", F.when(F.col("drops").isNotNull(), rest).otherwise(text).alias("text")))
    return joined.select(*[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
