"""Transcript timelines (SRC-7, TIM-3, AGG-1, WIN-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow.functions import clock
from reelflow.functions.text import WS_CLASS
from reelflow.operators.ordered import ordered_concat


def explode_segments(docs: DataFrame, key: str = "video_id", words: bool = False) -> DataFrame:
    """SRC-7: one row per segment of a transcript document, list order kept as ``pos``; ``words`` keeps word timing.

    ``docs`` has ``key``, ``language`` and ``segments ARRAY<STRUCT<start,end,text,...>>``.
    Missing ``segments`` counts as an empty list.
    """
    return (docs.select(key, F.posexplode(F.coalesce("segments", F.array())).alias("pos", "seg"))
                .select(key, F.col("pos").cast("int").alias("pos"),
                        F.col("seg.start").alias("start_s"), F.col("seg.end").alias("end_s"),
                        F.col("seg.text").alias("text"),
                        *([F.col("seg.words").alias("words")] if words else [])))


def with_lines(segs: DataFrame) -> DataFrame:
    """TIM-3 per segment: ``[start - end] text`` with ``.get`` defaults."""
    return segs.withColumn("line", clock.timeline_line("start_s", "end_s", "text"))


def timeline_text(segs: DataFrame) -> DataFrame:
    """AGG-1: ``(video_id, num_segments, transcript)`` — lines in list order joined by ``\\n``."""
    return ordered_concat(with_lines(segs), ["video_id"], "pos", "line", "\n", "transcript",
                          count_as="num_segments")


CHUNK = 128               # words whose running lengths are built at a time


def _running(lengths: str, out: str, words: DataFrame) -> DataFrame:
    """Running sums of an array of whole numbers: inside chunks, over the chunks, then both together.

    A growing array is copied at every step, so it only ever grows over a chunk, or over one number a chunk.
    """
    def ends(parts: Column, value) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.array().cast("array<bigint>").alias("ends"))
        return F.aggregate(parts, start, lambda acc, x: F.struct(
            (acc["upto"] + value(x)).alias("upto"), F.concat(acc["ends"], F.array(acc["upto"] + value(x))).alias("ends")),
            lambda acc: acc["ends"])

    starts = F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(CHUNK))
    d = words.withColumn("_chunks", F.transform(starts, lambda at: ends(F.slice(lengths, at, CHUNK), lambda x: x)))
    d = d.withColumn("_totals", ends(F.col("_chunks"), lambda c: F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(0))))
    before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice("_totals", 1, F.size("_totals") - 1))
    return d.withColumn(out, F.flatten(F.zip_with("_chunks", before, lambda c, o: F.transform(c, lambda x: x + o)))).drop("_chunks", "_totals")


def word_timeline(segs: DataFrame) -> DataFrame:
    """WIN-7 (rule-based stand-in for neural alignment).

    Words are the tokens of a segment between white space (the characters of
    STR-1); the segment's time is shared in proportion to character counts.
    Running lengths are built inside the row's own array, chunk by chunk, so
    nothing is shuffled and the work is in proportion to the words.
    """
    tokens = F.filter(F.split("text", f"{WS_CLASS}+"), lambda w: F.length(w) > 0)
    words = (segs.select("video_id", "pos", "start_s", "end_s", tokens.alias("_w"))
                 .withColumn("_n", F.transform("_w", lambda w: F.length(w).cast("bigint"))))
    words = (_running("_n", "_e", words)
             .select("video_id", "pos", "start_s", "end_s", F.try_element_at("_e", F.lit(-1)).alias("_total"),
                     F.posexplode(F.arrays_zip("_w", "_e")).alias("word_pos", "_x")))
    dur = F.col("end_s") - F.col("start_s")
    upto, size = F.col("_x._e"), F.length("_x._w")
    return words.select(
        "video_id", "pos", F.col("word_pos").cast("int").alias("word_pos"), F.col("_x._w").alias("word"),
        (F.col("start_s") + dur * (upto - size) / F.col("_total")).alias("word_start"),
        (F.col("start_s") + dur * upto / F.col("_total")).alias("word_end"),
    )
