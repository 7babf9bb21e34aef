"""Time-range and as-of joins inside a video (JOI-6, JOI-7, WIN-4).

Spark has no range or as-of join. The range join is an equi join on
``(video_id, level, time bucket)`` plus the range predicate: buckets of a level
are ``STEP`` times as wide as those of the level below, an interval belongs to
the first level whose buckets are as long as itself, and so touches two buckets
of it at most. A pair meets at the higher of its two levels, in the first bucket
that both touch there. So a long interval costs no more rows than a short one,
and only what lies in its own stretch of the video is compared with it. The
as-of join carries the last frame forward through time blocks. No window holds a
whole video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow.operators.blocked import TIME_BLOCK_S, carry_forward, join_on, next_in_order, time_block
from reelflow.operators.ordered import ordered_concat

STEP = 8                  # how much wider the buckets of the next level are
TOP = 9                   # the level without buckets: intervals over ``width * STEP ** (TOP - 1)`` (decades), or corrupt


def _level(start: Column, end: Column, width: float) -> Column:
    length = (end - start) / F.lit(width)
    level = F.ceil(F.log(length) / F.log(F.lit(float(STEP)))).cast("int")
    return F.when(length <= 1, 0).when(length > float(STEP) ** (TOP - 1), TOP).otherwise(level)


def _bucket(c: Column, level: Column, width: float) -> Column:
    return F.when(level == TOP, F.lit(0).cast("bigint")).otherwise(F.floor(c / (F.lit(width) * F.pow(F.lit(float(STEP)), level))))


def _placed(df: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """The intervals whose times are known, with their level ``_own``."""
    known = F.col(start).isNotNull() & F.col(end).isNotNull() & ~F.isnan(start) & ~F.isnan(end)
    return df.filter(known).withColumn("_own", _level(F.col(start), F.col(end), width))


def _at_levels(df: DataFrame, levels: Column, start: str, end: str, width: float) -> DataFrame:
    """A row per level of ``levels`` and bucket that the interval touches there (one where ``end < start``)."""
    first, last = (_bucket(F.col(c), F.col("_level"), width) for c in (start, end))
    return (df.withColumn("_level", F.explode(levels))
              .withColumn("_b", F.explode(F.sequence(first, F.greatest(first, last)))))


def _levels(placed: DataFrame) -> list[int]:
    """The levels that occur, ``TOP + 1`` at most."""
    return sorted(r[0] for r in placed.select("_own").distinct().collect())


def candidate_pairs(left: DataFrame, right: DataFrame, key: str, l_start: str, l_end: str, r_start: str, r_end: str,
                    width: float = TIME_BLOCK_S) -> DataFrame:
    """The pairs that :func:`overlap_pairs` compares: both touch a bucket of the level of the longer one. Each comes once."""
    lp, rp = _placed(left, l_start, l_end, width), _placed(right, r_start, r_end, width)
    l_levels, r_levels = _levels(lp), _levels(rp)

    def own(placed: DataFrame, start: str, end: str) -> DataFrame:
        return _at_levels(placed, F.array("_own"), start, end, width)

    def below(placed: DataFrame, start: str, end: str, others: list[int], strictly: bool) -> DataFrame:
        """At every level of the other side that is not below the interval's own."""
        listed = F.array(*map(F.lit, others)).cast("array<int>")
        higher = F.filter(listed, lambda n: n > F.col("_own") if strictly else n >= F.col("_own"))
        return _at_levels(placed, higher, start, end, width)

    first_common = F.greatest(*(_bucket(F.col(c), F.col("_level"), width) for c in (l_start, r_start)))
    on = [key, "_level", "_b"]
    made = (own(lp, l_start, l_end).drop("_own").join(below(rp, r_start, r_end, l_levels, False).drop("_own"), on)
            .unionByName(below(lp, l_start, l_end, r_levels, True).drop("_own").join(own(rp, r_start, r_end).drop("_own"), on)))
    return made.filter(F.col("_b") == first_common).drop("_b", "_level")


def overlap_pairs(left: DataFrame, right: DataFrame, key: str, l_start: str, l_end: str, r_start: str, r_end: str,
                  width: float = TIME_BLOCK_S) -> DataFrame:
    """All ``(left, right)`` pairs with ``r_start < l_end AND r_end > l_start`` inside the same ``key``.

    Intervals may have any length. A missing or not-a-number time overlaps nothing.
    """
    overlap = (F.col(r_start) < F.col(l_end)) & (F.col(r_end) > F.col(l_start))
    return candidate_pairs(left, right, key, l_start, l_end, r_start, r_end, width).filter(overlap)


def section_segments(secs: DataFrame, segs: DataFrame, width: float = TIME_BLOCK_S) -> DataFrame:
    """JOI-6 (re-aim): the transcript portion of each section = the segments overlapping its time range.

    ``(video_id, section_index, start_time, end_time, num_segments, transcript_text)``;
    sections that overlap no segment keep 0 and an empty text.
    """
    s = secs.select("video_id", "section_index", "start_time", "end_time")
    g = segs.select("video_id", "pos", "start_s", "end_s", "text")
    pairs = overlap_pairs(s, g, "video_id", "start_time", "end_time", "start_s", "end_s", width)
    body = ordered_concat(pairs, ["video_id", "section_index"], "pos", F.coalesce("text", F.lit("")), " ",
                          "transcript_text", count_as="num_segments")
    return (join_on(s, body, ["video_id", "section_index"], "left")
             .select("video_id", "section_index", "start_time", "end_time",
                     F.coalesce("num_segments", F.lit(0)).alias("num_segments"),
                     F.coalesce("transcript_text", F.lit("")).alias("transcript_text")))


def frame_intervals(frames: DataFrame, width: float = TIME_BLOCK_S) -> DataFrame:
    """WIN-4 (re-aim): each frame is on screen from its time until the next frame's time.

    ``frames`` has ``(video_id, section_index, timestamp, frame_file)``; ties on
    time are ordered by section index. ``until`` is NULL for the last frame.
    A frame that shares its time with a later section is replaced at once. The
    table of one row per ``(video, time)`` with its last section takes a
    time-blocked ``lead`` and is joined back, a join that Spark may split when
    many frames share one time.
    """
    times = frames.groupBy("video_id", "timestamp").agg(F.max("section_index").alias("_top"))
    nxt = next_in_order(times, ["video_id"], ["timestamp"], ["timestamp"], time_block("timestamp", width))
    d = join_on(frames, nxt.select("video_id", "timestamp", "_top", "next_timestamp"), ["video_id", "timestamp"], "left")
    until = F.when(F.col("section_index") < F.col("_top"), F.col("timestamp")).otherwise(F.col("next_timestamp"))
    return d.select(*frames.columns, until.alias("until"))


def frame_at(points: DataFrame, frames: DataFrame, point: str, width: float = TIME_BLOCK_S) -> DataFrame:
    """JOI-7 (re-aim): as-of lookup — the frame on screen at each point (latest frame with time ≤ point).

    The distinct times of frames and points of a video are ordered together in
    time blocks, and the last frame is carried forward within and across blocks
    (:func:`carry_forward`), so no interval is exploded whatever the times are.
    Of frames at one time the last section counts. Points before the first
    frame, and points without a time, get NULLs.
    """
    shown = frames.groupBy("video_id", F.col("timestamp").alias("_at")).agg(
        F.max_by(F.struct(F.col("section_index").alias("frame_section_index"), F.col("frame_file"),
                          F.col("timestamp").alias("frame_time")), "section_index").alias("_frame"))
    asked = points.filter(F.col(point).isNotNull()).select("video_id", F.col(point).alias("_at")).distinct()
    none = F.lit(None).cast(shown.schema["_frame"].dataType)
    both = (shown.withColumn("_asked", F.lit(0)).unionByName(asked.withColumns({"_frame": none, "_asked": F.lit(1)})))
    carried = carry_forward(both, ["video_id"], ["_at", "_asked"], "_frame", time_block("_at", width))
    answers = carried.filter("_asked = 1").select("video_id", F.col("_at").alias(point), "_frame")
    return join_on(points, answers, ["video_id", point], "left").select(*points.columns, "_frame.*")
