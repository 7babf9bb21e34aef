"""Subtitle cues, subtitle documents and clips (TIM-1/2, STR-1…3, WIN-1, AGG-3/4, DM-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.functions import clock, text
from reelflow.operators.blocked import join_on, running_sum
from reelflow.operators.ordered import ordered_concat

VTT_HEADER = "WEBVTT\n\n"


def numbered(segs: DataFrame) -> DataFrame:
    """WIN-1: ``segs`` with the 1-based ``cue_index`` by position; positions may have gaps or start anywhere."""
    d = running_sum(segs, ["video_id"], "pos", F.lit(1).cast("bigint"), "cue_index")
    return d.withColumn("cue_index", F.col("cue_index").cast("int"))


def srt_cues(segs: DataFrame) -> DataFrame:
    """One SRT cue per segment: ``(video_id, pos, cue_index, start_clock, end_clock, text, cue)``."""
    return numbered(segs).select(
        "video_id", "pos", "cue_index",
        clock.srt_clock("start_s").alias("start_clock"), clock.srt_clock("end_s").alias("end_clock"),
        text.py_strip("text").alias("text"),
    ).withColumn("cue", text.srt_cue("cue_index", "start_clock", "end_clock", "text"))


def vtt_cues(segs: DataFrame) -> DataFrame:
    """One WebVTT cue per segment: ``(video_id, pos, start_clock, end_clock, text, cue)``."""
    return segs.select(
        "video_id", "pos",
        clock.vtt_clock("start_s").alias("start_clock"), clock.vtt_clock("end_s").alias("end_clock"),
        text.py_strip("text").alias("text"),
    ).withColumn("cue", text.vtt_cue("start_clock", "end_clock", "text"))


def _with_empty_videos(bodies: DataFrame, videos: DataFrame | None, empty_body: str) -> DataFrame:
    """Videos without segments still get a document (empty SRT, header-only VTT)."""
    if videos is None:
        return bodies
    return (join_on(videos.select("video_id"), bodies, ["video_id"], "left")
                  .select("video_id", F.coalesce("num_cues", F.lit(0)).alias("num_cues"),
                          F.coalesce("body", F.lit(empty_body)).alias("body")))


def srt_body(segs: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """AGG-3: the SRT document per video: ``(video_id, num_cues, body)``."""
    b = ordered_concat(srt_cues(segs), ["video_id"], "pos", "cue", "", "body", count_as="num_cues")
    return _with_empty_videos(b, videos, "")


def vtt_body(segs: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """AGG-4: the WebVTT document per video, header first even with no cues."""
    b = ordered_concat(vtt_cues(segs), ["video_id"], "pos", "cue", "", "body", count_as="num_cues")
    b = b.withColumn("body", F.concat(F.lit(VTT_HEADER), "body"))
    return _with_empty_videos(b, videos, VTT_HEADER)


def clips(segs: DataFrame) -> DataFrame:
    """DM-7: ``(video_id, pos, start, end, text)`` with the text stripped."""
    return segs.select("video_id", "pos", F.col("start_s").alias("start"), F.col("end_s").alias("end"),
                       text.py_strip("text").alias("text"))
