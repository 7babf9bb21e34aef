"""Per-video roll-up across the stages (JOI-5, AGG-13, STR-4, STR-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.functions import text
from reelflow.operators.blocked import join_on
from reelflow.operators.images import OUTPUT_ROOT


def video_summary(transcripts: DataFrame, segs: DataFrame, secs: DataFrame, results: DataFrame) -> DataFrame:
    """One row per transcript file: names of every artefact and the count at each stage.

    ``transcripts`` is ``(video_id, transcript_file)``. Stage counts are partial
    aggregates (one small row per video per task before the shuffle), joined
    on ``video_id``; videos missing from a later stage count 0 there.
    """
    n_seg = segs.groupBy("video_id").agg(F.count(F.lit(1)).alias("num_segments"))
    n_sec = secs.groupBy("video_id").agg(F.count(F.lit(1)).alias("num_sections"))
    n_img = (results.groupBy("video_id")
                    .agg(F.count_if(F.col("status_code") == 200).alias("num_images")))
    d = transcripts.withColumn("video_name", text.video_name("transcript_file"))
    for agg in (n_seg, n_sec, n_img):
        d = join_on(d, agg, ["video_id"], "left")
    return d.select(
        "video_id", "video_name", "transcript_file",
        text.with_suffix("video_name", ".srt").alias("srt_file"),
        text.with_suffix("video_name", "_prompts.json").alias("prompts_file"),
        F.concat_ws("/", F.lit(OUTPUT_ROOT), "video_name").alias("output_dir"),
        F.coalesce("num_segments", F.lit(0)).alias("num_segments"),
        F.coalesce("num_sections", F.lit(0)).alias("num_sections"),
        F.coalesce("num_images", F.lit(0)).alias("num_images"),
    )


ARTEFACT_SUFFIXES = [("aligned_json", ".aligned.json"), ("srt", ".srt"), ("vtt", ".vtt"),
                     ("clips_csv", ".clips.csv"), ("wav", "_16k.wav")]


def transcript_artefacts(media: DataFrame, output_dir: str = "outputs") -> DataFrame:
    """DM-8 / STR-5: the files one transcription writes, one row per ``(video_id, kind, path)``.

    ``media`` is ``(video_id, media_file)``; names derive from the media file's stem.
    """
    stem = text.file_stem(F.regexp_extract("media_file", r"([^/]+)$", 1))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(sfx).alias("sfx")) for k, sfx in ARTEFACT_SUFFIXES])
    return (media.select("video_id", stem.alias("_stem"), F.explode(kinds).alias("_k"))
                 .select("video_id", F.col("_k.kind").alias("kind"),
                         F.concat_ws("/", F.lit(output_dir), F.concat("_stem", F.col("_k.sfx"))).alias("path")))
