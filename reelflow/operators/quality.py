"""Validation filters that route bad rows to a quarantine table (FLT-4…8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow import fixed_values as FV

QUARANTINE_COLS = ["source", "record_key", "reason"]


def _key(*cols) -> F.Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in cols])


def unsupported(df: DataFrame, source: str, column: str, allowed: list[str], *key_cols: str) -> DataFrame:
    """FLT-5: values outside an enumeration."""
    return (df.filter(~F.coalesce(F.col(column).isin(allowed), F.lit(False)))
              .select(F.lit(source).alias("source"), _key(*key_cols).alias("record_key"),
                      F.concat(F.lit(f"unsupported {column}: "), F.coalesce(F.col(column), F.lit("NULL")))
                       .alias("reason")))


def missing_fields(segs: DataFrame) -> DataFrame:
    """FLT-8: caption writers need ``start``, ``end`` and ``text``; the LLM context does not."""
    missing = F.concat_ws(",", F.when(F.col("start_s").isNull(), "start"), F.when(F.col("end_s").isNull(), "end"),
                          F.when(F.col("text").isNull(), "text"))
    return (segs.filter(F.col("start_s").isNull() | F.col("end_s").isNull() | F.col("text").isNull())
                .select(F.lit("segments").alias("source"), _key("video_id", "pos").alias("record_key"),
                        F.concat(F.lit("missing field: "), missing).alias("reason")))


def failed_images(results: DataFrame) -> DataFrame:
    """FLT-4: only HTTP 200 answers carry an image."""
    return (results.filter(F.col("status_code") != 200)
                   .select(F.lit("image_results").alias("source"),
                           _key("video_id", "section_index").alias("record_key"),
                           F.concat(F.lit("http status "), F.col("status_code").cast("string")).alias("reason")))


def quarantine(segs: DataFrame, responses: DataFrame, results: DataFrame) -> DataFrame:
    """All rejected rows with a reason, one union over the stages."""
    return (missing_fields(segs)
            .unionByName(unsupported(responses, "llm_responses", "backend", FV.LLM_BACKENDS, "video_id"))
            .unionByName(unsupported(results, "image_results", "backend", FV.IMAGE_BACKENDS,
                                     "video_id", "section_index"))
            .unionByName(failed_images(results)))


def video_id_of(video_key) -> F.Column:
    """Numeric corpus id behind a ``vid_NNNNN`` video key, else NULL."""
    return F.nullif(F.regexp_extract(video_key, r"^vid_(\d+)$", 1), F.lit("")).try_cast("bigint")


def missing_inputs(canon: DataFrame, inventory: DataFrame, segs: DataFrame, secs: DataFrame,
                   key_to_video=video_id_of) -> DataFrame:
    """FLT-6: per request, the first pipeline stage whose input artefact is missing.

    ``download`` — the URL names no video; ``transcribe`` — no media file in the
    inventory; ``prompts`` — no transcript; ``images`` — no sections. Each test
    is an anti join, so nothing per-video is collected. ``key_to_video`` maps a
    canonical URL's video key to the corpus ``video_id`` (NULL = no video).
    """
    c = canon.select("request_id", "canonical_url", key_to_video(F.col("video_key")).alias("video_id"))
    inv = inventory.select(F.col("key").alias("canonical_url")).withColumn("_media", F.lit(True))
    have_tr = segs.select("video_id").distinct().withColumn("_tr", F.lit(True))
    have_sec = secs.select("video_id").distinct().withColumn("_sec", F.lit(True))
    j = (c.join(inv, "canonical_url", "left").join(have_tr, "video_id", "left").join(have_sec, "video_id", "left"))
    stage = (F.when(F.col("video_id").isNull(), "download")
              .when(F.col("_media").isNull(), "transcribe")
              .when(F.col("_tr").isNull(), "prompts")
              .when(F.col("_sec").isNull(), "images"))
    reason = (F.when(F.col("video_id").isNull(), "url names no video")
               .when(F.col("_media").isNull(), "media file not found")
               .when(F.col("_tr").isNull(), "transcript not found")
               .when(F.col("_sec").isNull(), "prompts not found"))
    return j.select("request_id", stage.alias("stage"), reason.alias("reason")).filter(F.col("stage").isNotNull())
