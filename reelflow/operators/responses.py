"""Model answers → typed sections, with the per-backend quirks (JSN-1…5, FLT-7, AGG-2, STR-8).

Status per answer:
  ``parsed``   — a ``sections`` list (object form or top-level array);
  ``fallback`` — unusable answer: one section built from the transcript;
  ``error``    — an object whose ``sections`` is null (for the backends that
                 would abort there) or not a list; exposed instead of aborting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow import fixed_values as FV
from reelflow.functions import defaults, jsonx, text
from reelflow.functions.bind import let
from reelflow.operators.blocked import join_on, running_sum
from reelflow.operators.ordered import ordered_concat
from reelflow.sources.stage import written

SECTION_COLS = FV.SECTION_FIELDS


def extract(responses: DataFrame) -> DataFrame:
    """JSN-1/2: per-backend extraction of the JSON text from the raw answer."""
    return responses.withColumn("extracted", jsonx.extract_for_backend("backend", "content"))


def _classify_text(backend: Column, t: Column) -> Column:
    """Status and typed sections of one extracted text; every test is evaluated once."""
    facts = F.struct(jsonx.strict_json_ok(t).alias("ok"), jsonx.json_kind(t).alias("kind"),
                     jsonx.has_key(t, "sections").alias("has"), jsonx.sections_kind(t).alias("skind"))

    def decide(f: Column) -> Column:
        obj_with = f["ok"] & (f["kind"] == "object") & f["has"]
        return (F.when(obj_with & (f["skind"] == "array"), "parsed")
                 .when(obj_with & (f["skind"] == "null") & (backend == "openai"), "fallback")
                 .when(obj_with, "error")
                 .when(f["ok"] & (f["kind"] == "array"), "parsed")
                 .otherwise("fallback"))

    def build(f: Column) -> Column:
        status = decide(f)
        sections = F.when(status == "parsed", jsonx.typed_sections(t, f["kind"]))
        raw = F.when(status == "parsed", jsonx.raw_sections(t, f["kind"]))
        reason = F.when(status == "error", F.when(f["skind"] == "null", "sections is null").otherwise("sections is not a list"))
        return F.struct(status.alias("status"), sections.alias("sections"), raw.alias("sections_raw"), reason.alias("reason"))

    return let(facts, build)


def classify(responses: DataFrame) -> DataFrame:
    """JSN-3/4/5: strict parse and shape dispatch; one row per answer.

    Adds ``status``, ``sections`` (typed array, NULL unless parsed; an item that
    is no object has NULL fields and a ``reason``), ``sections_raw`` (each
    section's JSON text, so ill-typed fields stay visible), ``num_sections`` and
    ``reason`` (why an answer is in ``error``).
    """
    d = extract(responses)
    d = d.withColumn("_c", let(F.col("extracted"), lambda t: _classify_text(F.col("backend"), t)))
    status, sections = F.col("_c.status"), F.col("_c.sections")
    d = d.withColumns({
        "status": status, "sections": sections, "sections_raw": F.col("_c.sections_raw"), "reason": F.col("_c.reason"),
        "num_sections": F.when(status == "parsed", F.size(sections))
                         .when(status == "fallback", F.lit(1)).otherwise(F.lit(0)),
    })
    return d.drop("_c")


def fallback_stats(segs: DataFrame, videos: DataFrame) -> DataFrame:
    """AGG-2 inputs for the videos in ``videos``: ``(video_id, start_time, end_time, full_text)``.

    First ``start`` and last ``end`` by list order (``min_by``/``max_by`` —
    partial aggregates, safe for a hot video) and the segment texts joined by
    one space. The segment of rank ``k`` (by position, from 1) starts at
    character ≥ ``k - 1`` of the joined text whatever the positions are, so only
    the first ranks can reach the 500-character cut: an exact bound. Videos
    without segments are absent (see :func:`fallback_columns`).
    """
    s = segs.join(videos.select("video_id").distinct(), "video_id", "left_semi")
    span = s.groupBy("video_id").agg(
        F.min_by(F.coalesce("start_s", F.lit(0.0)), "pos").alias("start_time"),
        F.max_by(F.coalesce("end_s", F.lit(0.0)), "pos").alias("end_time"))
    ranked = running_sum(s.select("video_id", "pos", "text"), ["video_id"], "pos", F.lit(1).cast("bigint"), "_rank")
    head = ordered_concat(ranked.filter(F.col("_rank") <= FV.FALLBACK_TEXT_CHARS), ["video_id"], "pos",
                          F.coalesce("text", F.lit("")), " ", "full_text")
    return join_on(span, head, ["video_id"], "left")


def fallback_columns() -> list[Column]:
    """FLT-7 / STR-8: the seven section fields from :func:`fallback_stats` columns (NULL stats = no segments)."""
    e = FV.FALLBACK_EMPTY
    has = F.col("full_text").isNotNull()
    return [
        F.coalesce("start_time", F.lit(e["start_time"])).alias("start_time"),
        F.coalesce("end_time", F.lit(e["end_time"])).alias("end_time"),
        F.when(has, text.prefix("full_text", FV.FALLBACK_TEXT_CHARS)).otherwise(F.lit(e["transcript_text"]))
         .alias("transcript_text"),
        F.when(has, F.concat(F.lit(FV.FALLBACK_PROMPT_PREFIX), text.prefix("full_text", FV.FALLBACK_PROMPT_CHARS)))
         .otherwise(F.lit(e["image_prompt"])).alias("image_prompt"),
        F.lit(FV.FALLBACK_SENTIMENT).alias("sentiment"),
        F.when(has, F.lit(FV.FALLBACK_SCENE)).otherwise(F.lit(e["scene_description"])).alias("scene_description"),
        F.lit(FV.FALLBACK_STYLE).alias("visual_style"),
    ]


def fallback_sections(segs: DataFrame, videos: DataFrame) -> DataFrame:
    """AGG-2 / FLT-7 / STR-8: the single fallback section for each video in ``videos``."""
    v = videos.select("video_id").distinct()
    return join_on(v, fallback_stats(segs, v), ["video_id"], "left").select("video_id", *fallback_columns())


def parsed_sections(responses: DataFrame, segs: DataFrame) -> DataFrame:
    """One row per section: ``(video_id, backend, model, status, section_index, <7 fields>, reason)``.

    Every answer yields at least one row: each item of its parsed list (an item
    that is no object with NULL fields and a ``reason``), its one fallback
    section, or one row without an index where the list is empty or the answer
    is in ``error``, with the ``reason``. Answers are classified once, into a
    table in the shared folder; fallback text is only aggregated for the videos
    that need it.
    """
    c = written(classify(responses).withColumn("model", defaults.llm_model("backend"))
                .select("video_id", "backend", "model", "status", "sections", "reason"), "classified-answers")
    stats = fallback_stats(segs, c.filter(F.col("status") == "fallback"))
    j = c.join(stats, "video_id", "left")
    fallback = F.struct(*fallback_columns(), F.lit(None).cast("string").alias("reason"))
    rows = F.when(F.col("status") == "fallback", F.array(fallback)).otherwise(F.col("sections"))
    out = j.select("video_id", "backend", "model", "status", F.col("reason").alias("_reason"),
                   F.posexplode_outer(rows).alias("section_index", "s"))
    empty = F.when((F.col("status") == "parsed") & F.col("section_index").isNull(), F.lit("no sections"))
    return out.select("video_id", "backend", "model", "status", F.col("section_index").cast("int").alias("section_index"),
                      *[F.col("s").getField(f).alias(f) for f in SECTION_COLS],
                      F.coalesce(F.col("_reason"), empty, F.col("s.reason")).alias("reason"))


def backend_comparison(responses: DataFrame) -> DataFrame:
    """AGG-7 / AGG-11: answers and sections per backend and model, with failure counts."""
    c = classify(responses).withColumn("model", defaults.llm_model("backend"))
    return c.groupBy("backend", "model").agg(
        F.count(F.lit(1)).alias("n_videos"),
        F.count_if(F.col("status") == "parsed").alias("n_parsed"),
        F.count_if(F.col("status") == "fallback").alias("n_fallback"),
        F.count_if(F.col("status") == "error").alias("n_error"),
        F.sum("num_sections").alias("n_sections"),
    )
