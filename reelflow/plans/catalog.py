"""The query catalogue: one ``(spark, sf_dir) -> DataFrame`` per operator group.

Every query reads the driver tables (through the derived views) over their
whole extent; arrays and maps are rendered as strings only at this edge so the
DuckDB twin can compare values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelflow import fixed_values as FV
from reelflow.operators import (captions, images, inference, intervals, planning, prompts, quality, responses,
                                summary, timeline)
from reelflow.session import scratch_path
from reelflow.sinks import writers
from reelflow.sinks.named import write_files
from reelflow.sources import files, views
from reelflow.sources.tables import table
from reelflow.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ------------------------------------------------------------------ M0 / M1
@query
def timeline_text(spark, sf):
    return timeline.timeline_text(views.segments(spark, sf))


@query
def srt_cues(spark, sf):
    return captions.srt_cues(views.segments(spark, sf))


@query
def vtt_cues(spark, sf):
    return captions.vtt_cues(views.segments(spark, sf))


@query
def srt_body(spark, sf):
    return captions.srt_body(views.segments(spark, sf))


@query
def vtt_body(spark, sf):
    return captions.vtt_body(views.segments(spark, sf))


@query
def clips(spark, sf):
    return captions.clips(views.segments(spark, sf))


@query
def word_timeline(spark, sf):
    return timeline.word_timeline(views.segments(spark, sf))


# ------------------------------------------------------------------ M2: URLs and planning


# Cache folders already on disk in the model plan (a run parameter).
PRESENT_MODELS = ["tiny", "base"]


def _canon(spark, sf):
    return planning.canonical_requests(views.requests(spark, sf))


@query
def canonical_urls(spark, sf):
    return _canon(spark, sf)


@query
def pending_requests(spark, sf):
    return planning.pending(_canon(spark, sf), views.inventory(spark, sf)).select(
        "request_id", "canonical_url", "video_key")


@query
def done_requests(spark, sf):
    return planning.done(_canon(spark, sf), views.inventory(spark, sf)).select(
        "request_id", "canonical_url", "video_key")


def _present(spark):
    cat = planning.catalogue(spark).filter(F.col("name").isin(PRESENT_MODELS))
    return cat.select(F.concat(F.lit("models--"), F.replace("repo", F.lit("/"), F.lit("--"))).alias("key"))


def _plan(spark, sf):
    return planning.model_plan(spark, views.model_batches(spark, sf), views.model_requests(spark, sf),
                               _present(spark))


@query
def model_plan(spark, sf):
    return _plan(spark, sf)


@query
def batch_validation(spark, sf):
    r = planning.batch_results(views.model_batches(spark, sf), _plan(spark, sf), outcomes=views.model_outcomes(spark, sf))
    return r.withColumn("successful", F.array_join("successful", ",")) \
            .withColumn("failed", F.array_join("failed", ","))


@query
def quarantine(spark, sf):
    return quality.quarantine(*views.flawed(spark, sf))


@query
def missing_inputs(spark, sf):
    return quality.missing_inputs(_canon(spark, sf), views.inventory(spark, sf), *views.finished(spark, sf))


# ------------------------------------------------------------------ M3: requests and responses


@query
def llm_requests(spark, sf):
    return prompts.llm_requests(views.segments(spark, sf))


@query
def extract_json(spark, sf):
    return responses.extract(views.llm_responses(spark, sf)).select("video_id", "backend", "extracted")


@query
def parsed_sections(spark, sf):
    return responses.parsed_sections(views.llm_responses(spark, sf), views.segments(spark, sf))


@query
def backend_comparison(spark, sf):
    return responses.backend_comparison(views.llm_responses(spark, sf))


@query
def rule_sections(spark, sf):
    return prompts.rule_sections(views.segments(spark, sf))


# ------------------------------------------------------------------ M4: images and summary


def _secs_results(spark, sf):
    secs = views.sections(spark, sf)
    return secs, views.image_results(spark, sf, secs)


def prices(spark):
    """Documented unit prices (3 fixed rows)."""
    rows = [F.struct(F.lit(b).alias("backend"), F.lit(p).cast("decimal(10,4)").alias("unit_price"))
            for b, p in FV.IMAGE_UNIT_PRICE]
    return spark.range(1).select(F.inline(F.array(*rows)))


@query
def image_requests(spark, sf):
    return images.image_requests(views.sections(spark, sf))


@query
def image_manifest(spark, sf):
    return images.manifest_flat(*_secs_results(spark, sf))


@query
def image_payloads(spark, sf):
    return images.payload_bytes(_secs_results(spark, sf)[1])


@query
def image_cost(spark, sf):
    return images.cost(_secs_results(spark, sf)[1], prices(spark))


@query
def image_progress(spark, sf):
    return images.progress(*_secs_results(spark, sf))


@query
def frame_collisions(spark, sf):
    return images.frame_collisions(views.crowded_sections(spark, sf), views.image_results(spark, sf))


@query
def section_preview(spark, sf):
    return images.preview(views.sections(spark, sf))


@query
def video_summary(spark, sf):
    segs = views.segments(spark, sf)
    secs = views.sections(spark, sf, segs)
    tr = segs.select("video_id").distinct().select(
        "video_id", F.concat(F.lit("conv_"), F.col("video_id").cast("string"), F.lit(".aligned.json"))
        .alias("transcript_file"))
    return summary.video_summary(tr, segs, secs, views.image_results(spark, sf, secs))


# ------------------------------------------------------------------ M5: time joins


def _frames(spark, sf):
    secs, res = _secs_results(spark, sf)
    return images.image_records(secs, res).select("video_id", "section_index", "timestamp", "frame_file")


@query
def section_segments(spark, sf):
    segs = views.segments(spark, sf)
    return intervals.section_segments(views.sections(spark, sf, segs), segs)


@query
def frame_intervals(spark, sf):
    return intervals.frame_intervals(_frames(spark, sf)).select(
        "video_id", "section_index", "frame_file", "timestamp", "until")


@query
def frame_asof(spark, sf):
    segs = views.segments(spark, sf).select("video_id", "pos", "start_s")
    return intervals.frame_at(segs, _frames(spark, sf), "start_s").select(
        "video_id", "pos", "start_s", "frame_section_index", "frame_file", "frame_time")


# ------------------------------------------------------------------ M6: streaming


@query
def stream_ingest(spark, sf):
    s = jobs.read_folder(spark, sf, jobs.CONVERSATIONS, "conversations.parquet")
    return jobs.run_available(jobs.transcript_rows(s), "stream_ingest")


@query
def stream_dedup(spark, sf):
    s = jobs.read_folder(spark, sf, jobs.PAGES, "pages.parquet")
    return jobs.dedup_requests(jobs.request_stream(s))


@query
def stream_pending(spark, sf):
    s = jobs.read_folder(spark, sf, jobs.PAGES, "pages.parquet")
    return jobs.run_available(jobs.pending_stream(jobs.request_stream(s), views.inventory(spark, sf)),
                              "stream_pending")


@query
def stream_sessions(spark, sf):
    s = jobs.read_folder(spark, sf, jobs.EVENTS, "events.parquet")
    return jobs.run_flushed(jobs.sessions, s, "ts", "stream_sessions")[1]


@query
def stream_sections(spark, sf):
    s = jobs.read_folder(spark, views.arriving_segments_path(spark, sf), jobs.SEGMENTS, "*.parquet")
    return jobs.sections_as_finished(s)


@query
def stream_counts(spark, sf):
    s = jobs.read_folder(spark, sf, jobs.EVENTS, "events.parquet")
    return jobs.run_flushed(jobs.interval_counts, s, "ts", "stream_counts")[1]


@query
def stream_image_status(spark, sf):
    path = views.image_events_path(spark, sf)
    s = jobs.read_folder(spark, path, jobs.IMAGE_EVENTS, "*.parquet")
    return jobs.run_flushed(jobs.image_status_counts, s, "finished_at", "stream_image_status")[1]


# ------------------------------------------------------------------ M6: pluggable inference


@query
def stub_inference(spark, sf):
    return inference.generate_text(prompts.llm_requests(views.segments(spark, sf)), "stub")


@query
def stub_images(spark, sf):
    return inference.generate_images(images.image_requests(views.sections(spark, sf)), "stub")


# ------------------------------------------------------------------ long transcripts (documents)
@query
def document_requests(spark, sf):
    return prompts.llm_requests(views.document_segments(spark, sf), views.document_languages(spark, sf))


@query
def document_srt(spark, sf):
    return captions.srt_body(views.document_segments(spark, sf))


# ------------------------------------------------------------------ positions with gaps, shared times
@query
def sparse_srt_cues(spark, sf):
    return captions.srt_cues(views.sparse_segments(spark, sf))


@query
def sparse_rule_sections(spark, sf):
    return prompts.rule_sections(views.sparse_segments(spark, sf))


@query
def sparse_parsed_sections(spark, sf):
    return responses.parsed_sections(views.llm_responses(spark, sf), views.sparse_segments(spark, sf))


@query
def budget_sections(spark, sf):
    return prompts.rule_sections(views.sparse_segments(spark, sf), pause_s=1e9, max_chars=2000)


def _crowded_frames(spark, sf):
    return images.image_records(views.crowded_sections(spark, sf), views.image_results(spark, sf)).select(
        "video_id", "section_index", "timestamp", "frame_file")


@query
def crowded_frame_intervals(spark, sf):
    return intervals.frame_intervals(_crowded_frames(spark, sf)).select(
        "video_id", "section_index", "frame_file", "timestamp", "until")


@query
def crowded_frame_asof(spark, sf):
    segs = views.segments(spark, sf).select("video_id", "pos", "start_s")
    return intervals.frame_at(segs, _crowded_frames(spark, sf), "start_s").select(
        "video_id", "pos", "start_s", "frame_section_index", "frame_file", "frame_time")


# ------------------------------------------------------------------ answers to manifests, two text backends a video
def _chain(spark, sf):
    """Sections of every text backend, their image requests, and one result for each."""
    secs = (responses.parsed_sections(views.chain_responses(spark, sf), views.segments(spark, sf))
            .withColumnsRenamed({"backend": "text_backend", "model": "text_model"}))
    asked = images.image_requests(secs)
    k = F.col("video_id") + F.col("section_index") + F.when(F.col("text_backend") == "openai", 1).otherwise(0)
    return secs, asked.select("video_id", "text_backend", "text_model", "section_index", "backend",
                              F.when(k % 4 == 0, 429).otherwise(200).alias("status_code"))


def _manifest_text(m):
    """The nested list as a string, for the comparison alone."""
    image = lambda x: F.concat_ws("|", x["section_index"].cast("string"), x["image_path"], F.format_string("%.3f", x["timestamp"]), x["prompt"])
    return m.withColumns({"images": F.array_join(F.transform("images", image), "\n"), "settings": F.to_json("settings")}).drop(
        "generated_at", "device")


@query
def section_chain(spark, sf):
    return _manifest_text(images.manifest(*_chain(spark, sf)))


CUSTOM = {"model": "own-model", "negative_prompt": "no text",
          "overrides": {"num_inference_steps": 12, "guidance_scale": 3.5, "image_size": (640, 480), "quality": "hd",
                        "size": "1792x1024", "aspect_ratio": "16:9", "output_format": "webp"}}


@query
def image_requests_custom(spark, sf):
    return images.image_requests(views.sections(spark, sf), **CUSTOM)


@query
def manifests_custom(spark, sf):
    """DEF-3, DEF-4, DEF-5: manifests record what their call chose."""
    return _manifest_text(images.manifest(*_secs_results(spark, sf), **CUSTOM)).drop("video_id")


@query
def merged_records(spark, sf):
    secs, results = _secs_results(spark, sf)
    keeps = {"diffusers": [], "openai": ["revised_prompt"], "stability": ["seed"]}
    parts = [images.image_records(secs, results.filter(F.col("backend") == b)).drop(*{"revised_prompt", "seed"} - set(own))
             for b, own in keeps.items()]
    return images.merge_backend_records(*parts)


# ------------------------------------------------------------------ documents written and read back
def _languages(spark, sf):
    return views.segments(spark, sf).select("video_id").distinct().withColumn(
        "language", F.when(F.col("video_id") % 3 == 0, "de").when(F.col("video_id") % 3 == 1, "fr"))


def _number(name: str):
    return F.regexp_extract(name, r"(\d+)$", 1).cast("bigint")


@query
def roundtrip_transcripts(spark, sf):
    """SNK-1, SNK-8, SRC-1, SRC-3, SRC-7: all videos' files are written, then some again with other texts, and found by name."""
    path, segs = scratch_path(spark, "transcripts"), views.segments(spark, sf)
    write_files(writers.aligned_files(writers.aligned_documents(segs, _languages(spark, sf)), "large-v3"), path)
    again = segs.filter(F.col("video_id") % 4 == 0).withColumn("text", F.concat(F.lit("again: "), "text"))
    write_files(writers.aligned_files(writers.aligned_documents(again, _languages(spark, sf)), "large-v3"), path)
    docs = files.read_transcripts(spark, path)
    return timeline.explode_segments(docs).join(docs.select("video_id", "language"), "video_id")


@query
def roundtrip_prompts(spark, sf):
    """SNK-5, SNK-7, SRC-2, SRC-8: one file per video and model, in the video's language."""
    path = scratch_path(spark, "prompts")
    parsed = responses.parsed_sections(views.chain_responses(spark, sf), views.segments(spark, sf))
    write_files(writers.prompts_files(writers.prompts_documents(parsed, languages=_languages(spark, sf)), folders=True), path)
    docs = files.read_prompts(spark, path).withColumn("document", F.concat_ws("/", "video_name", "model", "language"))
    return images.explode_sections(docs, "document")


@query
def roundtrip_manifests(spark, sf):
    """SNK-6, SNK-7: nested manifests, one file per video."""
    path = scratch_path(spark, "manifests")
    write_files(writers.manifest_files(images.manifest(*_secs_results(spark, sf))), path)
    return _manifest_text(files.read_manifests(spark, path))


@query
def roundtrip_captions(spark, sf):
    """SNK-2, SNK-3: subtitle files of both kinds, whole, with their files' videos."""
    path, segs = scratch_path(spark, "captions"), views.segments(spark, sf)
    write_files(writers.subtitle_files(captions.srt_body(segs), "srt").unionAll(writers.subtitle_files(captions.vtt_body(segs), "vtt")), path)
    return files.read_subtitles(spark, path).select("kind", _number("video_id").alias("video_id"), F.col("body").alias("value"))


@query
def roundtrip_clips(spark, sf):
    """SNK-4: clips as CSV files."""
    path = scratch_path(spark, "clips")
    write_files(writers.clips_files(captions.clips(views.segments(spark, sf)), "large-v3"), path)
    return files.read_clips(spark, path).withColumn("video_id", _number("video_id"))


@query
def file_inventory(spark, sf):
    """SRC-5: the subtitle files on disk, by name and size."""
    path = scratch_path(spark, "inventory")
    write_files(writers.subtitle_files(captions.srt_body(views.segments(spark, sf)), "srt"), path)
    return files.read_inventory(spark, path, glob="*.srt").select("key", "length")


@query
def url_list(spark, sf):
    """SRC-6: the requests as a text file with blank lines, read back and canonicalised."""
    path = scratch_path(spark, "urls")
    lines = views.requests(spark, sf).select(F.explode(F.array(F.concat(F.lit("  "), "url", F.lit(" ")), F.lit(""), F.lit("   "))).alias("value"))
    lines.write.text(path)
    return planning.canonical_requests(files.read_url_list(spark, path)).drop("request_id")
