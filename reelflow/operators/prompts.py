"""Model request rows and rule-based sectioning (STR-10, DEF-2, DEF-5, JSN-6, WIN-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow import fixed_values as FV
from reelflow.functions import defaults, text
from reelflow.operators.blocked import join_on, pos_block, prev_in_order, running_sum
from reelflow.operators.budget import budget_parts
from reelflow.operators.ordered import ordered_concat
from reelflow.operators.timeline import timeline_text


def backend_for(video_id: Column) -> Column:
    """Corpus assignment of videos to text backends (round robin in blocks of nine)."""
    b = F.floor(video_id / 9).cast("int") % 3
    return F.when(b == 0, "openai").when(b == 1, "anthropic").otherwise("ollama")


def payload(backend: Column, model: Column, prompt: Column, temperature: Column, max_tokens: Column) -> Column:
    """JSN-6: the request body each backend expects, serialised (nulls kept)."""
    opts = {"ignoreNullFields": "false"}
    user = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    system = F.lit(FV.REQUEST_SYSTEM)
    both = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")),
                   F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    openai = F.to_json(F.struct(model.alias("model"), both.alias("messages"), temperature.alias("temperature"),
                                max_tokens.alias("max_tokens"),
                                F.struct(F.lit("json_object").alias("type")).alias("response_format")), opts)
    anthropic = F.to_json(F.struct(model.alias("model"), max_tokens.alias("max_tokens"),
                                   temperature.alias("temperature"), system.alias("system"),
                                   user.alias("messages")), opts)
    ollama = F.to_json(F.struct(model.alias("model"), prompt.alias("prompt"), temperature.alias("temperature"),
                                F.lit(False).alias("stream")), opts)
    return F.when(backend == "openai", openai).when(backend == "anthropic", anthropic).otherwise(ollama)


def llm_requests(segs: DataFrame, languages: DataFrame | None = None, forced_language: str | None = None,
                 backend: Column | None = None, videos: DataFrame | None = None) -> DataFrame:
    """One request per video: ``(video_id, backend, model, language, temperature, max_tokens, prompt, payload)``.

    ``languages`` optionally gives a detected ``language`` per ``video_id``;
    the choice is forced → detected → ``en`` (DEF-2). With ``videos``, videos
    without segments still get a request over an empty transcript.
    """
    tl = timeline_text(segs)
    if videos is not None:
        tl = (join_on(videos.select("video_id").distinct(), tl, ["video_id"], "left")
              .select("video_id", F.coalesce("transcript", F.lit("")).alias("transcript"),
                      F.coalesce("num_segments", F.lit(0)).alias("num_segments")))
    if languages is not None:
        tl = tl.join(languages.select("video_id", F.col("language").alias("_detected")), "video_id", "left")
    else:
        tl = tl.withColumn("_detected", F.lit(None).cast("string"))
    forced = F.lit(forced_language) if forced_language is not None else None
    b = backend_for(F.col("video_id")) if backend is None else backend
    max_tokens = F.try_element_at(defaults.lit_map(FV.LLM_DEFAULT_MAX_TOKENS), F.col("backend"))
    d = tl.withColumns({"backend": b, "language": defaults.language(forced, F.col("_detected")),
                        "temperature": F.lit(FV.LLM_DEFAULT_TEMPERATURE)})
    d = d.withColumns({"model": defaults.llm_model("backend"), "max_tokens": max_tokens.cast("int"),
                       "prompt": text.request_text("language", "transcript")})
    d = d.withColumn("payload", payload(F.col("backend"), F.col("model"), F.col("prompt"), F.col("temperature"),
                                        F.col("max_tokens")))
    return d.select("video_id", "backend", "model", "language", "temperature", "max_tokens", "prompt", "payload")


def rule_sections(segs: DataFrame, pause_s: float = 1.0, max_chars: int | None = None) -> DataFrame:
    """WIN-6: a new section starts at the first segment and after every pause longer than ``pause_s``.

    The previous segment is the one before it by position, found by a blocked
    ``lag``, so gaps in the positions split nothing; section numbers are a
    blocked running sum, so no window holds a whole video. With ``max_chars``, a
    section also ends before the segment that would make its text longer than
    that: no section exceeds it unless it is a single segment. Such cuts depend
    on each other, so they come from ``budget.budget_parts``, and a hot
    pause-free video makes many bounded sections in many tasks. Per section:
    first start, last end, segment count and the texts joined by one space.
    """
    d = prev_in_order(segs, ["video_id"], ["pos"], ["pos", "end_s"], pos_block("pos"))
    paused = F.coalesce(F.col("start_s") - F.col("prev_end_s") > pause_s, F.lit(False))
    is_new = F.col("prev_pos").isNull() | F.col("prev_end_s").isNull() | paused
    if max_chars is not None:
        numbers = d.select("video_id", "pos", is_new.alias("_new"), F.coalesce(F.length("text"), F.lit(0)).alias("_length"))
        # a section's text has a space less than it has segments
        parts = budget_parts(numbers, ["video_id"], "pos", F.col("_length") + 1, max_chars + 1, F.col("_new"))
        d = join_on(segs, parts, ["video_id", "pos"]).withColumn("section_index", F.col("part").cast("int"))
    else:
        d = running_sum(d.withColumn("_new", is_new.cast("int")), ["video_id"], "pos", "_new", "_sec")
        d = d.withColumn("section_index", (F.col("_sec") - 1).cast("int"))
    return ordered_concat(d, ["video_id", "section_index"], "pos", F.coalesce("text", F.lit("")), " ",
                          "transcript_text", count_as="num_segments", firsts={"start_time": "start_s"},
                          lasts={"end_time": "end_s"})
