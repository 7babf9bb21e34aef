"""Writers for every artefact (SNK-1 … SNK-8).

``aligned_files``, ``subtitle_files``, ``clips_files``, ``prompts_files`` and
``manifest_files`` give rows (name, body) under the names that the readers and
later steps look for; ``named.write_files`` writes them, one file a document.
``transcript_files`` holds all four files of a video.

The ``write_*`` functions below make tables instead, partitioned by video, for
corpora where one file a document is too many. Every one of them needs a partition key and overwrites only the partitions it
produces (dynamic partition overwrite), so re-running a video replaces its
previous output (SNK-8) and leaves other videos alone. Document bodies keep
their names; the partition folders only repeat them. The readers in
``reelflow.sources.files`` read all of it back (``layout="table"``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow import fixed_values as FV
from reelflow.functions import text
from reelflow.operators import captions
from reelflow.operators.blocked import join_on
from reelflow.operators.ordered import ordered_collect, ordered_concat


def _writer(df: DataFrame, partition_by: list[str]):
    if not partition_by:
        raise ValueError("an overwrite needs a partition key: without one it would delete other videos")
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)


def aligned_documents(segs: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """DM-6 per video: ``(video_id, language, segments)`` with segments in list order, their words where known."""
    fields = [F.col("start_s").alias("start"), F.col("end_s").alias("end"), F.col("text")]
    if "words" in segs.columns:
        fields.append(F.col("words"))
    docs = ordered_collect(segs, ["video_id"], "pos", F.struct(*fields), "segments")
    if languages is not None:
        docs = docs.join(languages.select("video_id", "language"), "video_id", "left")
    else:
        docs = docs.withColumn("language", F.lit(None).cast("string"))
    return docs.select("video_id", F.coalesce("language", F.lit("en")).alias("language"), "segments")


def write_aligned_json(docs: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """SNK-1: aligned transcript JSON, one document a line, UTF-8 with non-ASCII kept, by default under ``video=<id>/``."""
    named = docs.withColumn("video_name", text.video_label(docs))
    if partition_by is None:
        named, partition_by = named.withColumn("video", F.col("video_name")), ["video"]
    _writer(named, partition_by).json(path, encoding="UTF-8")


def _file(name: Column, *parts: Column | str, folder: tuple[Column | str, ...] = ()) -> Column:
    """``<folder…>/<name><parts…>``; a missing folder is left out."""
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    return F.concat_ws("/", *[lit(f) for f in folder], F.concat(name, *[lit(p) for p in parts]))


def _own_folder(frame: DataFrame, model: str | None) -> tuple:
    """SNK-7: ``<video>/<model>`` where the speech model is named, else no folder."""
    return () if model is None else (text.video_label(frame), model)


def aligned_files(docs: DataFrame, model: str | None = None) -> DataFrame:
    """SNK-1: ``<video>.aligned.json`` of ``aligned_documents``, non-ASCII kept."""
    return docs.select(_file(text.video_label(docs), ".aligned.json", folder=_own_folder(docs, model)).alias("name"),
                       F.to_json(F.struct("language", "segments")).alias("body"))


def subtitle_files(bodies: DataFrame, kind: str, model: str | None = None) -> DataFrame:
    """SNK-2 / SNK-3: ``<video>.srt`` or ``<video>.vtt`` of (video_id, body)."""
    return bodies.select(_file(text.video_label(bodies), f".{kind}", folder=_own_folder(bodies, model)).alias("name"), "body")


def clips_files(clips: DataFrame, model: str | None = None, videos: DataFrame | None = None) -> DataFrame:
    """SNK-4: ``<video>.clips.csv`` with header ``start,end,text``; with ``videos``, those without clips have the header alone."""
    line = F.concat(F.to_csv(F.struct("start", "end", "text"), {"escape": '"', "emptyValue": "", "nullValue": "",
                                                                "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}), F.lit("\r\n"))
    bodies = ordered_concat(clips, ["video_id"], "pos", line, "", "_lines")
    if videos is not None:
        bodies = join_on(videos.select("video_id").distinct(), bodies, ["video_id"], "left")
    body = F.concat(F.lit("start,end,text\r\n"), F.coalesce("_lines", F.lit("")))
    return bodies.select(_file(text.video_label(bodies), ".clips.csv", folder=_own_folder(bodies, model)).alias("name"), body.alias("body"))


def transcript_files(segs: DataFrame, model: str | None = None, videos: DataFrame | None = None,
                     languages: DataFrame | None = None) -> DataFrame:
    """SNK-1 … SNK-4: the four files of every transcript, in ``<video>/<model>/`` where the speech model is named."""
    return (aligned_files(aligned_documents(segs, languages), model)
            .unionAll(subtitle_files(captions.srt_body(segs, videos), "srt", model))
            .unionAll(subtitle_files(captions.vtt_body(segs, videos), "vtt", model))
            .unionAll(clips_files(captions.clips(segs), model, videos)))


def prompts_files(docs: DataFrame, folders: bool = False) -> DataFrame:
    """SNK-5: ``<video>_prompts.json``; with ``folders`` (SNK-7) below ``<video>/<model>/``, for several models a video."""
    folder = (F.col("video_name"), F.col("model")) if folders else ()
    return docs.select(_file(F.col("video_name"), "_prompts.json", folder=folder).alias("name"), F.to_json(F.struct(*docs.columns)).alias("body"))


def manifest_files(manifest: DataFrame) -> DataFrame:
    """SNK-6 / SNK-7: ``<video>/metadata.json``."""
    fields = [c for c in manifest.columns if c != "video_id"]
    return manifest.select(_file(F.lit("metadata.json"), folder=(F.col("video_name"),)).alias("name"), F.to_json(F.struct(*fields)).alias("body"))


def text_files(bodies: DataFrame, key: str = "video_id") -> DataFrame:
    """Body per key as the single text row ``value``; the text writer adds one newline, so drop one."""
    return bodies.select(key, F.regexp_replace("body", r"\n\z", "").alias("value"))


def write_subtitles(bodies: DataFrame, path: str, key: str = "video_id") -> None:
    """SNK-2 / SNK-3: one SRT or VTT file per video (``<path>/<key>=<id>/part-*.txt``)."""
    _writer(text_files(bodies, key), [key]).text(path)


def write_subtitle_chunks(chunks: DataFrame, path: str, key: str = "video_id") -> None:
    """SNK-2/3 for unbounded videos: ``ordered_chunks`` output written in order, one part file per range.

    Range partitioning on ``(key, block)`` keeps a video's chunks contiguous and
    ordered across part files; no task holds a whole document. Subtitle chunks
    end with a blank line, so one newline is dropped per chunk and the text
    writer puts it back.
    """
    out = chunks.repartitionByRange(key, "block").sortWithinPartitions(key, "block").select(
        key, F.regexp_replace("chunk", r"\n\z", "").alias("value"))
    _writer(out, [key]).text(path)


def write_clips_csv(clips: DataFrame, path: str, key: str = "video_id") -> None:
    """SNK-4: clips CSV with header ``start,end,text`` per video; quotes escaped by doubling."""
    # Range partitioning keeps each file's rows contiguous in list order and
    # splits a very long video over several part files instead of one task.
    out = (clips.select(key, "pos", "start", "end", "text").repartitionByRange(key, "pos")
                .sortWithinPartitions(key, "pos").drop("pos"))
    (_writer(out, [key]).option("header", "true").option("escape", '"').option("quoteAll", "false")
                        .csv(path))


def prompts_documents(sections: DataFrame, language: str | None = None, generated_at: str | None = None,
                      transcript_dir: str = "outputs", answers: DataFrame | None = None,
                      languages: DataFrame | None = None) -> DataFrame:
    """DM-12 per video and backend from parsed sections (SNK-5 input).

    The language of a video is ``language`` where given, else that of
    ``languages`` (``video_id, language``), else the default.
    ``generated_at`` is a parameter (a clock reading is not reproducible).
    With ``answers`` (``video_id, backend, model`` and optionally ``status``),
    every answer that did not end in ``error`` gets a document, so an answer
    with an empty ``sections`` list still writes one with ``num_sections = 0``.
    """
    answered = sections.filter(F.col("status") != "error")
    s = answered.filter(F.col("section_index").isNotNull())
    fields = ["start_time", "end_time", "transcript_text", "image_prompt", "sentiment", "scene_description",
              "visual_style"]
    keys = ["video_id", "backend", "model"]
    g = ordered_collect(s, keys, "section_index", F.struct(*fields), "_s")
    a = answered.select(*keys)                           # an answer with an empty list has a row without an index
    if answers is not None:
        more = answers.filter(F.col("status") != "error") if "status" in answers.columns else answers
        a = a.unionByName(more.select(*keys))
    g = join_on(a.distinct(), g, keys, "left")
    g = g.withColumn("_s", F.coalesce("_s", F.array().cast(s.select(F.array(F.struct(*fields))).schema[0].dataType)))
    if languages is not None:
        own = languages.groupBy("video_id").agg(F.min("language").alias("_language"))
        g = join_on(g, own, ["video_id"], "left")
    else:
        g = g.withColumn("_language", F.lit(None).cast("string"))
    name = text.video_label(g)
    return g.select(
        name.alias("video_name"),
        F.concat_ws("/", F.lit(transcript_dir), F.concat(name, F.lit(".aligned.json"))).alias("transcript_file"),
        "model", F.lit(generated_at).cast("string").alias("generated_at"),
        F.coalesce(F.lit(language).cast("string"), F.col("_language"), F.lit(FV.DEFAULT_LANGUAGE)).alias("language"),
        F.size("_s").cast("bigint").alias("num_sections"),
        F.col("_s").alias("sections"),
    )


def write_prompts(docs: DataFrame, path: str) -> None:
    """SNK-5 / SNK-7: prompts documents laid out as ``<path>/video=<v>/by=<model>/``; the body keeps both names."""
    _writer(docs.withColumns({"video": F.col("video_name"), "by": F.col("model")}), ["video", "by"]).json(path, encoding="UTF-8")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """SNK-6 / SNK-7: image manifests laid out as ``<path>/video=<v>/``; the body keeps the name."""
    _writer(manifest.drop("video_id").withColumn("video", F.col("video_name")), ["video"]).json(path, encoding="UTF-8")
