"""Derived views that give the driver tables the pipeline's shapes.

Each view is a deterministic DataFrame over a driver table, so its size grows
with the table. The same definitions exist as SQL for the DuckDB twin in
``reelflow.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelflow import fixed_values as FV
from reelflow.operators.blocked import running_sum
from reelflow.sources.stage import stage_path, stage_table
from reelflow.sources.tables import table


def _path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def segments(spark: SparkSession, sf_dir: str, staged: bool = True) -> DataFrame:
    """Transcript segments ``(video_id, pos, role, text, start_s, end_s)``.

    video = conversation, segment = turn; each turn lasts 60 ms per character
    and is followed by a 200 ms or 1.5 s pause. Even turns carry padding so
    strip semantics are exercised. The result is the transcription stage's
    output, so it is written once as a stage table (see ``stage_table``).
    """
    if staged:
        return spark.read.parquet(segments_path(spark, sf_dir))
    conv = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    base = conv.select(
        F.col("conv_id").alias("video_id"),
        F.col("turn").cast("int").alias("pos"),
        "role",
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("  "), F.col("text"), F.lit(" ")))
         .otherwise(F.col("text")).alias("text"),
        (F.lit(60) * F.length("text")).alias("dur"),
        F.when(F.col("turn") % 3 == 2, F.lit(1500)).otherwise(F.lit(200)).alias("gap"),
    )
    cum = running_sum(base, ["video_id"], "pos", F.col("dur") + F.col("gap"), "cum")
    return cum.select(
        "video_id", "pos", "role", "text",
        ((F.col("cum") - F.col("dur") - F.col("gap")).cast("double") / 1000).alias("start_s"),
        ((F.col("cum") - F.col("gap")).cast("double") / 1000).alias("end_s"),
    )


def segments_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the staged segments table (the transcription stage's output files)."""
    return stage_path(spark, "segments", [_path(sf_dir, "conversations")],
                      lambda: segments(spark, sf_dir, staged=False))


def sparse_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments with list positions that start late and have gaps, as after removals; no row is left out."""
    return segments(spark, sf_dir).withColumn("pos", (F.col("pos") * 3 + 100).cast("int"))


def arriving_segments_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of segments that say how many their transcript has, as a finished transcription reports them."""
    def build() -> DataFrame:
        s = segments(spark, sf_dir)
        return s.join(s.groupBy("video_id").agg(F.count("*").alias("transcript_segments")), "video_id")

    return stage_path(spark, "arriving_segments", [_path(sf_dir, "conversations")], build)


GENERATED = 1_000_000_000     # request ids of the generated forms start here


def _vid(page_id):
    """Three pages in a row ask for the same video."""
    return F.concat(F.lit("vid_"), F.lpad(F.floor(page_id / 3).cast("string"), 5, "0"))


def request_url(page_id):
    """One of eight forms of a video address."""
    vid = _vid(page_id)
    k = page_id % 8
    return (F.when(k == 0, F.concat(F.lit("https://youtu.be/"), vid, F.lit("?si=q7&t=95")))
             .when(k == 1, F.concat(F.lit("https://www.youtube.com/watch?list=PLx9&v="), vid, F.lit("&index=3")))
             .when(k == 2, F.concat(F.lit("http://www.youtube.com/shorts/"), vid, F.lit("/?cbrd=1")))
             .when(k == 3, F.concat(F.lit("https://music.youtube.com/watch?v="), vid))
             .when(k == 4, F.concat(F.lit("https://youtube.com/shorts/"), vid))
             .when(k == 5, F.lit("https://www.youtube.com/shorts/abcd"))
             .when(k == 6, F.concat(F.lit("https://m.youtube.com/x?a=1&v="), vid, F.lit("%")))
             .otherwise(F.concat(F.lit("https://www.youtube.com/embed?v="), vid, F.lit("%zz&b=2"))))


def request_rows(pages: DataFrame) -> DataFrame:
    """Two URL requests a page, batch or stream: the page's own URL, and a video address in one of eight forms."""
    own = F.struct(F.col("page_id").alias("request_id"), F.col("url"))
    form = F.struct((F.col("page_id") + GENERATED).alias("request_id"), request_url(F.col("page_id")).alias("url"))
    return pages.select(F.inline(F.array(own, form)))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL requests ``(request_id, url)``."""
    return request_rows(table(spark, sf_dir, "pages", "page_id", "url"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artefacts already present, keyed by canonical URL.

    The fixture's definition (FIXTURES.md): three of every ten videos have been
    downloaded. This states which work is already done; it does not sample the
    input — every query still reads all pages.
    """
    p = table(spark, sf_dir, "pages", "page_id")
    return (p.filter(F.floor(F.col("page_id") / 3) % 10 < 3)
             .select(F.concat(F.lit("https://www.youtube.com/watch?v="), _vid(F.col("page_id"))).alias("key"))
             .distinct())


def finished(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Transcripts and sections made so far: no transcript for every fifth video, no sections for every seventh."""
    segs, secs = segments(spark, sf_dir), sections(spark, sf_dir)
    has = F.col("video_id") % 5 != 0
    return segs.filter(has), secs.filter(has & (F.col("video_id") % 7 != 0))


def flawed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments with missing fields, answers and image results with unknown or missing backends; no row is left out."""
    segs, k = segments(spark, sf_dir), F.col("video_id") + F.col("pos")
    segs = segs.withColumns({"start_s": F.when(k % 11 != 0, F.col("start_s")), "end_s": F.when(k % 13 != 0, F.col("end_s")),
                             "text": F.when(k % 17 != 0, F.col("text"))})
    answers, v = llm_responses(spark, sf_dir), F.col("video_id")
    answers = answers.withColumn("backend", F.when(v % 6 == 1, "gemini").when(v % 6 == 2, None).otherwise(F.col("backend")))
    results, i = image_results(spark, sf_dir), F.col("video_id") + F.col("section_index")
    return segs, answers, results.withColumn("backend", F.when(i % 9 == 4, "midjourney").otherwise(F.col("backend")))


def crowded_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections with start times on whole minutes, so that many frames share a time and a file name."""
    return sections(spark, sf_dir).withColumn("start_time", F.floor(F.col("start_time") / 60).cast("double") * 60)


def image_events_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of image results as they finish: each video starts a minute after the one before it."""
    def build() -> DataFrame:
        micros = F.col("video_id") * 60_000_000 + F.round(F.col("timestamp_s") * 1000).cast("bigint") * 1000
        return image_results(spark, sf_dir).select("video_id", "section_index", "backend", "status_code",
                                                   F.timestamp_micros(micros).alias("finished_at"))

    return stage_path(spark, "image_events", [_path(sf_dir, "conversations")], build)


def sections(spark: SparkSession, sf_dir: str, segs: DataFrame | None = None, staged: bool = True) -> DataFrame:
    """Prompt sections: every three segments form one scene (a stage table, like ``segments``)."""
    if staged and segs is None:
        return stage_table(spark, "sections", [_path(sf_dir, "conversations")],
                           lambda: sections(spark, sf_dir, staged=False))
    segs = segments(spark, sf_dir) if segs is None else segs
    g = (segs.groupBy("video_id", F.floor(F.col("pos") / 3).cast("int").alias("section_index"))
             .agg(F.min("start_s").alias("start_time"), F.max("end_s").alias("end_time")))
    vs = F.col("video_id") + F.col("section_index")
    return g.select(
        "video_id", "section_index", "start_time", "end_time",
        F.when(vs % 11 == 0, F.repeat(F.lit("x"), 4100))
         .otherwise(F.concat(F.lit("Scene "), F.col("section_index").cast("string"), F.lit(" of video "),
                             F.col("video_id").cast("string"))).alias("image_prompt"),
        F.when(F.col("video_id") % 3 == 0, "positive").when(F.col("video_id") % 3 == 1, "neutral")
         .otherwise("negative").alias("sentiment"),
        F.when(vs % 4 == 0, "cinematic").when(vs % 4 == 1, "realistic").when(vs % 4 == 2, "")
         .alias("visual_style"),
    )


def image_results(spark: SparkSession, sf_dir: str, secs: DataFrame | None = None) -> DataFrame:
    """One generation attempt per section, as the three image backends report it."""
    secs = sections(spark, sf_dir) if secs is None else secs
    v, i = F.col("video_id"), F.col("section_index")
    return secs.select(
        "video_id", "section_index", F.col("start_time").alias("timestamp_s"),
        F.when(v % 3 == 0, "diffusers").when(v % 3 == 1, "openai").otherwise("stability").alias("backend"),
        F.when((v * 7 + i) % 5 == 0, 429).otherwise(200).alias("status_code"),
        F.when(v % 3 == 2, v * 1000 + i).alias("seed"),
        F.when(i % 3 == 0, "aGVsbG8=").when(i % 3 == 1, "d29ybGQ=").otherwise("***").alias("image_b64"),
    )


def llm_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model answers in thirteen shapes across the three text backends.

    The sections hold the conversation's own first text. Each conversation also
    has an answer, without JSON, for a video that has no transcript.
    """
    conv = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    said = conv.groupBy(F.col("conv_id").alias("video_id")).agg(F.min_by("text", "turn").alias("said"))
    item = F.to_json(F.struct(F.lit(0.0).alias("start_time"), F.lit(1.5).alias("end_time"), F.col("said").alias("transcript_text"),
                              F.concat(F.lit("p"), F.col("video_id").cast("string")).alias("image_prompt"),
                              F.lit("neutral").alias("sentiment"), F.lit("cinematic").alias("visual_style")))
    arr = F.concat(F.lit("["), item, F.lit("]"))
    body = F.concat(F.lit('{"sections": '), arr, F.lit("}"))
    v = F.col("video_id")
    k = v % 13
    nl = F.lit("\n")
    content = (F.when(k == 0, body).when(k == 1, arr)
                .when(k == 2, F.concat(F.lit("Here:"), nl, F.lit("```json"), nl, body, nl, F.lit("```"), nl,
                                       F.lit("Done.")))
                .when(k == 3, F.concat(F.lit("```"), nl, body, nl, F.lit("```")))
                .when(k == 4, F.concat(F.lit("Sure! "), body, nl, F.lit("Anything else?")))
                .when(k == 5, F.concat(body, F.lit(" junk")))
                .when(k == 6, F.lit("not json"))
                .when(k == 7, F.lit('{"title": "x"}'))
                .when(k == 8, F.lit('{"sections": null}'))
                .when(k == 9, F.concat(F.lit("["), item, F.lit(', "oops", '), item, F.lit("]")))
                .when(k == 10, F.lit('{"sections": "[1]"}'))
                .when(k == 11, F.lit("[1, 2]"))
                .otherwise(F.lit('{"sections": []}')))
    b = F.floor(v / 9).cast("int") % 3
    backend = F.when(b == 0, "openai").when(b == 1, "anthropic").otherwise("ollama")
    answers = said.select("video_id", backend.alias("backend"), content.alias("content"))
    return answers.unionByName(answers.select((v + 1_000_000_000).alias("video_id"), "backend", F.lit("not json").alias("content")))


def chain_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of two text backends for every video, whose sections hold the scenes with their segments' real text."""
    segs = segments(spark, sf_dir)
    scenes = segs.groupBy("video_id", F.floor(F.col("pos") / 3).cast("int").alias("scene")).agg(
        F.min("start_s").alias("start_time"), F.max("end_s").alias("end_time"), F.min_by("text", "pos").alias("transcript_text"))
    item = F.struct("scene", F.col("start_time"), F.col("end_time"), F.col("transcript_text"),
                    F.concat(F.lit("Scene "), F.col("scene").cast("string"), F.lit(" "), F.col("transcript_text")).alias("image_prompt"),
                    F.lit("neutral").alias("sentiment"), F.lit("cinematic").alias("visual_style"))
    lists = scenes.groupBy("video_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("scene"))).alias("list"))
    openai = lists.select("video_id", F.lit("openai").alias("backend"), F.concat(F.lit('{"sections": '), "list", F.lit("}")).alias("content"))
    anthropic = lists.select("video_id", F.lit("anthropic").alias("backend"), F.concat(F.lit("```json\n"), "list", F.lit("\n```")).alias("content"))
    return openai.unionByName(anthropic)


# Model names a batch may ask for: the catalogue plus two unknown names.
REQUESTABLE = [m[0] for m in FV.SPEECH_MODELS] + ["large", "turbo"]


def model_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One download batch per customer: ``(batch_id, all_models, force, free_gb)``.

    ``all_models`` marks a batch that passed no list (meaning every catalogue
    model); ``free_gb`` is NULL when free space could not be measured.
    """
    c = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    k = F.col("c_custkey")
    return c.select(
        k.alias("batch_id"),
        (k % 10 == 0).alias("all_models"),
        (k % 3 == 0).alias("force"),
        F.when(k % 11 == 0, F.lit(None).cast("double"))
         .otherwise(F.abs(F.col("c_acctbal")) / 1000).alias("free_gb"),
    )


def model_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each download returned, ``(batch_id, pos, ok)``: one in four fails, some report nothing."""
    c = table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("batch_id"), F.explode(
        F.sequence(F.lit(0), F.lit(len(REQUESTABLE) - 1))).alias("pos"))
    k = F.col("batch_id") + F.col("pos")
    return c.select("batch_id", "pos", F.when(k % 9 != 0, k % 4 != 0).alias("ok")).filter(F.col("ok").isNotNull())


def model_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit name lists ``(batch_id, pos, name)``: 0–3 names per customer."""
    c = table(spark, sf_dir, "customer", "c_custkey")
    k = F.col("c_custkey")
    n = (k % 4).cast("int")
    names = F.array(*[F.lit(x) for x in REQUESTABLE])
    return (c.filter(k % 10 != 0)
             .select(k.alias("batch_id"), F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("pos"),
                     n.alias("_n"))
             .filter(F.col("pos") < F.col("_n"))
             .select("batch_id", "pos",
                     F.element_at(names, ((F.col("batch_id") + 2 * F.col("pos")) % len(REQUESTABLE) + 1).cast("int"))
                      .alias("name")))


def document_segments(spark: SparkSession, sf_dir: str, staged: bool = True) -> DataFrame:
    """Long transcripts: every document line is one segment (whole texts, no prefix).

    ``(video_id, pos, text, start_s, end_s)`` with ``video_id = doc_id``; each
    line lasts 60 ms per character followed by a 200 ms pause.
    """
    if staged:
        return stage_table(spark, "document_segments", [_path(sf_dir, "documents")],
                           lambda: document_segments(spark, sf_dir, staged=False))
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    lines = d.select(F.col("doc_id").alias("video_id"),
                     F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    base = lines.select("video_id", F.col("pos").cast("int").alias("pos"), "text",
                        (F.lit(60) * F.length("text")).alias("dur"), F.lit(200).alias("gap"))
    cum = running_sum(base, ["video_id"], "pos", F.col("dur") + F.col("gap"), "cum")
    return cum.select(
        "video_id", "pos", "text",
        ((F.col("cum") - F.col("dur") - F.col("gap")).cast("double") / 1000).alias("start_s"),
        ((F.col("cum") - F.col("gap")).cast("double") / 1000).alias("end_s"),
    )


def document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected language per long transcript: ``(video_id, language)``."""
    return table(spark, sf_dir, "documents", "doc_id", "lang").select(
        F.col("doc_id").alias("video_id"), F.col("lang").alias("language"))
