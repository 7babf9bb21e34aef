"""File sources: transcript and prompt documents, artefact inventories, URL lists.

(SRC-1, SRC-2, SRC-3, SRC-5, SRC-6.) Every reader takes an explicit schema (no
inference pass over the data), a glob and optional recursive lookup, and
derives names from ``_metadata`` rather than from driver-side listings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelflow import fixed_values as FV
from reelflow.functions import text
from reelflow.schemas import ALIGNED_TRANSCRIPT, IMAGE_MANIFEST, PROMPTS_DOCUMENT, SECTION, SEGMENT


def _documents(spark: SparkSession, path: str, schema, layout: str, glob: str | None, recursive: bool) -> DataFrame:
    """JSON documents: ``layout`` "files" has one document per file, "table" is what our writers make, one a line."""
    if layout not in ("files", "table"):
        raise ValueError(f"unknown layout: {layout}")
    if layout == "table":
        return spark.read.schema(schema).json(path)
    return _found(spark, lambda: _reader(spark, glob, recursive).schema(schema).option("multiLine", "true").json(path), path, glob)


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
FILES_A_TASK = 1024


def _tasks(spark: SparkSession) -> int:
    return 4 * spark.sparkContext.defaultParallelism


def _listed(spark: SparkSession, read: Callable[[], DataFrame]) -> DataFrame:
    """``read()``, whose folders are listed by a few tasks for each core, not by one task for each folder."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), _tasks(spark))))
    try:
        return read()
    finally:
        spark.conf.set(LISTING, before)


def _found(spark: SparkSession, read: Callable[[], DataFrame], path: str, glob: str | None) -> DataFrame:
    """``read()``, or an error where no file matches: a wrong folder, name or layout would else read as no rows."""
    df = _listed(spark, read)
    if not _count(df):
        raise FileNotFoundError(f"no file below {path} matches {glob or '*'} (tables that the writers make need layout='table')")
    return df


def _count(df: DataFrame) -> int:
    """How many files ``df`` reads; the names stay in the JVM, as ``inputFiles`` asks for them one by one."""
    return len(df._jdf.inputFiles())


def _in_tasks(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` of the small files ``found`` in at least a few tasks for each core and at most ``FILES_A_TASK`` files in one.

    Spark plans 32 small files a task, so a folder of many would cost more in tasks than in files.
    """
    return rows.coalesce(max(_tasks(rows.sparkSession), -(-_count(found) // FILES_A_TASK)))


def _reader(spark: SparkSession, glob: str | None, recursive: bool):
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r


def read_transcripts(spark: SparkSession, path: str, glob: str | None = "*.aligned.json",
                     recursive: bool = True, layout: str = "files") -> DataFrame:
    """SRC-1/SRC-3: aligned transcript documents → ``(video_id, transcript_file, language, segments)``.

    ``video_id`` is the video's name: the one in the body where a document has
    one (``layout="table"``), else the file stem without ``.aligned``; missing
    ``language`` → ``en``, missing ``segments`` → ``[]``.
    """
    named = T.StructType([T.StructField("video_name", T.StringType()), *ALIGNED_TRANSCRIPT.fields])
    df = _documents(spark, path, named, layout, glob, recursive)
    rows = df.select(
        F.coalesce("video_name", text.video_name(F.col("_metadata.file_name"))).alias("video_id"),
        F.col("_metadata.file_path").alias("transcript_file"),
        F.coalesce("language", F.lit(FV.DEFAULT_LANGUAGE)).alias("language"),
        F.coalesce("segments", F.array().cast(T.ArrayType(SEGMENT))).alias("segments"),
    )
    return rows if layout == "table" else _in_tasks(rows, df)


def read_prompts(spark: SparkSession, path: str, glob: str | None = "*_prompts.json",
                 recursive: bool = True, layout: str = "files") -> DataFrame:
    """SRC-2: prompts documents; missing ``video_name`` → ``video``, missing ``sections`` → ``[]``."""
    df = _documents(spark, path, PROMPTS_DOCUMENT, layout, glob, recursive)
    empty = F.array().cast(T.ArrayType(SECTION))
    rows = df.select(
        F.coalesce("video_name", F.lit(FV.DEFAULT_VIDEO_NAME)).alias("video_name"),
        F.col("_metadata.file_path").alias("prompts_file"),
        "model", "language", F.coalesce("sections", empty).alias("sections"),
    )
    return rows if layout == "table" else _in_tasks(rows, df)


def read_manifests(spark: SparkSession, path: str, glob: str | None = "metadata.json", recursive: bool = True,
                   layout: str = "files") -> DataFrame:
    """Image manifests as they were written (DM-16)."""
    df = _documents(spark, path, IMAGE_MANIFEST, layout, glob, recursive)
    return df if layout == "table" else _in_tasks(df, df)


def read_subtitles(spark: SparkSession, path: str, glob: str | None = "*.{srt,vtt}", recursive: bool = True) -> DataFrame:
    """Subtitle files, whole: ``(video_id, kind, body)`` with the file stem as the video.

    Spark's readers pass over files of no bytes, so the SRT of a transcript without segments gives no row.
    """
    df = _found(spark, lambda: _reader(spark, glob, recursive).text(path, wholetext=True), path, glob)
    name = F.col("_metadata.file_name")
    return _in_tasks(df.select(text.video_name(name).alias("video_id"), F.regexp_extract(name, r"([^.]+)$", 1).alias("kind"),
                               F.col("value").alias("body")), df)


def read_clips(spark: SparkSession, path: str, glob: str | None = "*.clips.csv", recursive: bool = True) -> DataFrame:
    """Clips files: ``(video_id, start, end, text)``."""
    reader = _reader(spark, glob, recursive).option("header", True).option("multiLine", True).option("escape", '"')
    df = _found(spark, lambda: reader.schema("start double, end double, text string").csv(path), path, glob)
    return _in_tasks(df.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.clips\.csv$", "").alias("video_id"), "start", "end",
                               F.coalesce("text", F.lit("")).alias("text")), df)


def read_inventory(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """SRC-5: files already present → ``(key, path, length)``; file contents are never read.

    ``key`` is the file name; only ``path`` and ``length`` are selected, so the
    binary-file scan prunes the ``content`` column.
    """
    df = _listed(spark, lambda: _reader(spark, glob, recursive).format("binaryFile").load(path)).select("path", "length")
    return _in_tasks(df.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("key"), "path", "length"), df)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: one URL per line; blank lines skipped → ``(request_id, url)``.

    The id is Spark's partition-position id, stable when a task is re-run on
    the same input splits.
    """
    lines = spark.read.text(path)
    return (lines.select(text.py_strip("value").alias("url")).filter(F.length("url") > 0)
                 .select(F.monotonically_increasing_id().alias("request_id"), "url"))


SCHEMAS = {"aligned_transcript": ALIGNED_TRANSCRIPT, "prompts_document": PROMPTS_DOCUMENT, "section": SECTION}
