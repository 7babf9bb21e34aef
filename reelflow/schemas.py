"""Explicit schemas for every document the pipeline reads or writes."""

from pyspark.sql import types as T

WORD = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("start", T.DoubleType()),
    T.StructField("end", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
])

SEGMENT = T.StructType([
    T.StructField("start", T.DoubleType()),
    T.StructField("end", T.DoubleType()),
    T.StructField("text", T.StringType()),
    T.StructField("words", T.ArrayType(WORD)),
])

# DM-6: aligned transcript document
ALIGNED_TRANSCRIPT = T.StructType([
    T.StructField("language", T.StringType()),
    T.StructField("segments", T.ArrayType(SEGMENT)),
])

# DM-11: one section of a prompts document
SECTION = T.StructType([
    T.StructField("start_time", T.DoubleType()),
    T.StructField("end_time", T.DoubleType()),
    T.StructField("transcript_text", T.StringType()),
    T.StructField("image_prompt", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("scene_description", T.StringType()),
    T.StructField("visual_style", T.StringType()),
])
SECTION_DDL = ("start_time DOUBLE, end_time DOUBLE, transcript_text STRING, image_prompt STRING, "
               "sentiment STRING, scene_description STRING, visual_style STRING")

# DM-12: prompts document
PROMPTS_DOCUMENT = T.StructType([
    T.StructField("video_name", T.StringType()),
    T.StructField("transcript_file", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("generated_at", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("num_sections", T.LongType()),
    T.StructField("sections", T.ArrayType(SECTION)),
])

# DM-15: image record, one wide schema for the three backends
IMAGE_RECORD = T.StructType([
    T.StructField("image_path", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("section_index", T.IntegerType()),
    T.StructField("revised_prompt", T.StringType()),
    T.StructField("seed", T.LongType()),
])

# DM-16: image manifest
IMAGE_MANIFEST = T.StructType([
    T.StructField("video_name", T.StringType()),
    T.StructField("prompts_file", T.StringType()),
    T.StructField("output_dir", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("backend", T.StringType()),
    T.StructField("device", T.StringType()),
    T.StructField("num_images", T.LongType()),
    T.StructField("generated_at", T.StringType()),
    T.StructField("settings", T.MapType(T.StringType(), T.StringType())),
    T.StructField("images", T.ArrayType(IMAGE_RECORD)),
])

# DM-4: batch result
BATCH_RESULT = T.StructType([
    T.StructField("successful", T.ArrayType(T.StringType())),
    T.StructField("failed", T.ArrayType(T.StringType())),
])
