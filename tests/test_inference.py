"""Pluggable generators: registry errors, lazy init, per-row isolation."""

import pytest

from reelflow.operators import inference


def test_unknown_generator_fails_on_driver(spark):
    df = spark.createDataFrame([(1, "openai", "m", "p")], "video_id long, backend string, model string, prompt string")
    with pytest.raises(ValueError):
        inference.generate_text(df, "nope")


def test_row_failures_are_isolated(spark):
    df = spark.createDataFrame([(i, "openai", "m", "x" * i) for i in range(1, 21)],
                               "video_id long, backend string, model string, prompt string")
    out = {r.video_id: r for r in inference.generate_text(df, "stub").collect()}
    assert out[7].status == "error" and "unavailable" in out[7].error and out[7].content is None
    assert out[8].status == "ok" and '"n_chars": 8' in out[8].content
    assert sum(r.status == "error" for r in out.values()) == 2


def test_predict_batch_udf_form(spark):
    udf = inference.text_udf("stub")
    if udf is None:
        pytest.skip("pyspark.ml not importable")
    df = spark.createDataFrame([(i, "x" * i) for i in range(1, 13)], "video_id long, prompt string")
    out = {r.video_id: r.content for r in df.withColumn("content", udf("video_id", "prompt")).collect()}
    assert out[7] is None and '"n_chars": 8' in out[8]


def test_named_videos_keep_their_names(spark):
    udf = inference.text_udf("stub")
    if udf is None:
        pytest.skip("pyspark.ml not importable")
    df = spark.createDataFrame([("talk", "x"), ("7", "yy")], "video_id string, prompt string")
    out = {r.video_id: r.content for r in df.withColumn("content", udf("video_id", "prompt")).collect()}
    assert '"stub talk"' in out["talk"] and '"n_chars": 2' in out["7"]


def test_callers_do_not_depend_on_earlier_partitions(spark):
    df = spark.createDataFrame([(i, "openai", "m", "x") for i in range(1, 7)],
                               "video_id long, backend string, model string, prompt string").coalesce(1)
    out = inference.generate_text(df, "stub", num_partitions=3)
    assert out.rdd.getNumPartitions() == 3 and out.count() == 6
