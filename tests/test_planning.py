"""Planning rules: free space, batch results and outcomes, force."""

import pytest
from pyspark.sql import functions as F

from reelflow.operators import images, planning
from reelflow.functions import defaults


def _batches(spark, rows):
    return spark.createDataFrame(rows, "batch_id long, all_models boolean, force boolean, free_gb double")


def _requests(spark, rows):
    return spark.createDataFrame(rows, "batch_id long, pos int, name string")


@pytest.mark.parametrize("free,need,ok", [(50.5, 2.25, True), (1.5, 0.75, False), (4.25, 3.25, True), (4.2, 3.25, False),
                                          (0.0, 0.0, False), (None, 900.0, True)])
def test_free_space_rule(spark, free, need, ok):
    # one batch whose only model has the given size: fake it through a literal catalogue-sized request
    b = _batches(spark, [(1, False, False, free)])
    plan = spark.createDataFrame([(1, 0, "m", need, "download")],
                                 "batch_id long, pos int, name string, size_gb double, action string")
    r = planning.batch_results(b, plan).first()
    assert r.space_ok is ok


def test_batch_results_cases(spark):
    b = _batches(spark, [(1, False, False, None), (2, False, False, None), (3, False, False, None),
                         (4, True, False, None), (5, False, False, 0.5)])
    r = _requests(spark, [(1, 0, "tiny"), (1, 1, "base"), (2, 0, "invalid_model"),
                          (3, 0, "tiny"), (3, 1, "invalid_model"), (5, 0, "tiny")])
    plan = planning.model_plan(spark, b, r)
    res = {x.batch_id: x for x in planning.batch_results(b, plan).collect()}
    assert (res[1].successful, res[1].failed) == (["tiny", "base"], [])
    assert (res[2].successful, res[2].failed) == ([], ["invalid_model"])
    assert (res[3].successful, res[3].failed) == ([], ["tiny", "invalid_model"])      # all or nothing
    assert res[4].successful == ["tiny", "base", "small", "medium", "large-v3"]        # no list = all
    assert res[5].status == "insufficient_space" and res[5].failed == ["tiny"]
    for x in res.values():                                                              # SET-1
        assert not set(x.successful) & set(x.failed)
        assert sorted(x.successful + x.failed) == sorted(
            [p.name for p in plan.filter(F.col("batch_id") == x.batch_id).collect()])
    assert res[4].any_success and not res[3].any_success and res[1].success_rate == 100.0
    skip = {x.batch_id: x.status for x in planning.batch_results(b, plan, skip_space_check=True).collect()}
    assert skip[5] == "ok"


def test_outcomes_split_a_batch(spark):
    b = _batches(spark, [(1, False, False, None), (2, False, False, None), (3, False, False, None)])
    r = _requests(spark, [(1, 0, "tiny"), (1, 1, "base"), (1, 2, "small"), (2, 0, "tiny"), (2, 1, "nope"), (3, 0, "base")])
    present = spark.createDataFrame([("models--Systran--faster-whisper-base",)], "key string")
    told = spark.createDataFrame([(1, 0, False), (1, 1, False), (1, 2, True), (2, 0, True)], "batch_id long, pos int, ok boolean")
    res = {x.batch_id: x for x in planning.batch_results(b, planning.model_plan(spark, b, r, present), outcomes=told).collect()}
    assert (res[1].successful, res[1].failed) == (["base", "small"], ["tiny"])       # base was there, nothing was downloaded
    assert 0 < res[1].success_rate < 100 and res[1].any_success
    assert (res[2].successful, res[2].failed, res[2].any_success) == ([], ["tiny", "nope"], False)
    assert res[3].success_rate == 100.0


def test_force_and_present(spark):
    b = _batches(spark, [(1, False, False, None), (2, False, True, None)])
    r = _requests(spark, [(1, 0, "tiny"), (2, 0, "tiny")])
    present = spark.createDataFrame([("models--Systran--faster-whisper-tiny",)], "key string")
    acts = {x.batch_id: x.action for x in planning.model_plan(spark, b, r, present).collect()}
    assert acts == {1: "skip_existing", 2: "download"}
    canon = spark.createDataFrame([(1, "u1"), (2, "u2")], "request_id long, canonical_url string")
    inv = spark.createDataFrame([("u1",)], "key string")
    assert [x.request_id for x in planning.pending(canon, inv).collect()] == [2]
    assert sorted(x.request_id for x in planning.pending(canon, inv, force=True).collect()) == [1, 2]
    assert planning.done(canon, inv, force=True).count() == 0


def test_language_choice(spark):
    df = spark.createDataFrame([(None, None), ("", "fr"), ("de", "fr"), (None, "")], "forced string, detected string")
    got = [r[0] for r in df.select(defaults.language(F.col("forced"), F.col("detected"))).collect()]
    assert got == ["en", "fr", "de", "en"]


def test_merge_backend_records(spark):
    a = spark.createDataFrame([(1, "p", "rev")], "section_index int, prompt string, revised_prompt string")
    b = spark.createDataFrame([(2, "q", 7)], "section_index int, prompt string, seed long")
    m = {r.section_index: r for r in images.merge_backend_records(a, b).collect()}
    assert m[1].seed is None and m[2].revised_prompt is None and m[2].seed == 7


def test_image_request_overrides(spark):
    secs = spark.createDataFrame([(0, 0, 1.5, "p", "cinematic"), (2, 0, 2.0, "q", "")],
                                 "video_id long, section_index int, start_time double, image_prompt string, "
                                 "visual_style string")
    dflt = {r.video_id: r for r in images.image_requests(secs).collect()}
    assert dflt[0].negative_prompt.endswith("artifacts") and '"num_inference_steps":30' in dflt[0].payload
    o = {r.video_id: r for r in images.image_requests(
        secs, model="m2", negative_prompt="none", overrides={"num_inference_steps": 4, "output_format": "jpeg"}
    ).collect()}
    assert o[0].model == "m2" and o[0].negative_prompt == "none" and '"num_inference_steps":4' in o[0].payload
    assert o[2].frame_file == "frame_00002000.jpeg" and '"output_format":"jpeg"' in o[2].payload


def test_transcript_artefacts(spark):
    from reelflow.operators.summary import transcript_artefacts
    m = spark.createDataFrame([(1, "/in/talk.v2.mp4")], "video_id long, media_file string")
    got = {r.kind: r.path for r in transcript_artefacts(m).collect()}
    assert got == {"aligned_json": "outputs/talk.v2.aligned.json", "srt": "outputs/talk.v2.srt",
                   "vtt": "outputs/talk.v2.vtt", "clips_csv": "outputs/talk.v2.clips.csv",
                   "wav": "outputs/talk.v2_16k.wav"}


def test_unsupported_backends_are_quarantined(spark):
    from reelflow.operators import quality
    resp = spark.createDataFrame([(1, "openai"), (2, "gemini"), (3, None)], "video_id long, backend string")
    res = spark.createDataFrame([(1, 0, "stability", 200), (1, 1, "midjourney", 500)],
                                "video_id long, section_index int, backend string, status_code int")
    segs = spark.createDataFrame([(1, 0, 0.0, 1.0, "x")], "video_id long, pos int, start_s double, end_s double, "
                                                           "text string")
    q = sorted((r.source, r.record_key, r.reason) for r in quality.quarantine(segs, resp, res).collect())
    assert q == [("image_results", "1:1", "http status 500"),
                 ("image_results", "1:1", "unsupported backend: midjourney"),
                 ("llm_responses", "2", "unsupported backend: gemini"),
                 ("llm_responses", "3", "unsupported backend: NULL")]
