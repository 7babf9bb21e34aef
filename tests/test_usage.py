"""End to end through the public API, as in the README's Usage section: files in, files out."""

import glob
import json
import os

from pyspark.sql import functions as F


def test_end_to_end_from_transcript_files(spark, tmpdir_fresh):
    from reelflow.operators import captions, images, inference, prompts, responses, timeline
    from reelflow.sinks import writers
    from reelflow.sources import files

    src = os.path.join(tmpdir_fresh, "transcripts")
    os.makedirs(src)
    for name, lang, segs in [
        ("talk", "en", [(0.0, 2.5, " Hello there. "), (3.0, 5.5, "Second line"), (7.5, 9.0, "After a pause")]),
        ("empty", None, []),
    ]:
        doc = {"segments": [{"start": s, "end": e, "text": t} for s, e, t in segs]}
        if lang:
            doc["language"] = lang
        with open(os.path.join(src, f"{name}.aligned.json"), "w", encoding="utf-8") as f:
            json.dump(doc, f)
    out = os.path.join(tmpdir_fresh, "out")

    # --- transcripts → captions (Entry D)
    docs = files.read_transcripts(spark, src)
    segs = timeline.explode_segments(docs)
    videos = docs.select("video_id")
    writers.write_subtitles(captions.srt_body(segs, videos), os.path.join(out, "srt"))
    writers.write_subtitles(captions.vtt_body(segs, videos), os.path.join(out, "vtt"))
    writers.write_clips_csv(captions.clips(segs), os.path.join(out, "clips"))

    # --- transcripts → model requests → answers → sections (Entry B)
    reqs = prompts.llm_requests(segs, languages=docs.select("video_id", "language"),
                                backend=F.lit("openai"), videos=videos)
    answers = inference.generate_text(reqs, "stub", fail_mod=1000, fail_rest=999)
    sections = responses.parsed_sections(answers.select("video_id", "backend", "content"), segs)
    prompt_docs = writers.prompts_documents(sections, generated_at="2026-01-01T00:00:00")
    writers.write_prompts(prompt_docs, os.path.join(out, "prompts"))

    # --- sections → image requests → results → manifest (Entry C)
    secs = sections.filter(F.col("section_index").isNotNull()).select(
        "video_id", "section_index", "start_time", "end_time", "image_prompt", "visual_style")
    img = inference.generate_images(images.image_requests(secs, backend=F.lit("diffusers")), "stub")
    results = img.select("video_id", "section_index", F.col("timestamp").alias("timestamp_s"), "backend",
                         F.when(F.col("status") == "ok", 200).otherwise(500).alias("status_code"), "seed")
    writers.write_manifest(images.manifest(secs, results, generated_at="2026-01-01T00:00:00"),
                           os.path.join(out, "manifest"))

    srt = "".join(open(p, encoding="utf-8").read() for p in glob.glob(os.path.join(out, "srt", "video_id=talk", "*")))
    assert srt.startswith("1\n00:00:00,000 --> 00:00:02,500\nHello there.\n\n2\n")
    vtt_empty = "".join(open(p).read() for p in glob.glob(os.path.join(out, "vtt", "video_id=empty", "*")))
    assert vtt_empty.startswith("WEBVTT")
    req = {r.video_id: r for r in reqs.collect()}
    assert req["talk"].language == "en" and req["empty"].language == "en"
    assert "[3.0s - 5.5s] Second line" in req["talk"].prompt
    got = {r.video_id: r for r in sections.collect()}
    assert got["talk"].status == "parsed" and got["talk"].image_prompt == "stub talk"
    m = spark.read.json(os.path.join(out, "manifest")).collect()
    assert {r.video_name for r in m} == {"talk", "empty"}
    assert glob.glob(os.path.join(out, "prompts", "video=*", "by=*", "*.json"))
