"""Sinks write what the sources read back (SNK-1…8, SRC-1…3, SRC-5/6)."""

import csv
import glob
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from reelflow.operators import captions, images, responses
from reelflow.sinks import writers
from reelflow.sources import files, views
from tests.conftest import SF001


def test_aligned_json_roundtrip(spark, tmpdir_fresh):
    segs = views.segments(spark, SF001)
    docs = writers.aligned_documents(segs)
    out = os.path.join(tempfile.mkdtemp(prefix="reelflow-test-"), "aligned")
    # one document per file, named like the original tool's output
    for r in docs.orderBy("video_id").limit(3).collect():
        with open(os.path.join(tmpdir_fresh, f"v{r.video_id}.aligned.json"), "w", encoding="utf-8") as f:
            json.dump({"language": r.language,
                       "segments": [{"start": s.start, "end": s.end, "text": s.text} for s in r.segments]},
                      f, ensure_ascii=False, indent=2)
    writers.write_aligned_json(docs, out)
    back = files.read_transcripts(spark, tmpdir_fresh, recursive=False)
    assert sorted(r.video_id for r in back.collect()) == sorted(f"v{r.video_id}" for r in
                                                                docs.orderBy("video_id").limit(3).collect())
    from reelflow.operators.timeline import explode_segments
    seg_back = explode_segments(back)
    assert seg_back.count() == segs.filter(F.col("video_id").isin(
        [r.video_id for r in docs.orderBy("video_id").limit(3).collect()])).count()
    lines = spark.read.json(out)
    assert lines.count() == docs.count()


def test_missing_keys_get_defaults(spark, tmpdir_fresh):
    with open(os.path.join(tmpdir_fresh, "empty.aligned.json"), "w") as f:
        f.write("{}")
    r = files.read_transcripts(spark, tmpdir_fresh).collect()
    assert r[0].video_id == "empty" and r[0].language == "en" and r[0].segments == []
    with open(os.path.join(tmpdir_fresh, "x_prompts.json"), "w") as f:
        f.write('{"model": "m"}')
    p = files.read_prompts(spark, tmpdir_fresh).collect()
    assert p[0].video_name == "video" and p[0].sections == []


def test_subtitle_files(spark, tmpdir_fresh):
    segs = views.segments(spark, SF001)
    bodies = captions.srt_body(segs)
    out = os.path.join(tmpdir_fresh, "srt")
    writers.write_subtitles(bodies, out)
    first = bodies.orderBy("video_id").first()
    files_ = glob.glob(os.path.join(out, f"video_id={first.video_id}", "part-*"))
    content = "".join(open(p, encoding="utf-8").read() for p in files_)
    assert content == first.body
    assert content.startswith("1\n00:00:00,000 --> ")


def test_empty_transcript_documents(spark):
    segs = views.segments(spark, SF001).filter("video_id = -1")
    vids = spark.createDataFrame([(5,)], "video_id long")
    assert captions.srt_body(segs, vids).first().body == ""
    assert captions.vtt_body(segs, vids).first().body == "WEBVTT\n\n"


def test_clips_csv_roundtrip(spark, tmpdir_fresh):
    segs = views.segments(spark, SF001)
    c = captions.clips(segs)
    out = os.path.join(tmpdir_fresh, "clips")
    writers.write_clips_csv(c, out)
    back = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
                 .schema("start double, end double, text string, video_id long").csv(out))
    assert sorted(back.select("video_id", "start", "end", "text").collect()) == \
        sorted(c.select("video_id", "start", "end", "text").collect())
    one = glob.glob(os.path.join(out, "video_id=*", "*.csv"))[0]
    with open(one, newline="", encoding="utf-8") as f:
        assert next(csv.reader(f)) == ["start", "end", "text"]


def test_prompts_and_manifest_layout(spark, tmpdir_fresh):
    secs = views.sections(spark, SF001)
    parsed = responses.parsed_sections(views.llm_responses(spark, SF001), views.segments(spark, SF001))
    docs = writers.prompts_documents(parsed, generated_at="2024-01-01T00:00:00")
    writers.write_prompts(docs, os.path.join(tmpdir_fresh, "prompts"))
    assert glob.glob(os.path.join(tmpdir_fresh, "prompts", "video=*", "by=*", "*.json"))
    m = images.manifest(secs, views.image_results(spark, SF001, secs), generated_at="2024-01-01T00:00:00")
    writers.write_manifest(m, os.path.join(tmpdir_fresh, "manifest"))
    n = spark.read.json(os.path.join(tmpdir_fresh, "manifest")).count()
    assert n == secs.select("video_id").distinct().count()
    # re-running overwrites the same partitions instead of appending (SNK-8)
    writers.write_manifest(m, os.path.join(tmpdir_fresh, "manifest"))
    assert spark.read.json(os.path.join(tmpdir_fresh, "manifest")).count() == n


def test_inventory_and_url_list(spark, tmpdir_fresh):
    for name, body in (("a.mp4", b"x" * 10), ("b.wav", b"y" * 3)):
        with open(os.path.join(tmpdir_fresh, name), "wb") as f:
            f.write(body)
    inv = files.read_inventory(spark, tmpdir_fresh, glob="*.mp4")
    assert [(r.key, r.length) for r in inv.collect()] == [("a.mp4", 10)]
    assert "content" not in inv.columns
    p = os.path.join(tmpdir_fresh, "urls.txt")
    with open(p, "w") as f:
        f.write("https://youtu.be/k3-Vt_09xQz\n\n  http://m.youtube.com/shorts/reel_0042 \n")
    urls_ = files.read_url_list(spark, p)
    assert sorted(r.url for r in urls_.collect()) == ["http://m.youtube.com/shorts/reel_0042", "https://youtu.be/k3-Vt_09xQz"]


def test_subtitle_chunks_equal_body(spark, tmpdir_fresh):
    from reelflow.operators.ordered import ordered_chunks
    segs = views.segments(spark, SF001)
    cues = captions.srt_cues(segs)
    chunks = ordered_chunks(cues, ["video_id"], "pos", "cue", "", block_size=2)
    out = os.path.join(tmpdir_fresh, "chunks")
    writers.write_subtitle_chunks(chunks, out)
    first = captions.srt_body(segs).orderBy("video_id").first()
    parts = sorted(glob.glob(os.path.join(out, f"video_id={first.video_id}", "part-*")))
    assert "".join(open(p, encoding="utf-8").read() for p in parts) == first.body


def test_csv_quotes_newlines_and_utf8_json(spark, tmpdir_fresh):
    rows = [(1, 0, 0.0, 1.5, 'say "hi"\nthen go'), (1, 1, 1.5, 2.0, "héllo, wörld 🎬"), (1, 2, 2.0, 9.5e-4, "")]
    segs = spark.createDataFrame(rows, "video_id long, pos int, start_s double, end_s double, text string")
    out = os.path.join(tmpdir_fresh, "clips")
    writers.write_clips_csv(captions.clips(segs), out)
    back = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
                 .schema("start double, end double, text string").csv(os.path.join(out, "video_id=1")))
    got = sorted((r.start, r.end, r.text or "") for r in back.collect())
    assert got == sorted((s, e, t.strip()) for _, _, s, e, t in rows)
    jout = os.path.join(tmpdir_fresh, "aligned")
    writers.write_aligned_json(writers.aligned_documents(segs), jout)
    raw = "".join(open(p, encoding="utf-8").read() for p in glob.glob(os.path.join(jout, "video=*", "*.json")))
    assert "héllo, wörld 🎬" in raw and '"language":"en"' in raw


def test_prompts_document_read_and_explode(spark, tmpdir_fresh):
    doc = {"video_name": "talk", "transcript_file": "outputs/talk.aligned.json", "model": "gpt-4o-mini",
           "generated_at": "2026-01-01T00:00:00", "language": "en", "num_sections": 2,
           "sections": [{"start_time": 0.0, "end_time": 2.0, "image_prompt": "a", "visual_style": "cinematic"},
                        {"start_time": 2.0, "end_time": 4.0, "image_prompt": "b", "sentiment": "neutral"}]}
    with open(os.path.join(tmpdir_fresh, "talk_prompts.json"), "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2)
    docs = files.read_prompts(spark, tmpdir_fresh).withColumnRenamed("video_name", "video_id")
    secs = images.explode_sections(docs).orderBy("section_index").collect()
    assert [(s.section_index, s.image_prompt, s.visual_style, s.sentiment) for s in secs] == [
        (0, "a", "cinematic", None), (1, "b", None, "neutral")]
    req = images.image_requests(images.explode_sections(docs), backend=F.lit("stability")).orderBy("section_index")
    assert [r.frame_file for r in req.collect()] == ["frame_00000000.png", "frame_00002000.png"]


def test_stage_table_rewritten_when_folder_vanishes(spark, tmpdir_fresh):
    from reelflow.sources import stage
    src = os.path.join(tmpdir_fresh, "in.parquet")
    spark.range(5).write.parquet(src)
    p1 = stage.stage_path(spark, "t", [src], lambda: spark.read.parquet(src))
    assert stage.stage_path(spark, "t", [src], lambda: spark.read.parquet(src)) == p1
    for key, path in list(stage._WRITTEN.items()):   # simulate a cleaned shared folder
        if path == p1:
            stage._WRITTEN[key] = os.path.join(tmpdir_fresh, "gone")
    p2 = stage.stage_path(spark, "t", [src], lambda: spark.read.parquet(src))
    assert p2 != p1 and spark.read.parquet(p2).count() == 5


def test_empty_section_list_still_writes_a_document(spark):
    ans = spark.createDataFrame([(1, "openai", '{"sections": []}'), (2, "anthropic", '{"sections": null}'),
                                 (3, "openai", "nope")], "video_id long, backend string, content string")
    segs = spark.createDataFrame([(3, 0, 0.0, 1.0, "hi")], "video_id long, pos int, start_s double, end_s double, "
                                                           "text string")
    parsed = responses.parsed_sections(ans, segs)
    cls = responses.classify(ans).withColumn("model", F.lit("m")).select("video_id", "backend", "model", "status")
    docs = {r.video_name: r for r in writers.prompts_documents(parsed.withColumn("model", F.lit("m")),
                                                               answers=cls).collect()}
    assert docs["video_1"].num_sections == 0 and docs["video_1"].sections == []
    assert "video_2" not in docs                          # an error answer writes nothing
    assert docs["video_3"].num_sections == 1 and docs["video_3"].sections[0].image_prompt == "A scene depicting: hi"


def test_manifest_for_video_without_sections(spark):
    secs = spark.createDataFrame([(1, 0, 0.5, 1.0, "p", "")],
                                 "video_id long, section_index int, start_time double, end_time double, "
                                 "image_prompt string, visual_style string")
    res = spark.createDataFrame([(1, 0, 9.9, "diffusers", 200, None)],
                                "video_id long, section_index int, timestamp_s double, backend string, "
                                "status_code int, seed long")
    vids = spark.createDataFrame([(1,), (2,)], "video_id long")
    m = {r.video_id: r for r in images.manifest(secs, res, videos=vids).collect()}
    assert m[2].num_images == 0 and m[2].images == []
    assert m[1].num_images == 1 and m[1].images[0].timestamp == 0.5     # the section's own start time


def test_writers_and_readers_meet(spark, tmpdir_fresh):
    """All documents of a table come back, names and word timing included; a rewrite of one video leaves the others."""
    from reelflow.operators.timeline import explode_segments
    words = [{"word": "hi", "start": 0.1, "end": 0.4, "score": 0.9}]
    rows = [(v, p, float(p), p + 0.5, f"t{p} é", [(w["word"], w["start"], w["end"], w["score"]) for w in words]) for v in ("a", "b", "c") for p in range(3)]
    segs = spark.createDataFrame(rows, "video_id string, pos int, start_s double, end_s double, text string, "
                                       "words array<struct<word:string,start:double,end:double,score:double>>")
    writers.write_aligned_json(writers.aligned_documents(segs), tmpdir_fresh)
    back = explode_segments(files.read_transcripts(spark, tmpdir_fresh, layout="table"), words=True)
    assert sorted(back.collect()) == sorted(segs.collect())
    writers.write_aligned_json(writers.aligned_documents(segs.where("video_id = 'b' and pos = 0")), tmpdir_fresh)
    docs = {r.video_id: len(r.segments) for r in files.read_transcripts(spark, tmpdir_fresh, layout="table").collect()}
    assert docs == {"a": 3, "b": 1, "c": 3}
    with pytest.raises(ValueError):
        writers.write_aligned_json(writers.aligned_documents(segs), tmpdir_fresh, partition_by=[])


def test_stage_sees_a_file_added_to_a_folder(spark, tmpdir_fresh):
    from reelflow.sources.stage import stage_table
    folder = os.path.join(tmpdir_fresh, "in", "k=1")
    spark.range(5).write.parquet(os.path.join(folder, "a"))
    read = lambda: stage_table(spark, "grows", [os.path.join(tmpdir_fresh, "in")],
                               lambda: spark.read.option("recursiveFileLookup", "true").parquet(os.path.join(tmpdir_fresh, "in")))
    assert read().count() == 5
    spark.range(7).write.parquet(os.path.join(folder, "b"))
    assert read().count() == 12
