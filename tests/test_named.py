"""Files under their own names: the data source's two phases, and what the default readers find."""

import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from reelflow.operators import captions, images, responses, timeline
from reelflow.sinks import named, writers
from reelflow.sources import files, views
from tests.conftest import SF001


def below(folder):
    """What a reader can see: names that start with an underscore are hidden, such as the parts of a run."""
    return sorted(os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names
                  if not n.endswith(".crc") and "/_staged-" not in d)


def rows(spark, pairs, parts=3):
    return spark.createDataFrame(pairs, "name string, body string").repartition(parts)


def test_files_have_their_names_and_bytes(spark, tmpdir_fresh):
    pairs = [(f"v{k}/m/v{k}.aligned.json", f"é {k}\n") for k in range(40)] + [("top.txt", None), ("empty.txt", "")]
    named.write_files(rows(spark, pairs), tmpdir_fresh)
    assert below(tmpdir_fresh) == sorted(n for n, _ in pairs)
    for name, body in pairs:
        assert open(os.path.join(tmpdir_fresh, name), encoding="utf-8", newline="").read() == (body or "")


def test_a_second_run_replaces_its_files_and_leaves_the_others(spark, tmpdir_fresh):
    named.write_files(rows(spark, [(f"{k}.txt", "a long first text") for k in range(6)]), tmpdir_fresh)
    named.write_files(rows(spark, [(f"{k}.txt", "b") for k in range(3)]), "file://" + tmpdir_fresh)
    assert [open(os.path.join(tmpdir_fresh, f"{k}.txt")).read()[0] for k in range(6)] == list("bbbaaa")
    named.write_files(rows(spark, []), tmpdir_fresh)
    assert len(below(tmpdir_fresh)) == 6


def test_a_failed_task_leaves_no_file(spark, tmpdir_fresh):
    named.write_files(rows(spark, [("kept.txt", "old")]), tmpdir_fresh)
    bad = spark.range(0, 400, 1, 4).select(F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("name"),
                                           F.when(F.col("id") == 399, F.raise_error(F.lit("a broken row"))).otherwise("x").alias("body"))
    bad = bad.unionAll(rows(spark, [("kept.txt", "new")]))
    with pytest.raises(Exception, match="a broken row"):
        named.write_files(bad, tmpdir_fresh)
    assert below(tmpdir_fresh) == ["kept.txt"] and open(os.path.join(tmpdir_fresh, "kept.txt")).read() == "old"


@pytest.mark.parametrize("name", [None, "", "/etc/x", "a/../b", "a//b", "_staged-1/x", "two\nlines"])
def test_names_that_lead_elsewhere_are_refused(name):
    with pytest.raises(ValueError):
        named.checked(name)


def test_moves_can_be_run_again(tmpdir_fresh):
    """A publishing task that is lost after some moves starts anew: done files are passed over, lost ones are an error."""
    import pyarrow as pa
    folder = os.path.join(tmpdir_fresh, "_staged-j", "0-1")
    os.makedirs(folder)
    for n in ("a", "b"):
        open(os.path.join(folder, n), "w").write(n)
    batch = pa.RecordBatch.from_pydict({"attempt": ["0-1", "0-1"], "name": ["a", "b"]})
    move = named._moves(tmpdir_fresh, "j")
    assert len(list(move(iter([batch.slice(0, 1)])))) == 1
    assert len(list(move(iter([batch])))) == 1 and open(os.path.join(tmpdir_fresh, "b")).read() == "b"
    os.remove(os.path.join(tmpdir_fresh, "b"))
    with pytest.raises(FileNotFoundError):
        list(move(iter([batch])))


def test_a_video_folder_as_the_transcription_step_leaves_it(spark, tmpdir_fresh):
    """All four files of each video below <video>/<model>/, read by name with the default readers."""
    texts = ['says "hi", twice', "two\nlines", "  ünïcode 🎬 ", ""]
    segs = spark.createDataFrame([(v, p, p + 0.5, p + 1.25, t) for v in ("talk", "demo") for p, t in enumerate(texts)],
                                 "video_id string, pos int, start_s double, end_s double, text string")
    vids = spark.createDataFrame([("talk",), ("demo",), ("mute",)], "video_id string")
    languages = spark.createDataFrame([("talk", "de")], "video_id string, language string")
    named.write_files(writers.transcript_files(segs, "small", vids, languages), tmpdir_fresh)
    kinds = (".aligned.json", ".clips.csv", ".srt", ".vtt")
    assert below(tmpdir_fresh) == sorted([f"{v}/small/{v}{k}" for v in ("talk", "demo") for k in kinds]
                                         + [f"mute/small/mute{k}" for k in kinds[1:]])
    docs = files.read_transcripts(spark, tmpdir_fresh)
    assert {r.video_id: r.language for r in docs.collect()} == {"talk": "de", "demo": "en"}
    assert sorted(timeline.explode_segments(docs).collect()) == sorted(segs.collect())
    with open(os.path.join(tmpdir_fresh, "talk/small/talk.aligned.json"), encoding="utf-8") as f:
        assert "ünïcode 🎬" in f.read()
    with open(os.path.join(tmpdir_fresh, "talk/small/talk.clips.csv"), newline="", encoding="utf-8") as f:
        assert list(csv.reader(f)) == [["start", "end", "text"], *[[str(p + 0.5), str(p + 1.25), t.strip()] for p, t in enumerate(texts)]]
    clips = sorted((r.video_id, r.start, r.end, r.text) for r in files.read_clips(spark, tmpdir_fresh).collect())
    assert clips == sorted((r.video_id, r.start, r.end, r.text) for r in captions.clips(segs).collect())
    bodies = {(r.video_id, r.kind): r.body for r in files.read_subtitles(spark, tmpdir_fresh).collect()}
    assert ("mute", "srt") not in bodies and bodies[("mute", "vtt")] == "WEBVTT\n\n"
    assert bodies[("talk", "srt")] == {r.video_id: r.body for r in captions.srt_body(segs).collect()}["talk"]


def test_prompts_and_manifest_files(spark, tmpdir_fresh):
    secs = views.sections(spark, SF001)
    parsed = responses.parsed_sections(views.llm_responses(spark, SF001), views.segments(spark, SF001))
    docs = writers.prompts_documents(parsed, generated_at="2024-01-01T00:00:00")
    named.write_files(writers.prompts_files(docs), os.path.join(tmpdir_fresh, "prompts"))
    manifests = images.manifest(secs, views.image_results(spark, SF001, secs), generated_at="2024-01-01T00:00:00")
    named.write_files(writers.manifest_files(manifests), os.path.join(tmpdir_fresh, "images"))
    names = {r.video_name for r in docs.collect()}
    assert below(os.path.join(tmpdir_fresh, "prompts")) == sorted(f"{n}_prompts.json" for n in names)
    assert files.read_prompts(spark, os.path.join(tmpdir_fresh, "prompts")).count() == len(names)
    one = json.load(open(os.path.join(tmpdir_fresh, "images", "video_0", "metadata.json"), encoding="utf-8"))
    assert one["video_name"] == "video_0" and one["num_images"] == len(one["images"])
    back = files.read_manifests(spark, os.path.join(tmpdir_fresh, "images"))
    assert sorted(r.video_name for r in back.collect()) == sorted(r.video_name for r in manifests.collect())


def test_manifest_records_the_choices_of_its_call(spark):
    secs = spark.createDataFrame([(2, 0, 0.5, 1.0, "p", ""), (3, 0, 0.5, 1.0, "p", "")],
                                 "video_id long, section_index int, start_time double, end_time double, image_prompt string, visual_style string")
    res = spark.createDataFrame([(2, 0, "stability", 200, 7), (3, 0, "diffusers", 200, 7)],
                                "video_id long, section_index int, backend string, status_code int, seed long")
    made = images.manifest(secs, res, model="m", negative_prompt="n", overrides={"output_format": "webp", "num_inference_steps": 12})
    m = {r.video_id: r for r in made.collect()}
    assert m[2].images[0].image_path.endswith("frame_00000500.webp") and m[2].settings["output_format"] == "webp"
    assert m[3].images[0].image_path.endswith(".png") and m[3].settings["num_inference_steps"] == "12"
    assert {r.model for r in m.values()} == {"m"} and {r.settings["negative_prompt"] for r in m.values()} == {"n"}


def test_a_folder_without_matching_files_is_an_error(spark, tmpdir_fresh):
    with open(os.path.join(tmpdir_fresh, "talk.json"), "w") as f:
        f.write("{}")
    for read in (files.read_transcripts, files.read_prompts, files.read_manifests, files.read_subtitles, files.read_clips):
        with pytest.raises(FileNotFoundError):
            read(spark, tmpdir_fresh)


def test_a_run_is_staged_by_all_partitions_in_flat_folders(spark, tmpdir_fresh, monkeypatch):
    """One partition of small bodies is dealt out again, and folders of the names are made once, when files are moved."""
    seen, moves = {}, named._moves

    def spying(path, job):
        for folder, inner, inside in os.walk(f"{path}/_staged-{job}"):
            seen[folder] = (inner, inside)
        return moves(path, job)

    monkeypatch.setattr(named, "_moves", spying)
    pairs = [(f"v{k}/m/v{k}_prompts.json", str(k)) for k in range(200)]
    named.write_files(rows(spark, pairs, parts=1), tmpdir_fresh)
    top = min(seen, key=len)
    attempts = [f for f in seen if f != top]
    assert len([f for f in attempts if seen[f][1]]) > 1 and not any(seen[f][0] for f in attempts)
    assert {n: open(os.path.join(tmpdir_fresh, n)).read() for n in below(tmpdir_fresh)} == dict(pairs)


def test_many_small_files_are_listed_and_read_in_few_tasks(spark, tmpdir_fresh):
    for k in range(800):
        os.makedirs(f"{tmpdir_fresh}/v{k}/m")
        with open(f"{tmpdir_fresh}/v{k}/m/v{k}_prompts.json", "w") as f:
            json.dump({"video_name": f"v{k}", "model": "m", "sections": []}, f)
    few = 4 * spark.sparkContext.defaultParallelism
    docs = files.read_prompts(spark, tmpdir_fresh)
    assert docs.rdd.getNumPartitions() <= few
    assert sorted(r.video_name for r in docs.collect()) == sorted(f"v{k}" for k in range(800))
    before = spark.conf.get(files.LISTING)
    assert int(files._listed(spark, lambda: spark.conf.get(files.LISTING))) <= few and spark.conf.get(files.LISTING) == before


def test_many_clips_files_are_read_in_few_tasks(spark, tmpdir_fresh):
    for k in range(800):
        os.makedirs(f"{tmpdir_fresh}/v{k}/m")
        with open(f"{tmpdir_fresh}/v{k}/m/v{k}.clips.csv", "w") as f:
            f.write(f"start,end,text\r\n0.0,1.0,t{k}\r\n")
    clips = files.read_clips(spark, tmpdir_fresh)
    assert clips.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted((r.video_id, r.text) for r in clips.collect()) == sorted((f"v{k}", f"t{k}") for k in range(800))
