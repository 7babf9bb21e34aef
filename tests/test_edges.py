"""Edge rows (FIXTURES §4) against plain-Python brute force, and a hot-video skew fixture."""

import bisect
import math
import random

from pyspark.sql import functions as F

from reelflow.operators import budget, captions, images, intervals, prompts, responses, timeline
from reelflow.operators.blocked import POS_BLOCK

EDGE = [  # video_id, pos, start, end, text
    (1, 0, None, 2.0, "null start"),
    (1, 1, 2.0, 3.0, None),
    (1, 2, 5.0, 4.0, "end before start"),
    (1, 3, 6.0, 7.0, "  padded  "),
    (1, 4, 7.0, 8.0, "emoji 🎬 text"),
    (1, 5, 8.0, 9.0, 'quote " and\nnewline'),
    (1, 6, 4.35, 5.0, "ms truncation"),
    (1, 7, 123456.789, 123457.0, "long frame key"),
]


def _clock(t):
    h, rest = divmod(t, 3600)
    m, s = divmod(rest, 60)
    ms = int((t - int(t)) * 1000)
    return f"{int(h):02}:{int(m):02}:{int(s):02},{ms:03}"


def _line(s, e, t):
    return f"[{(0 if s is None else s):.1f}s - {(0 if e is None else e):.1f}s] {'' if t is None else t}"


def _segs(spark):
    return spark.createDataFrame(EDGE, "video_id long, pos int, start_s double, end_s double, text string")


def test_edge_cues_and_timeline(spark):
    segs = _segs(spark)
    cues = {r.pos: r for r in captions.srt_cues(segs).collect()}
    for v, p, s, e, t in EDGE:
        if s is not None:
            assert cues[p].start_clock == _clock(s)
        else:
            assert cues[p].start_clock is None
        assert cues[p].end_clock == _clock(e)
        assert cues[p].text == (None if t is None else t.strip())
    tl = timeline.timeline_text(segs).first()
    assert tl.transcript == "\n".join(_line(s, e, t) for _, _, s, e, t in EDGE)
    assert cues[6].start_clock == "00:00:04,349"


def test_edge_frames_and_fallback(spark):
    segs = _segs(spark)
    secs = segs.select("video_id", F.col("pos").alias("section_index"), F.col("start_s").alias("start_time"),
                       F.col("end_s").alias("end_time"), F.col("text").alias("image_prompt"),
                       F.lit("cinematic").alias("visual_style"))
    req = {r.section_index: r for r in images.image_requests(secs).collect()}   # video 1 → openai backend
    assert req[6].frame_file == f"frame_{int(4.35 * 1000):08d}.png"
    assert req[7].frame_file == f"frame_{int(123456.789 * 1000):08d}.png"
    assert req[0].frame_file == "frame_00000000.png"                             # missing start → 0.0
    fb = responses.fallback_sections(segs, spark.createDataFrame([(1,), (2,)], "video_id long"))
    got = {r.video_id: r for r in fb.collect()}
    full = " ".join("" if t is None else t for *_, t in EDGE)
    assert got[1].transcript_text == full[:500] and got[1].image_prompt == "A scene depicting: " + full[:200]
    assert (got[1].start_time, got[1].end_time) == (0.0, 123457.0)
    assert got[2].image_prompt == "A generic scene" and got[2].scene_description == "No transcript available"


def test_quarantine_flags_missing_fields(spark):
    from reelflow.operators.quality import missing_fields
    q = {r.record_key: r.reason for r in missing_fields(_segs(spark)).collect()}
    assert q == {"1:0": "missing field: start", "1:1": "missing field: text"}


def _hot(spark, n_hot=3 * POS_BLOCK + 17):
    """One video holding most rows (several blocks) plus small ones."""
    rows = [(0, p) for p in range(n_hot)] + [(v, p) for v in range(1, 6) for p in range(7)]
    df = spark.createDataFrame(rows, "video_id long, pos int")
    return (df.withColumn("start_s", F.col("pos") * 1.5)
              .withColumn("end_s", F.col("pos") * 1.5 + 1.2 + F.when(F.col("pos") % 5 == 0, 2.0).otherwise(0.0))
              .withColumn("text", F.concat(F.lit("w"), F.col("pos").cast("string"))))


def test_hot_video_matches_brute_force(spark):
    segs = _hot(spark).cache()
    rows = sorted(segs.collect(), key=lambda r: (r.video_id, r.pos))
    hot = [r for r in rows if r.video_id == 0]
    # ordered concatenation across blocks
    tl = {r.video_id: r for r in timeline.timeline_text(segs).collect()}
    assert tl[0].transcript == "\n".join(_line(r.start_s, r.end_s, r.text) for r in hot)
    assert tl[0].num_segments == len(hot)
    # rule sections: pause > 1 s starts a new section (lag via pos-1 join, blocked running sum)
    rs = sorted((r.section_index, r.num_segments) for r in prompts.rule_sections(segs).collect() if r.video_id == 0)
    expect, cur = [], 0
    for i, r in enumerate(hot):
        if i == 0 or r.start_s - hot[i - 1].end_s > 1.0:
            expect.append([len(expect), 0])
        expect[-1][1] += 1
    assert rs == [tuple(x) for x in expect]
    # frame as-of lookup with frames every 7th segment
    frames = (segs.filter(F.col("pos") % 7 == 3)
                  .select("video_id", F.col("pos").alias("section_index"), F.col("start_s").alias("timestamp"),
                          F.concat(F.lit("f"), F.col("pos").cast("string")).alias("frame_file")))
    at = {(r.video_id, r.pos): r.frame_section_index
          for r in intervals.frame_at(segs.select("video_id", "pos", "start_s"), frames, "start_s", width=30.0).collect()}
    by_video = {}
    for p in rows:
        if p.pos % 7 == 3:
            by_video.setdefault(p.video_id, []).append((p.start_s, p.pos))
    for r in rows:
        fr = by_video.get(r.video_id, [])
        i = bisect.bisect_right(fr, (r.start_s, float("inf")))
        assert at[(r.video_id, r.pos)] == (fr[i - 1][1] if i else None)
    segs.unpersist()


def test_hot_video_range_join(spark):
    segs = _hot(spark, n_hot=2000)
    secs = (segs.filter(F.col("pos") % 10 == 0)
                .select("video_id", (F.col("pos") / 10).cast("int").alias("section_index"),
                        F.col("start_s").alias("start_time"), (F.col("start_s") + 14.0).alias("end_time")))
    got = {(r.video_id, r.section_index): r.num_segments for r in intervals.section_segments(secs, segs, 30.0).collect()}
    seg_rows = segs.collect()
    for s in secs.collect():
        n = sum(1 for g in seg_rows if g.video_id == s.video_id and g.start_s < s.end_time and g.end_s > s.start_time)
        assert got[(s.video_id, s.section_index)] == n
    assert math.isfinite(len(got))


def test_frames_with_equal_times(spark):
    """Most frames at 0 s (sections without start times) plus a few later ones: same results as plain windows."""
    from pyspark.sql import Window
    rows = [(1, i, 0.0, f"frame_00000000.png") for i in range(300)]
    rows += [(1, 300 + i, 5.0 * (i + 1), f"frame_{5000 * (i + 1):08d}.png") for i in range(20)]
    rows += [(2, 0, 3.0, "frame_00003000.png"), (2, 1, 3.0, "frame_00003000.png"), (2, 2, 1.0, "frame_00001000.png")]
    frames = spark.createDataFrame(rows, "video_id long, section_index int, timestamp double, frame_file string")
    got = {(r.video_id, r.section_index): r.until for r in intervals.frame_intervals(frames).collect()}
    w = Window.partitionBy("video_id").orderBy("timestamp", "section_index")
    want = {(r.video_id, r.section_index): r.u
            for r in frames.withColumn("u", F.lead("timestamp").over(w)).collect()}
    assert got == want
    secs = frames.select("video_id", "section_index", F.col("timestamp").alias("start_time"),
                         F.lit("p").alias("image_prompt"), F.lit("").alias("visual_style"))
    res = frames.select("video_id", "section_index", F.col("timestamp").alias("timestamp_s"),
                        F.lit("diffusers").alias("backend"), F.lit(200).alias("status_code"))
    col = {(r.video_id, r.section_index): (r.n_same_file, r.is_winner)
           for r in images.frame_collisions(secs, res).collect()}
    assert col[(1, 0)] == (300, False) and col[(1, 299)] == (300, True) and col[(1, 300)] == (1, True)
    assert col[(2, 0)] == (2, False) and col[(2, 1)] == (2, True) and col[(2, 2)] == (1, True)


def test_asof_with_frames_at_equal_times(spark):
    rows = [(1, i, 0.0, "f0") for i in range(50)] + [(1, 50, 10.0, "f10")]
    frames = spark.createDataFrame(rows, "video_id long, section_index int, timestamp double, frame_file string")
    pts = spark.createDataFrame([(1, p, float(t)) for p, t in enumerate([0.0, 5.0, 10.0, 12.0])],
                                "video_id long, pos int, start_s double")
    got = {r.pos: r.frame_section_index for r in
           intervals.frame_at(pts, frames, "start_s").collect()}
    assert got == {0: 49, 1: 49, 2: 50, 3: 50}      # the later section at a shared time is the one on screen


def test_corrupt_times_do_not_stop_the_range_join(spark):
    """Times far out of range, endless and missing: the same pairs as the plain predicate."""
    secs = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 10.0, 1e12), (1, 2, -5e11, float("inf")), (1, 3, None, 5.0), (1, 4, 5.0, float("nan")),
                                  (2, 0, 0.0, 8000.0)], "video_id long, section_index int, start_time double, end_time double")
    segs = spark.createDataFrame([(v, p, 3.0 * p, 3.0 * p + 2.0, f"t{p}") for v in (1, 2) for p in range(9)]
                                 + [(1, 9, 20.0, 1e12, "long"), (1, 10, 1e11, 1e11 + 1, "far"), (2, 9, 7000.0, 7000.5, "late")],
                                 "video_id long, pos int, start_s double, end_s double, text string")
    rows = segs.collect()
    for r in intervals.section_segments(secs, segs, 30.0).collect():
        known = r.start_time is not None and not math.isnan(r.end_time)
        assert r.num_segments == sum(g.video_id == r.video_id and known and g.start_s < r.end_time and g.end_s > r.start_time for g in rows)


def test_numbers_do_not_need_dense_positions(spark):
    rows = [(1, p, 1.0 * k, k + 0.9, f"t{k}") for k, p in enumerate([600, 601, 5000, 9000, 9001])]
    segs = spark.createDataFrame(rows, "video_id long, pos int, start_s double, end_s double, text string")
    assert [r.cue_index for r in sorted(captions.srt_cues(segs).collect(), key=lambda r: r.pos)] == [1, 2, 3, 4, 5]
    assert [(r.num_segments, r.transcript_text) for r in prompts.rule_sections(segs).collect()] == [(5, "t0 t1 t2 t3 t4")]
    assert sorted(r.num_segments for r in prompts.rule_sections(segs, max_chars=4).collect()) == [1, 2, 2]
    secs = segs.select("video_id", F.col("pos").alias("section_index"), F.col("start_s").alias("start_time"), F.col("end_s").alias("end_time"),
                       F.col("text").alias("image_prompt"), F.lit("").alias("visual_style"))
    res = secs.select("video_id", "section_index", F.lit(200).alias("status_code"))
    assert sorted(r.attempted for r in images.progress(secs, res).collect()) == [1, 2, 3, 4, 5]
    assert [r.more_sections for r in images.preview(secs).collect()] == [2, 2, 2]


def test_sections_of_two_text_backends_stay_apart(spark):
    secs = spark.createDataFrame([(1, t, "m", i, float(i), "p" + t, "") for t in ("a", "b") for i in range(2)],
                                 "video_id long, text_backend string, text_model string, section_index int, start_time double, "
                                 "image_prompt string, visual_style string")
    res = spark.createDataFrame([(1, t, "m", i, b, 200) for t in ("a", "b") for i in range(2) for b in ("openai", "diffusers")],
                                "video_id long, text_backend string, text_model string, section_index int, backend string, status_code int")
    rec = images.image_records(secs, res)
    assert rec.count() == 8 and {r.prompt for r in rec.where("text_backend = 'a'").collect()} == {"pa"}
    docs = images.manifest(secs, res).collect()
    assert sorted((d.text_backend, d.backend, d.num_images) for d in docs) == [
        (t, b, 2) for t in ("a", "b") for b in ("diffusers", "openai")]


def _greedy(rows, pause, budget):
    """Plain loop over (start, end, text) of one video: sections as lists of texts."""
    out, last_end = [], None
    for start, end, text in rows:
        text = text or ""
        if out and last_end is not None and not (start is not None and start - last_end > pause) and (
                len(" ".join([*out[-1], text])) <= budget):
            out[-1].append(text)
        else:
            out.append([text])
        last_end = end
    return out


def _sections(frame):
    got = {}
    for r in sorted(frame.collect(), key=lambda r: (r.video_id is None, r.video_id or 0, r.section_index)):
        assert r.section_index == len(got.setdefault(r.video_id, []))
        got[r.video_id].append((r.transcript_text, r.num_segments))
    return got


def test_budget_sections_equal_a_plain_loop(spark):
    rng = random.Random(12)
    videos = {}
    for v in [*range(12), None]:
        kind = rng.random()
        videos[v] = [(10.0 * k + (5 if rng.random() < .02 else 0), 10.0 * k + 9.5 if rng.random() < .97 else None,
                      None if rng.random() < .05 else "x" * (rng.choice([0, 0, 1, 2]) if kind < .3 else rng.choice([3, 20, 90, 300, 6000])))
                     for k in range(rng.randint(1, 400))]
    rows = [(v, 3 * k + 7, a, b, t) for v, segs in videos.items() for k, (a, b, t) in enumerate(segs)]
    rng.shuffle(rows)
    segs = spark.createDataFrame(rows, "video_id bigint, pos int, start_s double, end_s double, text string").repartition(3)
    for budget, pause in ((100, 1.0), (500, 1e9)):
        expected = {v: [(" ".join(s), len(s)) for s in _greedy(segs_, pause, budget)] for v, segs_ in videos.items()}
        assert _sections(prompts.rule_sections(segs, pause, max_chars=budget)) == expected


def test_budget_parts_over_many_super_blocks(spark):
    rng = random.Random(13)
    rows = [(k, rng.choice([1, 1, 2, 7, 30, 55]), rng.random() < .01) for k in range(6000)]
    frame = spark.createDataFrame([(1, *r) for r in rows], "k int, pos int, size int, forced boolean")
    part, used, expected = -1, 0, {}
    for pos, size, forced in rows:
        if part < 0 or forced or used + size > 40:
            part, used = part + 1, 0
        used += size
        expected[pos] = part
    for blocks, supers in ((2, 3), (64, 4096)):                # hundreds of blocks in tens of super-blocks, or few
        got = budget.budget_parts(frame, ["k"], "pos", F.col("size"), 40, F.col("forced"), supers, blocks)
        assert {r.pos: r.part for r in got.collect()} == expected


def test_section_of_two_long_segments_is_cut(spark):
    rows = [(1, k, float(k), k + 0.9, "a" * 1500) for k in range(4)]
    segs = spark.createDataFrame(rows, "video_id int, pos int, start_s double, end_s double, text string")
    assert [len(t) for t, _ in _sections(prompts.rule_sections(segs, max_chars=2000))[1]] == [1500] * 4
    assert [len(t) for t, _ in _sections(prompts.rule_sections(segs, max_chars=3001))[1]] == [3001] * 2


def test_intervals_of_any_length_equal_brute_force(spark):
    rng = random.Random(21)

    def some(n):
        out = []
        for k in range(n):
            start = rng.uniform(-50, 5000)
            length = rng.choice([0.0, 0.5, 3.0, 59.0, 60.0, 61.0, 480.0, 500.0, 4000.0, 1e9, 1e300, -2.0])
            out.append((rng.randint(0, 2), k, start, start + length))
        return out + [(1, n, None, 5.0), (1, n + 1, 5.0, None), (1, n + 2, float("nan"), 5.0), (1, n + 3, 0.0, float("inf")), (None, n + 4, 0.0, 9.0)]

    left, right = some(60), some(80)
    lf = spark.createDataFrame(left, "video_id int, a int, s double, e double")
    rf = spark.createDataFrame(right, "video_id int, b int, x double, y double")
    got = sorted((r.a, r.b) for r in intervals.overlap_pairs(lf, rf, "video_id", "s", "e", "x", "y").collect())
    known = lambda t: t is not None and not math.isnan(t)
    expected = sorted((a, b) for v, a, s, e in left for w, b, x, y in right
                      if v is not None and v == w and all(map(known, (s, e, x, y))) and x < e and y > s)
    assert got == expected and len(got) > 500


def test_long_intervals_meet_what_lies_in_them(spark):
    """Candidates stay within a constant of the pairs found, also where every section is hours long."""
    day = 86_400.0
    secs = spark.range(60).selectExpr("1 AS video_id", "id AS a", f"id * {day} / 20 AS s", f"id * {day} / 20 + {day} / 10 AS e")
    segs = spark.range(20_000).selectExpr("1 AS video_id", "id AS b", "id * 13.0 AS x", "id * 13.0 + 12.0 AS y")
    on = ("video_id", "s", "e", "x", "y")
    pairs, compared = intervals.overlap_pairs(secs, segs, *on).count(), intervals.candidate_pairs(secs, segs, *on).count()
    assert pairs > 30_000 and compared < 8 * pairs < 20_000 * 60 * 2


def test_word_times_grow_with_the_words(spark):
    """Running lengths of a segment of many words: right, and twice the words do not take four times as long."""
    import time
    from reelflow.operators.timeline import word_timeline

    def segs(n):
        return spark.range(4).selectExpr("id AS video_id", "0 AS pos", "0.0D AS start_s", "100.0D AS end_s",
                                         f"array_join(transform(sequence(1, {n}), k -> repeat('w', cast(k % 5 + 1 AS int))), ' ') AS text")

    rows = word_timeline(segs(1000).where("video_id = 0")).orderBy("word_pos").collect()
    upto = 0
    for k, r in enumerate(rows):
        size = (k + 1) % 5 + 1
        assert math.isclose(r.word_start, 100 * upto / 3000, abs_tol=1e-9) and math.isclose(r.word_end, 100 * (upto + size) / 3000, abs_tol=1e-9)
        upto += size

    def seconds(n):
        best = None
        for _ in range(2):
            start = time.time()
            word_timeline(segs(n)).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - start)
        return best

    seconds(20_000)
    assert seconds(160_000) < 4 * seconds(40_000) + 3              # quadratic work would take sixteen times as long


def test_preview_shuffles_the_first_rows_of_each_task_alone(spark):
    secs = spark.range(0, 5000, 1, 4).selectExpr("id div 100000 AS video_id", "cast(id AS int) AS section_index", "0.0D AS start_time", "1.0D AS end_time",
                                                 "concat('prompt ', id) AS image_prompt", "'' AS visual_style")
    plan = images.preview(secs)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("WindowGroupLimit"):]
    assert "Final" in below and "Partial" in below and below.index("Exchange") < below.index("Partial")
    assert [(r.section_index, r.more_sections) for r in images.preview(secs).orderBy("section_index").collect()] == [(k, 4997) for k in range(3)]


def test_budget_cuts_call_python_for_batches_not_for_each_video(spark):
    """Most videos are one short block: a call of Python for each of them would take most of the time."""
    segs = spark.createDataFrame([(v, p, p + 0.0, p + 0.5, "a text") for v in (*range(50), None) for p in range(4)],
                                 "video_id long, pos int, start_s double, end_s double, text string")
    cut = prompts.rule_sections(segs, 1e9, max_chars=13)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMap" not in plan
    assert sorted((r.video_id is None, r.video_id or 0, r.section_index, r.transcript_text) for r in cut.collect()) == sorted(
        (v is None, v or 0, k, "a text a text") for v in (*range(50), None) for k in range(2))
