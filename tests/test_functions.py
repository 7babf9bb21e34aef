"""Literal cases for the scalar functions (clock, URL, text, JSON, defaults)."""

import pytest
from pyspark.sql import functions as F

from reelflow.functions import clock, jsonx, text, urls


def one(spark, col, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(col(F.col("x")).alias("y")).first()["y"]


CLOCK = [(0.25, "00:00:00,250"), (59.875, "00:00:59,875"), (60.0, "00:01:00,000"), (3599.5, "00:59:59,500"),
         (7322.0625, "02:02:02,062"), (360000.0, "100:00:00,000")]


@pytest.mark.parametrize("t,expected", CLOCK)
def test_srt_clock(spark, t, expected):
    assert one(spark, clock.srt_clock, t, "double") == expected
    assert one(spark, clock.vtt_clock, t, "double") == expected.replace(",", ".")


def test_clock_ms_truncation_and_frame_key(spark):
    # 4.35 s: the clock takes (t - int(t)) * 1000 → 349, the frame name int(t * 1000) → 4350
    assert one(spark, clock.srt_clock, 4.35, "double") == "00:00:04,349"
    assert one(spark, lambda c: clock.frame_file(c, "png"), 4.35, "double") == "frame_00004350.png"
    assert one(spark, lambda c: clock.frame_file(c, "png"), 123456.789, "double") == "frame_123456789.png"


@pytest.mark.parametrize("x,expected", [(0.25, "0.2"), (0.15, "0.1"), (12.35, "12.3"), (2.5, "2.5"), (0.0, "0.0")])
def test_one_decimal_matches_python(spark, x, expected):
    assert expected == f"{x:.1f}"
    assert one(spark, clock.one_decimal, x, "double") == expected


def test_size_text(spark):
    assert one(spark, clock.size_text, 0.075, "double") == "0.07GB"
    assert one(spark, clock.size_text, 3.09, "double") == "3.09GB"


# identifiers, hosts and times of our own, one case per class of address
SHORTS = [("https://www.youtube.com/shorts/k7-Lm_92", "k7-Lm_92"),
          ("http://m.youtube.com/shorts/fiveC/extra?x=1#y", "fiveC"),
          ("https://youtu.be/shorts/zz_zz-zz", "zz_zz-zz"),
          ("https://www.youtube.com/shorts/four", None),
          ("https://www.youtube.com/playlist?list=k7-Lm_92", None),
          ("https://vimeo.com/shorts/k7-Lm_92", None),
          ("shorts/k7-Lm_92", None), ("", None)]


@pytest.mark.parametrize("url,expected", SHORTS)
def test_shorts_id(spark, url, expected):
    assert one(spark, urls.shorts_id, url) == expected


def watch(video):
    return f"https://www.youtube.com/watch?v={video}"


CANON = [("https://www.youtube.com/shorts/k7-Lm_92#clip", watch("k7-Lm_92")),
         ("http://youtu.be/Qq1?si=share&t=99", watch("Qq1")),
         ("https://youtu.be//Qq1", watch("Qq1")),
         ("https://youtu.be", "https://youtu.be"),
         (watch("Qq1") + "&list=L", watch("Qq1") + "&list=L"),
         ("https://www.youtube.com/watch_popup?v=Qq1", "https://www.youtube.com/watch_popup?v=Qq1"),
         ("https://www.youtube-nocookie.com/embed?a=b&v=Qq1&v=Rr2", watch("Qq1")),
         ("https://x.org/p?v=&v=a%2Fb+c", watch("a/b c")),
         ("https://x.org/p?%76=Qq1", watch("Qq1")),
         ("https://x.org/p?v=100%", watch("100%")),               # a stray percent sign stays
         ("https://x.org/p?v=ab%zz%41", watch("ab%zzA")),
         ("https://x.org/p#?v=Qq1", "https://x.org/p#?v=Qq1")]


@pytest.mark.parametrize("url,expected", CANON)
def test_canonical_url(spark, url, expected):
    assert one(spark, urls.canonical_url, url) == expected


@pytest.mark.parametrize("s", ["  hi  ", " hi　", "\x1chi\x1f", "\n\thi\r\n", "hi", "", "  ", "a b"])
def test_py_strip(spark, s):
    assert one(spark, text.py_strip, s) == s.strip()


def test_styled_and_capped_prompt(spark):
    df = spark.createDataFrame([("p", "cinematic"), ("p", ""), ("p", None), ("x" * 4100, "realistic")],
                               "p string, s string")
    out = [r[0] for r in df.select(text.cap_prompt(text.styled_prompt("p", "s"))).collect()]
    assert out[:3] == ["p, cinematic style", "p", "p"]
    assert len(out[3]) == 4000 and out[3].endswith("...") and out[3][:3997] == ("x" * 4100 + ", realistic style")[:3997]


def test_video_name_and_cache_dir(spark):
    assert one(spark, text.video_name, "talk.aligned.json") == "talk"
    assert one(spark, text.video_name, "a.b.json") == "a.b"
    assert one(spark, text.cache_dir_name, "Systran/faster-whisper-tiny") == "models--Systran--faster-whisper-tiny"


BODY = '{"sections": [{"start_time": 0.0, "image_prompt": "p"}]}'
MIXED = '[{"start_time": 1.0}, "oops", {"start_time": 2.0}]'
SHAPES = {  # content → (openai, anthropic, ollama) status
    BODY: ("parsed", "parsed", "parsed"),
    '[{"start_time": 0.0}]': ("parsed", "parsed", "fallback"),
    "Here:\n```json\n" + BODY + "\n```\nDone.": ("fallback", "parsed", "parsed"),
    "```\n" + BODY + "\n```": ("fallback", "parsed", "parsed"),
    "Sure! " + BODY + "\nAnything else?": ("fallback", "fallback", "parsed"),
    BODY + " junk": ("fallback", "fallback", "parsed"),
    "not json": ("fallback", "fallback", "fallback"),
    '{"title": "x"}': ("fallback", "fallback", "fallback"),
    '{"sections": null}': ("fallback", "error", "error"),
    '{"sections": []}': ("parsed", "parsed", "parsed"),
    '{"sections": "[1]"}': ("error", "error", "error"),
    '{"sections": [1, 2]}': ("parsed", "parsed", "parsed"),
    "[1, 2]": ("parsed", "parsed", "parsed"),
    MIXED: ("parsed", "parsed", "fallback"),
    "": ("fallback", "fallback", "fallback"),
}


def test_response_shapes_per_backend(spark):
    from reelflow.operators.responses import classify
    rows = [(i, b, c) for i, c in enumerate(SHAPES) for b in ("openai", "anthropic", "ollama")]
    df = spark.createDataFrame(rows, "video_id long, backend string, content string")
    got = {(r.video_id, r.backend): r.status for r in classify(df).collect()}
    for i, c in enumerate(SHAPES):
        for b, want in zip(("openai", "anthropic", "ollama"), SHAPES[c]):
            assert got[(i, b)] == want, (c, b)


def test_every_item_is_typed_alone(spark):
    from reelflow.operators.responses import parsed_sections
    answers = [(1, MIXED), (2, "[1, 2]"), (3, '{"sections": []}'), (4, '{"sections": "[1]"}'), (5, '{"sections": null}'),
               (6, '[{"start_time": "late", "image_prompt": "kept"}, null, "{\\"start_time\\": 3.0}"]'), (7, "no json")]
    df = spark.createDataFrame([(i, "anthropic", c) for i, c in answers], "video_id long, backend string, content string")
    segs = spark.createDataFrame([(7, 600 + k, 5.0 + k, 6.0 + k, f"t{k}") for k in range(5)],
                                 "video_id long, pos int, start_s double, end_s double, text string")
    rows = sorted(parsed_sections(df, segs).collect(), key=lambda r: (r.video_id, r.section_index is not None, r.section_index))
    got = [(r.video_id, r.section_index, r.start_time, r.reason) for r in rows]
    bad = "item is not an object"
    assert got == [(1, 0, 1.0, None), (1, 1, None, bad), (1, 2, 2.0, None), (2, 0, None, bad), (2, 1, None, bad),
                   (3, None, None, "no sections"), (4, None, None, "sections is not a list"), (5, None, None, "sections is null"),
                   (6, 0, None, None), (6, 1, None, bad), (6, 2, None, bad), (7, 0, 5.0, None)]
    assert rows[8].image_prompt == "kept"
    assert (rows[-1].transcript_text, rows[-1].end_time) == ("t0 t1 t2 t3 t4", 10.0)     # positions need not start at 0


def test_word_tokens_part_at_any_white_space(spark):
    from reelflow.operators.timeline import word_timeline
    segs = spark.createDataFrame([(1, 0, 0.0, 6.0, "\u00a0ab\u00a0c\u3000 def \x1f"), (1, 1, 0.0, 1.0, " "), (1, 2, 0.0, 1.0, None)],
                                 "video_id long, pos int, start_s double, end_s double, text string")
    assert [(r.word, r.word_start, r.word_end) for r in sorted(word_timeline(segs).collect(), key=lambda r: r.word_pos)] == [
        ("ab", 0.0, 2.0), ("c", 2.0, 3.0), ("def", 3.0, 6.0)]


def test_unclosed_fence_drops_last_char(spark):
    assert one(spark, jsonx.fenced_json, "```json\n{\"a\": 1}xy") == '{"a": 1}x'


@pytest.mark.parametrize("t,ok", [('{"a": 1}', True), ('[1, 2]', True), ('{"a": 1} junk', False), ("1] [2", False),
                                  ("", False), ("  {\"a\": 1}\n", True), ('"s"', True), ("{'a': 1}", False)])
def test_strict_json(spark, t, ok):
    assert one(spark, jsonx.strict_json_ok, t) is ok


def test_base64_decode(spark):
    df = spark.createDataFrame([("aGVsbG8=",), ("***",)], "b string")
    out = [r[0] for r in df.select(jsonx.decode_base64("b")).collect()]
    assert out[0] == bytearray(b"hello") and out[1] is None


def test_raw_sections_keep_ill_typed_fields(spark):
    from reelflow.operators.responses import classify
    df = spark.createDataFrame([(1, "openai", '{"sections": [{"start_time": "1.5", "image_prompt": "p"}]}')],
                               "video_id long, backend string, content string")
    r = classify(df).first()
    assert r.status == "parsed" and r.sections[0].start_time is None
    assert '"1.5"' in r.sections_raw[0] and r.num_sections == 1


@pytest.mark.parametrize("name", ["talk.aligned.json", "a.b.json", ".bashrc", "name.", "a.b.", "plain", "x.y"])
def test_file_stem_matches_pathlib(spark, name):
    import pathlib
    p = pathlib.PurePath(name)
    i = name.rfind(".")
    expected = name[:i] if 0 < i < len(name) - 1 else name     # the classic suffix rule
    assert one(spark, text.file_stem, name) == expected
    assert expected == p.stem or name.endswith(".")               # pathlib agrees except newer trailing-dot rules


def _segs(spark, rows):
    return spark.createDataFrame([(1, i, s, e, t) for i, (s, e, t) in enumerate(rows)],
                                 "video_id long, pos int, start_s double, end_s double, text string")


def test_srt_and_vtt_literal_documents(spark):
    from reelflow.operators import captions
    one = _segs(spark, [(59.75, 61.004, "\tover the minute  ")])
    assert captions.srt_body(one).first().body == "1\n00:00:59,750 --> 00:01:01,004\nover the minute\n\n"
    three = _segs(spark, [(3599.5, 3600.25, "last of the hour"), (3600.25, 3601.0, ""), (7325.125, 7330.0, "é → 2")])
    assert captions.srt_body(three).first().body == (
        "1\n00:59:59,500 --> 01:00:00,250\nlast of the hour\n\n2\n01:00:00,250 --> 01:00:01,000\n\n\n"
        "3\n02:02:05,125 --> 02:02:10,000\né → 2\n\n")
    assert captions.vtt_body(three).first().body == (
        "WEBVTT\n\n00:59:59.500 --> 01:00:00.250\nlast of the hour\n\n01:00:00.250 --> 01:00:01.000\n\n\n"
        "02:02:05.125 --> 02:02:10.000\né → 2\n\n")
    nothing = _segs(spark, [(0.0, 1.0, "x")]).filter("pos < 0")
    vids = spark.createDataFrame([(1,)], "video_id long")
    assert captions.srt_body(nothing, vids).first().body == ""
    assert captions.vtt_body(nothing, vids).first().body == "WEBVTT\n\n"
