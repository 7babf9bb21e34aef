"""Property tests: Spark column functions against plain-Python semantics on generated inputs.

Each test draws a few hundred inputs with Hypothesis and evaluates them in one
Spark job, so the suite stays fast.
"""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelflow.functions import clock, jsonx, text, urls

SETTINGS = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))


def _eval(spark, values, dtype, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


# ------------------------------------------------------------------ clocks
@SETTINGS
@given(st.lists(st.integers(0, 400_000 * 1000), min_size=200, max_size=300))
def test_clock_text_names_the_time_it_was_built_from(spark, millis):
    """The text has the fields of the whole seconds and, to one unit of rounding, the milliseconds they were built from."""
    texts = _eval(spark, [m / 1000 for m in millis], "double", clock.srt_clock)
    for m, t in zip(millis, texts):
        hours, minutes, rest = t.split(":")
        seconds, thousandths = rest.split(",")
        assert len(minutes) == len(seconds) == 2 and len(thousandths) == 3 and len(hours) >= 2
        back = ((int(hours) * 60 + int(minutes)) * 60 + int(seconds)) * 1000 + int(thousandths)
        assert back in (m, m - 1)
    assert _eval(spark, [m / 1000 for m in millis], "double", clock.vtt_clock) == [t.replace(",", ".") for t in texts]


@SETTINGS
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=200, max_size=300))
def test_one_decimal_property(spark, xs):
    assert _eval(spark, xs, "double", clock.one_decimal) == [f"{x:.1f}" for x in xs]


# ------------------------------------------------------------------ strip
WS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0        　"


@SETTINGS
@given(st.lists(st.text(alphabet=st.sampled_from(list(WS) + list("ab é🎬​")), max_size=12),
                min_size=200, max_size=300))
def test_strip_property(spark, ss):
    assert _eval(spark, ss, "string", text.py_strip) == [s.strip() for s in ss]


# ------------------------------------------------------------------ URLs
ID = st.text(alphabet="abcXYZ019_-", min_size=5, max_size=12)
NOISE = st.sampled_from(["", "t=1", "list=Lx", "vv=zz", "feature=share"])
#: Address forms around an identifier that the generator chooses.
FORMS = st.sampled_from(["https://www.youtube.com/shorts/{id}?{n}", "http://youtu.be/{id}?{n}", "https://x.org/e?{n}&v={id}#f",
                         "//m.youtube.com/shorts/{id}", "https://youtu.be/shorts/{id}/", "https://a.b/?%76={id}&v=other"])


@SETTINGS
@given(st.lists(st.tuples(FORMS, ID, NOISE), min_size=200, max_size=300))
def test_canonical_form_holds_the_identifier(spark, drawn):
    given_urls = [form.format(id=i, n=n) for form, i, n in drawn]
    canonical = _eval(spark, given_urls, "string", urls.canonical_url)
    assert canonical == ["https://www.youtube.com/watch?v=" + i for _, i, _ in drawn]
    assert _eval(spark, canonical, "string", urls.canonical_url) == canonical             # a fixed point


@SETTINGS
@given(st.lists(st.text(alphabet="abc./?#&=%:", max_size=20), min_size=200, max_size=300))
def test_other_addresses_stay_or_become_canonical(spark, given_urls):
    once = _eval(spark, given_urls, "string", urls.canonical_url)
    assert all(u == c or c.startswith("https://www.youtube.com/watch?v=") for u, c in zip(given_urls, once))
    assert _eval(spark, once, "string", urls.canonical_url) == once


# ------------------------------------------------------------------ strict JSON
SCALAR = st.one_of(st.none(), st.booleans(), st.integers(-10**12, 10**12),
                   st.floats(allow_nan=False, allow_infinity=False, width=32),
                   st.text(alphabet="ab \"\\é", max_size=6))
JSONV = st.recursive(SCALAR, lambda c: st.one_of(st.lists(c, max_size=3),
                                                 st.dictionaries(st.text(alphabet="kx", max_size=3), c, max_size=3)),
                     max_leaves=6)


def _mangle(draw_pair):
    v, how = draw_pair
    s = json.dumps(v)
    return {"plain": s, "junk": s + " junk", "lead": "x" + s, "spaces": "  " + s + "\n", "cut": s[:-1],
            "two": s + " " + s, "single": s.replace('"', "'")}[how]


CANDIDATE = st.tuples(JSONV, st.sampled_from(["plain", "junk", "lead", "spaces", "cut", "two", "single"])).map(_mangle)


def py_ok(s: str) -> bool:
    try:
        json.loads(s)
        return True
    except ValueError:
        return False


@SETTINGS
@given(st.lists(CANDIDATE, min_size=200, max_size=300))
def test_strict_json_property(spark, cands):
    assert _eval(spark, cands, "string", jsonx.strict_json_ok) == [py_ok(c) for c in cands]


# ------------------------------------------------------------------ answer extraction
PROSE = st.text(alphabet="ab é\n\t.", max_size=12)
BODY = JSONV.map(lambda v: json.dumps({"a": v}, ensure_ascii=False))


@SETTINGS
@given(st.lists(st.tuples(PROSE, st.sampled_from(["```json", "```"]), BODY, PROSE, st.sampled_from(["", "more ``` fences"])),
                min_size=200, max_size=300))
def test_fenced_answer_gives_back_its_body(spark, drawn):
    wrapped = [f"{before}{fence}\n {body}\n```{after}{tail}" for before, fence, body, after, tail in drawn]
    assert _eval(spark, wrapped, "string", jsonx.fenced_json) == [body for _, _, body, _, _ in drawn]


@SETTINGS
@given(st.lists(st.tuples(PROSE, BODY, PROSE), min_size=200, max_size=300))
def test_outer_object_gives_back_its_body(spark, drawn):
    assert _eval(spark, [a + body + b for a, body, b in drawn], "string", jsonx.outer_object) == [body for _, body, _ in drawn]
    plain = [a + b for a, _, b in drawn]                                                    # no braces: as it is
    assert _eval(spark, plain, "string", jsonx.outer_object) == plain
    assert _eval(spark, plain, "string", jsonx.fenced_json) == plain


# ------------------------------------------------------------------ blocked helpers
VIDEOS = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40)), min_size=1, max_size=4)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(VIDEOS, st.integers(1, 6), st.integers(1, 3), st.randoms(use_true_random=False))
def test_blocked_helpers_property(spark, videos, block, super_size, rnd):
    from pyspark.sql import Window
    from reelflow.operators import blocked
    rows, seen = [], set()
    for vid, n in videos:
        if vid in seen:
            continue
        seen.add(vid)
        rows += [(vid, p, float(rnd.randint(-5, 5)), float(rnd.randint(0, 3))) for p in range(n)]
    if not rows:
        return
    d = spark.createDataFrame(rows, "video_id long, pos int, v double, t double")
    b = blocked.pos_block("pos", block)
    rs = blocked.running_sum(d, ["video_id"], "pos", "v", "rs", block=b, key_totals={"tot": F.col("v")},
                             super_size=super_size)
    nx = blocked.next_in_order(d, ["video_id"], ["t", "pos"], ["pos"], blocked.time_block("t", 2.0),
                               super_size=super_size)
    pv = blocked.prev_in_order(d, ["video_id"], ["pos"], ["v"], b, super_size=super_size)
    w = Window.partitionBy("video_id").orderBy("pos")
    want = (d.withColumn("rs", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("tot", F.sum("v").over(Window.partitionBy("video_id")))
             .withColumn("next_pos", F.lead("pos").over(Window.partitionBy("video_id").orderBy("t", "pos")))
             .withColumn("prev_v", F.lag("v").over(w)))
    key = ["video_id", "pos"]
    assert sorted(rs.select(*key, "rs", "tot").collect()) == sorted(want.select(*key, "rs", "tot").collect())
    assert sorted(nx.select(*key, "next_pos").collect()) == sorted(want.select(*key, "next_pos").collect())
    assert sorted(pv.select(*key, "prev_v").collect()) == sorted(want.select(*key, "prev_v").collect())
