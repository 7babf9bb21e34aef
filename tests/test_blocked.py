"""Skew-safe helpers equal the plain per-key window on data spanning many blocks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelflow.operators import blocked, ordered


def _data(spark):
    rows = [(k, p, float((k * 31 + p * 7) % 13), f"t{k}_{p}") for k in range(3) for p in range(50 if k else 400)]
    return spark.createDataFrame(rows, "video_id long, pos int, v double, text string")


def test_running_sum_matches_window(spark):
    d = _data(spark)
    got = blocked.running_sum(d, ["video_id"], "pos", "v", "rs", block=blocked.pos_block("pos", 7))
    w = Window.partitionBy("video_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    want = d.withColumn("rs", F.sum("v").over(w))
    assert sorted(got.select("video_id", "pos", "rs").collect()) == sorted(want.select("video_id", "pos", "rs").collect())


def test_next_in_order_matches_lead(spark):
    d = _data(spark).withColumn("t", (F.col("pos") * 3 % 101).cast("double") + F.col("pos") / 1000)
    got = blocked.next_in_order(d, ["video_id"], ["t", "pos"], ["t", "pos"], blocked.time_block("t", 5.0))
    w = Window.partitionBy("video_id").orderBy("t", "pos")
    want = d.withColumn("next_t", F.lead("t").over(w)).withColumn("next_pos", F.lead("pos").over(w))
    cols = ["video_id", "pos", "next_t", "next_pos"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())


def test_ordered_concat_across_blocks(spark):
    d = _data(spark)
    got = ordered.ordered_concat(d, ["video_id"], "pos", "text", "|", "s", count_as="n", block_size=16)
    res = {r.video_id: (r.s, r.n) for r in got.collect()}
    for k, n in ((0, 400), (1, 50), (2, 50)):
        assert res[k] == ("|".join(f"t{k}_{p}" for p in range(n)), n)


def test_ordered_collect_across_blocks(spark):
    d = _data(spark)
    got = ordered.ordered_collect(d, ["video_id"], "pos", F.struct("pos", "text"), "xs", block_size=16)
    res = {r.video_id: r.xs for r in got.collect()}
    assert [x.pos for x in res[0]] == list(range(400)) and res[0][5].text == "t0_5"


def test_prev_in_order_matches_lag(spark):
    d = _data(spark)
    got = blocked.prev_in_order(d, ["video_id"], ["pos"], ["v", "text"], blocked.pos_block("pos", 7))
    w = Window.partitionBy("video_id").orderBy("pos")
    want = d.withColumn("prev_v", F.lag("v").over(w)).withColumn("prev_text", F.lag("text").over(w))
    cols = ["video_id", "pos", "prev_v", "prev_text"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())


def test_null_keys_are_kept(spark):
    d = spark.createDataFrame([(None, 0, 1.0), (None, 1, 2.0), (1, 0, 5.0)], "video_id long, pos int, v double")
    got = sorted(blocked.running_sum(d, ["video_id"], "pos", "v", "rs").collect(),
                 key=lambda r: (r.video_id is not None, r.video_id or 0, r.pos))
    assert [(r.video_id, r.pos, r.rs) for r in got] == [(None, 0, 1.0), (None, 1, 3.0), (1, 0, 5.0)]
    nx = blocked.next_in_order(d, ["video_id"], ["pos"], ["v"], blocked.pos_block("pos", 1))
    assert sorted((r.pos, r.next_v) for r in nx.collect() if r.video_id is None) == [(0, 2.0), (1, None)]


def test_two_level_carry_with_tiny_super_blocks(spark):
    d = _data(spark)
    w = Window.partitionBy("video_id").orderBy("pos")
    got = blocked.running_sum(d, ["video_id"], "pos", "v", "rs", block=blocked.pos_block("pos", 3), super_size=2,
                              key_totals={"tot": F.col("v")})
    want = d.withColumn("rs", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))) \
            .withColumn("tot", F.sum("v").over(Window.partitionBy("video_id")))
    cols = ["video_id", "pos", "rs", "tot"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())
    nx = blocked.next_in_order(d, ["video_id"], ["pos"], ["v"], blocked.pos_block("pos", 3), super_size=2)
    pv = blocked.prev_in_order(d, ["video_id"], ["pos"], ["v"], blocked.pos_block("pos", 3), super_size=2)
    want2 = d.withColumn("next_v", F.lead("v").over(w)).withColumn("prev_v", F.lag("v").over(w))
    assert sorted(nx.select("video_id", "pos", "next_v").collect()) == \
        sorted(want2.select("video_id", "pos", "next_v").collect())
    assert sorted(pv.select("video_id", "pos", "prev_v").collect()) == \
        sorted(want2.select("video_id", "pos", "prev_v").collect())


def test_two_level_carry_skips_empty_blocks(spark):
    rows = [(1, p, float(p)) for p in (0, 1, 40, 41, 90, 300)]
    d = spark.createDataFrame(rows, "video_id long, pos int, v double")
    nx = blocked.next_in_order(d, ["video_id"], ["pos"], ["v"], blocked.pos_block("pos", 4), super_size=2)
    assert sorted((r.pos, r.next_v) for r in nx.collect()) == [(0, 1.0), (1, 40.0), (40, 41.0), (41, 90.0),
                                                                (90, 300.0), (300, None)]
    rs = blocked.running_sum(d, ["video_id"], "pos", "v", "rs", block=blocked.pos_block("pos", 4), super_size=2)
    assert sorted((r.pos, r.rs) for r in rs.collect()) == [(0, 0.0), (1, 1.0), (40, 41.0), (41, 82.0),
                                                           (90, 172.0), (300, 472.0)]
