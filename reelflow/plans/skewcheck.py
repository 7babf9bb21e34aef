"""Measure how a hot video spreads over tasks: ``python -m reelflow.plans.skewcheck [HOT_ROWS]``.

Builds a corpus where one video holds almost every segment, runs the ordered
and blocked operators with Spark's event log on (written under the session's
``spark.checkpoint.dir``), and prints, per stage, the records processed and the
largest single task's share. A plain ``PARTITION BY video_id`` window would put
the hot video's share in one task.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import uuid


def _read_events(folder: str):
    import zstandard
    for f in sorted(glob.glob(os.path.join(folder, "*", "events_*")) + glob.glob(os.path.join(folder, "*"))):
        if os.path.isdir(f):
            continue
        with open(f, "rb") as fh:
            stream = zstandard.ZstdDecompressor().stream_reader(fh) if f.endswith(".zstd") else fh
            for line in io.TextIOWrapper(stream, encoding="utf-8"):
                yield json.loads(line)


def main(argv: list[str]) -> None:
    from pyspark.sql import functions as F

    from reelflow.operators import images, intervals, prompts, timeline
    from reelflow.session import build_session

    hot_rows = int(argv[0]) if argv else 200_000
    probe = build_session(app="reelflow-skewcheck-probe")
    from reelflow.session import checkpoint_root
    root = os.path.join(checkpoint_root(probe), f"skewcheck-{uuid.uuid4().hex[:8]}")
    probe.stop()
    events = os.path.join(root, "events")
    os.makedirs(events, exist_ok=True)
    spark = build_session(app="reelflow-skewcheck", shuffle_partitions=32,
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": events,
                                 "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    hot = spark.range(hot_rows).select(F.lit(0).cast("long").alias("video_id"), F.col("id").cast("int").alias("pos"))
    small = (spark.range(1, 101).withColumnRenamed("id", "video_id")
                  .select("video_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("pos")))
    segs = (hot.unionByName(small).withColumn("start_s", F.col("pos") * 2.0)
               .withColumn("end_s", F.col("pos") * 2.0 + F.when(F.col("pos") % 7 == 0, 0.5).otherwise(1.8))
               .withColumn("text", F.concat(F.lit("word "), F.col("pos").cast("string"))))
    path = os.path.join(root, "segments")
    segs.write.parquet(path)
    segs = spark.read.parquet(path)
    frames = (segs.filter(F.col("pos") % 7 == 3)
                  .select("video_id", F.col("pos").alias("section_index"), F.col("start_s").alias("timestamp"),
                          F.lit("f").alias("frame_file")))
    secs = (segs.filter(F.col("pos") % 3 == 0)
                .select("video_id", (F.col("pos") / 3).cast("int").alias("section_index"),
                        F.col("start_s").alias("start_time"), (F.col("start_s") + 5.0).alias("end_time")))
    results = secs.select("video_id", "section_index", F.col("start_time").alias("timestamp_s"),
                          F.lit("diffusers").alias("backend"),
                          F.when(F.col("section_index") % 5 == 0, 429).otherwise(200).alias("status_code"))
    runs = {
        "timeline_text": timeline.timeline_text(segs),
        "section_segments": intervals.section_segments(secs, segs),
        "image_progress": images.progress(secs, results),
        "rule_sections": prompts.rule_sections(segs),
        "frame_asof": intervals.frame_at(segs.select("video_id", "pos", "start_s"),
                                         intervals.frame_intervals(frames), "start_s"),
    }
    for name, df in runs.items():
        spark.sparkContext.setJobGroup(name, name)
        df.write.format("noop").mode("overwrite").save()
    spark.stop()

    group, tasks = {}, {}
    for e in _read_events(events):
        if e["Event"] == "SparkListenerJobStart":
            for s in e["Stage IDs"]:
                group[s] = e.get("Properties", {}).get("spark.jobGroup.id")
        elif e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
            m = e["Task Metrics"]
            tasks.setdefault(e["Stage ID"], []).append(m["Shuffle Read Metrics"]["Total Records Read"])
    print(f"hot video: {hot_rows} of {hot_rows + 1000} segments; 32 shuffle partitions")
    for s, recs in sorted(tasks.items()):
        total = sum(recs)
        if group.get(s) in runs and total:
            print(f"{group[s]:16s} stage {s:3d}  shuffled records {total:8d}  largest task {max(recs):7d} "
                  f"({max(recs) / total:.0%})")


if __name__ == "__main__":
    sys.path.insert(0, os.getcwd())
    main(sys.argv[1:])
