"""A hot video must not land in one task: run the skew check in its own JVM and bound each big stage."""

import os
import re
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_no_row_level_stage_gathers_the_hot_video():
    out = subprocess.run([sys.executable, "-m", "reelflow.plans.skewcheck", "200000"], cwd=ROOT,
                         capture_output=True, text=True, timeout=900).stdout
    stages = re.findall(r"^(\w+)\s+stage\s+\d+\s+shuffled records\s+(\d+)\s+largest task\s+(\d+)", out, re.M)
    assert {s[0] for s in stages} >= {"timeline_text", "rule_sections", "frame_asof", "section_segments",
                                      "image_progress"}, out
    big = [(name, int(total), int(top)) for name, total, top in stages if int(total) >= 50_000]
    assert big, out
    for name, total, top in big:
        assert top / total < 0.5, (name, total, top)       # the hot video is 99.5% of the rows
