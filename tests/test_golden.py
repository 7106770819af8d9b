"""The published scores, from the published predictions, in the folder that PREDICTIONS_DIR names."""

import os
import re
from pathlib import Path

import pytest

from mojiforge.operators import metrics

FOLDER = os.environ.get("PREDICTIONS_DIR", "")
BLOCK = re.compile(r"^(\d+)\nsrc: (.*)\ntgt: (.*)\npre: (.*)\n(positive|negative)\n", re.M)


@pytest.mark.skipif(not FOLDER, reason="PREDICTIONS_DIR names no folder of published predictions")
def test_published_scores(spark):
    found = [m for p in sorted(Path(FOLDER).iterdir()) if p.is_file() for m in BLOCK.findall(p.read_text(encoding="utf-8"))]
    assert len(found) == 1009 and sum(m[4] == "positive" for m in found) == 504
    rows = spark.createDataFrame([(int(m[0]), m[1], m[2], m[3], m[4]) for m in found], "id long, source string, target string, pred string, type string")
    got = metrics.final_scores(rows).first().asDict()
    assert 0.7041 in [round(v, 4) for v in got.values() if isinstance(v, float)], got
    s = metrics.sentence_scores(rows).first()
    assert (s.hit_num, s.pred_num, s.ref_num) == (280, 380, 502)
