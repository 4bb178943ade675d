"""The smallest value from a position on, without a frame that starts anew at every row."""

import random

import pytest

from veriframe.operators import ranking
from veriframe.plans import catalog


def test_no_window_shrinks_towards_the_end(spark):
    plan = catalog.QUERIES["w08_benjamini_hochberg"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan and "1, unboundedfollowing$()" not in plan
    assert "unboundedpreceding$(), currentrow$()" in plan


@pytest.mark.parametrize("group", [[], ["g"]])
def test_suffix_min_equals_loop(spark, monkeypatch, group):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 25)
    rng = random.Random(3)
    rows = [(g, None if i == 0 else i / 7, rng.choice([None, rng.random()])) for g in ("a", "b", None) for i in range(120 if g else 9)]
    if not group:
        rows = [(g, None if x is None else x + 50 * "ab".find(g or "-"), v) for g, x, v in rows if g is not None or x is not None]
        rows = list({x: (g, x, v) for g, x, v in rows}.values())
    got = {(r["g"], r["x"]): r["sfx"] for r in ranking.suffix_min(spark.createDataFrame(rows, "g string, x double, v double"), group, "x", "v").collect()}
    place = lambda x: (x is not None, x or 0)
    for g, x, _ in rows:
        later = [v for h, y, v in rows if (not group or h == g) and place(y) >= place(x) and v is not None]
        assert got[g, x] == min(later, default=None)
    assert len(got) == len(rows)
