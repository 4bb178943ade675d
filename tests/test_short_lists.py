"""Event windows whose short lists of spikes are columns."""

import random

from veriframe.operators import timeseries as TS
from veriframe.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_short_lists_are_counted_in_generated_code(spark):
    """One join counts without a function of each element; the other sees longer lists only."""
    plan = catalog.QUERIES["j13_spike_windows"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and sum("lambda" in line for line in joins) == 1


def test_lists_of_any_length_equal_loop(spark):
    rng = random.Random(9)
    times = [(k, "ab"[u % 2], u, rng.randrange(0, 80) / 4) for k in (0, 1) for u, n in enumerate((1, 2, 4, 5, 9, 40)) for _ in range(n)]
    events = [(k, i, rng.randrange(0, 80) / 4) for k in (0, 1, 2) for i in range(12)]
    df = TS.event_windows(spark.createDataFrame(times, "key long, region string, unit long, t double"), spark.createDataFrame(events, "key long, event_id long, at double"), ["key"], 2.0)
    want = {}
    for k, i, at in events:
        for sk, region, unit, t in times:
            if sk == k and at - 2.0 <= t < at + 2.0:
                want.setdefault((k, i, region, unit), [0, 0])[t < at] += 1
    assert {(r["key"], r["event_id"], r["region"], r["unit"]): [r["n_response"], r["n_baseline"]] for r in df.collect()} == want
