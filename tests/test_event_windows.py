"""Event windows against loops over all pairs, and what their plans move."""

import math
import random

from pyspark.sql import functions as F

from veriframe.operators import timeseries as TS
from veriframe.plans import catalog

SMALL = "/root/testdata/sf0.001"


def drawn(spark):
    rng = random.Random(4)
    # Whole and half windows apart, so that many spikes fall on an edge.
    spikes = [(k, rng.choice("ab"), u, float(rng.randrange(-8, 40)) / 2) for k in (0, 1) for u in range(6) for _ in range(30)]
    events = [(k, i, i, float(rng.randrange(0, 30)) / 2) for k in (0, 1) for i in range(15)]
    return spikes, events, spark.createDataFrame(spikes, "key long, region string, unit long, t double"), spark.createDataFrame(events, "key long, event_id long, ordinal long, at double")


def test_event_windows_equal_loop(spark):
    spikes, events, s, e = drawn(spark)
    got = {tuple(r)[:5]: tuple(r)[5:] for r in TS.event_windows(s, e, ["key"], 2.0).select("key", "event_id", "ordinal", "region", "unit", "n_response", "n_baseline").collect()}
    want = {}
    for k, i, o, at in events:
        for sk, region, unit, t in spikes:
            if sk == k and at - 2.0 <= t < at + 2.0:
                n = want.setdefault((k, i, o, region, unit), [0, 0])
                n[t < at] += 1
    assert got == {k: tuple(v) for k, v in want.items()}


def test_change_profile_equals_loop(spark):
    spikes, events, s, e = drawn(spark)
    got = {(r["key"], r["region"]): (r["response_hz"], r["odd_hz"], r["even_hz"]) for r in TS.change_profile(s, e, ["key"], 2.0).collect()}
    for (k, region), rates in got.items():
        units = len({u for sk, g, u, _ in spikes if (sk, g) == (k, region)})
        for rate, part in zip(rates, ((0, 1), (0,), (1,)), strict=True):
            own = [at for ek, _, o, at in events if ek == k and o % 2 in part]
            signed = sum((1 if t >= at else -1) for at in own for sk, g, _, t in spikes if (sk, g) == (k, region) and at - 2.0 <= t < at + 2.0)
            assert abs(rate - signed / len(own) / (units * 2.0)) < 1e-12


def test_pairs_of_events_and_spikes_are_not_moved(spark):
    """Nothing is grouped or exchanged after events meet spikes (j13), and a profile (e02) forms no pairs at all."""
    plan = lambda name: catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    above = plan("j13_spike_windows").split("Join")[0]
    assert "Aggregate" not in above and "Exchange" not in above
    assert "Join [session#" in plan("e02_change_profile") and not [x for x in plan("e02_change_profile").splitlines() if "Join" in x and "t#" in x and "w0#" in x]


def test_bins_of_running_sums_equal_those_of_pairs(spark):
    """Spikes that stand exactly on a bin's edge fall where the floor of their rounded distance puts them."""
    rng = random.Random(12)
    ats = [rng.choice([0, 3, 900, 2_600_000]) + rng.randrange(4_000_000) / 1e6 for _ in range(40)] * 2
    events = [(g, at, i) for g in (0, 1) for i, at in enumerate(ats)]
    times = [round(rng.choice(ats) * 1e6 + rng.choice([0, 0, 1, -1]) + rng.randrange(-5, 10) * 900_000_000) / 1e6 for _ in range(600)]
    spikes = [(g, i % 7, rng.choice(["a", "b"]), t) for g in (0, 1) for i, t in enumerate(times)]
    want = {}
    for g, _, region, t in spikes:
        for h, at, i in events:
            w0 = at - 3600.0
            if g == h and w0 <= t < at + 7200.0:
                b = min(math.floor((t - w0) / 900.0), 11)
                n = want.setdefault((g, region, b), [0, 0, 0])
                n[0] += 1
                n[1 + i % 2] += 1
    e = spark.createDataFrame(events, "session int, at double, ordinal int").select("session", "at", (F.col("ordinal") % 2 == 0).alias("even"))
    s = spark.createDataFrame(spikes, "session int, unit int, region string, t double")
    df = TS.bin_counts(s, e, ["session"], -3600.0, 7200.0, 900.0, 12)
    assert {(r["session"], r["region"], r["bin"]): [r["n"], r["n0"], r["n1"]] for r in df.collect() if r["n"]} == want
