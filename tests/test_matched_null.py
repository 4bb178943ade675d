"""Matched nulls against a loop, and path lengths over several words of sources."""

import hashlib
import random

from veriframe.operators import graph
from veriframe.operators import pairs as P


def sha(*parts):
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


def test_matched_null_equals_loop(spark):
    rng = random.Random(2)
    rows = [(s, b, f"{s}-{b}-{i}", i < need, rng.random()) for s in ("p", "q") for b, need, have in (("full", 40, 300), ("even", 30, 30), ("short", 50, 9), ("bare", 7, 0)) for i in range(need + have)]
    want = {}
    for s in ("p", "q"):
        pools = {b: [r for r in rows if r[:2] == (s, b) and not r[3]] for b in ("full", "even", "short", "bare")}
        pools["*"] = [r for p in pools.values() for r in p]
        for rep in range(6):
            drawn = []
            for b in ("full", "even", "short", "bare"):
                con = [r for r in rows if r[:2] == (s, b) and r[3]]
                if len(pools[b]) >= len(con):
                    drawn += [r[4] for r in sorted(pools[b], key=lambda r: (sha(f"seed:{rep}", r[2]), r[2]))[: len(con)]]
                else:
                    src = sorted(pools[b] or pools["*"], key=lambda r: (sha("pool", r[2]), r[2]))
                    drawn += [src[int(sha(f"seed:{rep}", r[2])[:15], 16) % len(src)][4] for r in con]
            want[s, rep] = round(sum(drawn) / len(drawn), 9)
    df = spark.createDataFrame(rows, "stratum string, bin string, pair_id string, connected boolean, m double")
    null = P.matched_null(df, ["stratum"], ["bin"], ["m"], 6, "seed")
    assert {(r["stratum"], r["rep"]): round(r["m"], 9) for r in null.collect()} == want
    moved = [line for line in null._jdf.queryExecution().optimizedPlan().toString().splitlines() if "_pool" in line and "Join Inner" in line]
    assert moved and all("pair_id" not in line for line in moved)  # draws meet their pool by numbers


def test_path_lengths_over_several_words(spark, monkeypatch):
    monkeypatch.setattr(graph, "WORDS", 2)
    n = 300  # two rings and a bridge: three blocks of 128 sources
    edges = [(i, (i + 1) % 150) for i in range(150)] + [(150 + i, 150 + (i + 1) % 150) for i in range(150)] + [(0, 150)]
    got = {r["hops"]: r["pairs"] for r in graph.path_lengths(spark.createDataFrame([e for e in edges if 140 < e[0] < 160 or e[0] == 0], "source_id long, target_id long"), spark.range(n).withColumnRenamed("id", "node")).collect()}
    step = {}
    for a, b in edges:
        if 140 < a < 160 or a == 0:
            step.setdefault(a, []).append(b)
    want = {}
    for s in range(n):
        dist, queue = {s: 0}, [s]
        for v in queue:
            for b in step.get(v, []):
                if b not in dist:
                    dist[b] = dist[v] + 1
                    queue.append(b)
        for d in dist.values():
            want[d] = want.get(d, 0) + (d > 0)
    assert got == {d: k for d, k in want.items() if d}
