"""Ranks, bounds, nulls and text operators against brute force on small fixtures."""

import math
import random

from pyspark.sql import functions as F

from veriframe.functions import tails, text
from veriframe.operators import graph, inference, pairs, ranking, risk, selection
from veriframe.sources import files, sinks


def test_benjamini_hochberg_known_values(spark):
    d = spark.createDataFrame([("a", 0.03), ("b", 0.001), ("c", 0.04), ("d", 0.20), ("e", 0.009)], "t string, p double")
    q = {r["t"]: round(r["q"], 10) for r in ranking.benjamini_hochberg(d, [], "p").collect()}
    assert q == {"b": 0.005, "e": 0.0225, "a": 0.05, "c": 0.05, "d": 0.2}


def test_ranks_equal_sorted_positions_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(("hot" if i % 3 else f"g{i % 7}"), i, float(rng.randint(0, 40))) for i in range(900)]
    d = spark.createDataFrame(rows, "g string, id int, v double")
    got = {r["id"]: r["rn"] for r in ranking.value_rank(d, ["g"], F.col("v"), [F.col("id")]).collect()}
    for g in {r[0] for r in rows}:
        for pos, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])), 1):
            assert got[r[1]] == pos
    avg = {(r["g"], r["v"]): r["avg_rank"] for r in ranking.average_ranks(d, ["g"], "v").collect()}
    hot = sorted(r[2] for r in rows if r[0] == "hot")
    for v in set(hot):
        assert avg["hot", v] == sum(i + 1 for i, x in enumerate(hot) if x == v) / hot.count(v)


def test_even_thinning_keeps_linspace_positions(spark):
    for n, k in ((10, 4), (103, 17), (5, 9)):
        d = spark.range(n).withColumn("v", F.col("id").cast("double"))
        got = sorted(r["id"] for r in selection.thin_evenly(d, [], F.col("v"), [], k).collect())
        want = list(range(n)) if n <= k else sorted({math.floor(round(j * (n - 1) / (k - 1), 9)) for j in range(k)})
        assert got == want


def test_exact_bounds_against_binomial_sums():
    def tail(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for k, n in ((0, 10), (3, 20), (7, 9), (10, 10)):
        u = float(tails.binomial_bound([k], [n], 0.95, "upper")[0])
        assert u == 1.0 if k == n else abs(tail(k, n, u) - 0.05) < 1e-9
        lo = float(tails.binomial_bound([k], [n], 0.95, "lower")[0])
        assert lo == 0.0 if k == 0 else abs((1 - tail(k - 1, n, lo)) - 0.05) < 1e-9


def test_threshold_curve_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, f"u{i % 9}", round(rng.random(), 1), rng.random() < 0.6, rng.random() < 0.8) for i in range(120)]
    d = spark.createDataFrame(rows, "case_id int, unit_id string, score double, label boolean, admissible boolean")
    for r in risk.threshold_curve(d).collect():
        on = [x for x in rows if x[4] and x[2] >= r["threshold"]]
        assert r["failing"] == len({x[1] for x in on if not x[3]}) and r["authorized"] == len({x[1] for x in on})
        assert r["recovered"] == len({x[1] for x in on if x[3]}) and r["authorizations"] == len(on)


def test_dyadic_meat_equals_double_sum(spark):
    rng = random.Random(7)
    rows = [(i, j, rng.gauss(0, 1)) for i in range(5) for j in range(5) if i != j]
    want = sum(a[2] * b[2] for a in rows for b in rows if {a[0], a[1]} & {b[0], b[1]})
    got = pairs.dyadic_meat(spark.createDataFrame(rows, "pre int, post int, s double"), ["s"])
    assert abs(got[0][0] - want) < 1e-9


def test_energy_and_rank_sum_against_pairs(spark):
    rng = random.Random(11)
    a = [rng.randint(0, 9) for _ in range(40)]
    b = [rng.randint(2, 12) for _ in range(30)]
    mean = lambda x, y: sum(abs(i - j) for i in x for j in y) / (len(x) * len(y))
    d = spark.createDataFrame([(float(v), True) for v in a] + [(float(v), False) for v in b], "v double, s boolean")
    assert abs(inference.mean_abs_difference(d, [], "v", "s").first()["energy"] - (2 * mean(a, b) - mean(a, a) - mean(b, b))) < 1e-9
    g = spark.createDataFrame([("ctl", float(v)) for v in a] + [("x", float(v)) for v in b], "g string, v double")
    r = inference.mann_whitney(g, "g", "v", "ctl").first()
    assert r["u"] == sum((j > i) + 0.5 * (i == j) for i in a for j in b) and 0 < r["p"] <= 1


def test_pareto_frontier_equals_all_pairs(spark):
    rng = random.Random(13)
    pts = [(i, float(rng.randint(0, 9)), float(rng.randint(0, 9)), rng.randint(0, 3)) for i in range(150)]
    dom = lambda o, p: o[1] <= p[1] and o[2] >= p[2] and o[3] >= p[3] and (o[1] < p[1] or o[2] > p[2] or o[3] > p[3])
    want = {p[0] for p in pts if not any(dom(o, p) for o in pts)}
    d = spark.createDataFrame(pts, "id int, cost double, gain double, claims int")
    assert {r["id"] for r in selection.pareto_frontier(d, "cost", "gain", "claims").collect()} == want


def test_cycles_and_hops(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "c", "d"), (2, "a", "b")], "package_id int, parent string, child string")
    assert {(r["parent"], r["child"]) for r in graph.cyclic_core(e).collect()} == {("a", "b"), ("b", "c"), ("c", "a")}
    h = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "source_id int, target_id int")
    got = {r["node"]: r["hops"] for r in graph.hop_distances(h, spark.createDataFrame([("s", 1)], "source string, node int")).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}


def test_pattern_offsets_and_negation(spark):
    body = "We do not claim causal effect. Yet a causal effect appears."
    d = spark.createDataFrame([(body,)], "text string")
    hits = d.select(F.explode(text.pattern_hits(F.col("text"), text.RISK_PATTERNS[1][3])).alias("h"), "text")
    got = [(r["s"], r["n"]) for r in hits.select(F.col("h.start").alias("s"), text.negated_before(F.col("text"), F.col("h.start"), text.RISK_PATTERNS[1][4]).alias("n")).collect()]
    first = body.index("causal effect")
    assert [s for s, _ in got] == [first, body.index("causal effect", first + 1)] and got[0][1]


def test_sources_and_sinks_round_trip(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": 1, "claim": "x"}\n\n{"id": 2, "claim": "y"}\n')
    assert files.read_jsonl(spark, str(tmp_path / "c.jsonl"), "id bigint, claim string").count() == 2
    (tmp_path / "co.csv").write_text("1,2,3,4\n5,6,7,8\n")
    assert files.read_headerless_csv(spark, str(tmp_path / "co.csv")).agg(F.sum("unit_id")).first()[0] == 10
    (tmp_path / "u.csv").write_text("a,b\n1,x\n2,y\n")
    assert [r["b"] for r in files.read_csv(spark, str(tmp_path / "u.csv"), "a int, b string", ["b"]).collect()] == ["x", "y"]
    (tmp_path / "m.tex").write_text("A text.\nMore.")
    assert files.read_manuscripts(spark, [str(tmp_path / "none*.tex")], [str(tmp_path / "*.tex")]).count() == 1
    art = files.read_json_artifacts(spark, str(tmp_path / "c.jsonl"))
    exp = spark.createDataFrame([("gone.json",)], "path string")
    assert files.missing_artifacts(exp, art).count() == 1
    import hashlib

    raw = (tmp_path / "u.csv").read_bytes()
    man = spark.createDataFrame([("u.csv", hashlib.sha256(raw).hexdigest(), len(raw)), ("absent", "0", 1)], "name string, sha256 string, bytes bigint")
    assert {r["name"]: r["ok"] for r in files.verify_files(spark, str(tmp_path / "u.csv"), man).collect()} == {"u.csv": True, "absent": False}
    out = spark.createDataFrame([(1, ["a", "b"])], "k int, v array<string>")
    sinks.save_rows(out, str(tmp_path / "rows"), ("v",))
    assert spark.read.option("header", True).csv(str(tmp_path / "rows")).first()["v"] == "a|b"
    sinks.save_run(out, str(tmp_path / "run"), '{"a":1}')
    assert spark.read.parquet(str(tmp_path / "run")).first()["config_hash"] == hashlib.sha256(b'{"a":1}').hexdigest()[:12]
    sinks.save_summary(out, str(tmp_path / "sum"))
    assert spark.read.text(str(tmp_path / "sum")).first()[0] == '{"k":1,"v":["a","b"]}'
    tr = spark.createDataFrame([("urn:x", "p", 'say "hi"')], "subject string, predicate string, object string")
    assert sinks.ntriples(tr).first()["value"] == '<urn:x> <urn:p:p> "say \\"hi\\"" .'
    assert spark.range(1).select(sinks.identifier("artifact", F.lit("a b/c"))).first()[0] == "urn:artifact:a%20b%2Fc"


def test_claim_specs_and_contract_audit(spark):
    from veriframe.operators.contracts import audit_contracts
    from veriframe.sources.specs import claim_specs, expectations

    specs = claim_specs(spark, [
        {"claim_id": "a", "claim_type": "x", "scope": "s", "permitted_wording": "w", "required_artifacts": [{"path": "p.json", "expectations": [{"key": "n.k", "min": 2}, {"key": "ok", "equals": True}]}]},
        {"claim_id": "b", "claim_type": "x", "scope": "s", "permitted_wording": "w", "required_artifacts": [{"path": "gone.json"}]},
    ])
    art = spark.createDataFrame([("p.json", '{"n": {"k": 3}, "ok": true}')], "path string, payload string")
    got = {r["claim_id"]: r["status"] for r in audit_contracts(expectations(specs), art).collect()}
    assert got == {"a": "supported", "b": "blocked"}
    assert specs.first()["severity"] == "medium"


def test_grouped_logistic_reaches_the_stationary_point(spark):
    import numpy as np

    from veriframe.operators.models import grouped_logistic

    rng = random.Random(17)
    rows = [(g, x, int(rng.random() < 1 / (1 + math.exp(-(0.5 + g) * x)))) for g in range(2) for x in (rng.gauss(0, 1) for _ in range(150))]
    fit = grouped_logistic(spark.createDataFrame(rows, "g int, x double, y int"), ["g"], ["x"], "y")
    for r in fit.collect():
        z = np.array([(x - r["mu"][0]) / r["sd"][0] for g, x, _ in rows if g == r["g"]])
        y = np.array([v for g, _, v in rows if g == r["g"]])
        p = 1 / (1 + np.exp(-(r["coef"][0] + r["coef"][1] * z)))
        assert abs((p - y).sum()) < 1e-6 and abs(((p - y) * z).sum() + r["coef"][1]) < 1e-6


def test_order_is_cut_by_ties_and_needs_no_early_job(spark, monkeypatch):
    """A value that a third of the rows hold is spread over buckets; ranks and quantiles equal sorting."""
    import numpy as np

    from veriframe.operators import ranking

    monkeypatch.setattr(ranking, "BUCKET_ROWS", 100)
    monkeypatch.setattr(ranking, "COARSE", 4)
    rng = np.random.default_rng(1)
    n = 6_000
    v = np.where(rng.random(n) < 0.35, 5.0, np.round(rng.normal(size=n), 2))
    rows = [(None if k % 50 == 0 else int(g), k, None if k % 97 == 0 else float(x), int(w)) for k, (g, x, w) in enumerate(zip(rng.integers(0, 2, n), v, rng.integers(0, 4, n), strict=True))]
    df = spark.createDataFrame(rows, "g long, id long, v double, w long")
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "no job may run")
    try:
        built = [ranking.value_rank(df, ["g"], F.col("v"), [F.col("id")], descending=d) for d in (False, True)]
        quantiles = ranking.exact_quantiles(df, ["g"], "v", [0.0, 0.1, 0.5, 0.95, 1.0])
        weighted = ranking.exact_quantiles(df, [], "v", [0.5], "w")
        assert not status.getJobIdsForGroup("plans")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for d, got in zip((False, True), built, strict=True):
        for g in (None, 0, 1):
            own = [r for r in rows if r[0] == g]
            want = sorted(own, key=lambda r: ((r[2] is None) == d, 0 if r[2] is None else -r[2] if d else r[2], r[1]))
            assert [r["id"] for r in got.where(F.col("g").eqNullSafe(F.lit(g))).orderBy("rn").collect()] == [r[1] for r in want]
    for r in quantiles.collect():
        own = [x for g, _, x, _ in rows if g == r["g"] and x is not None]
        assert r["n"] == len(own) and np.allclose(r["q"], np.quantile(own, [0.0, 0.1, 0.5, 0.95, 1.0]))
    assert weighted.first()["q"] == [np.median([x for _, _, x, w in rows if x is not None for _ in range(w)])]
    key = ranking._order_key(F.col("v"), [F.col("id")])
    sizes = [r["n"] for r in ranking._bucket(df, key, [F.col("g"), F.col("v"), F.col("id")]).groupBy("_b").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 40 and max(sizes) < 600
    none = df.limit(0)
    assert ranking.exact_quantiles(none, [], "v", [0.5]).collect() == [] and none.select(ranking.median_of(none, "v")).collect() == []


def test_null_groups_and_text_keys_stay(spark):
    from veriframe.operators import inference, ranking

    rows = [("a", 1.0, "x"), ("a", 2.0, "y"), (None, 3.0, "z"), (None, None, "w")]
    df = spark.createDataFrame(rows, "g string, v double, k string")
    assert ranking.hash_rank(df, ["g"], F.col("k")).count() == 4
    ranked = {(r["g"], r["k"]): (r["rn"], r["n"]) for r in ranking.value_rank(df, ["g"], F.col("v"), [F.col("k")]).collect()}
    assert ranked["a", "x"] == (1, 2) and ranked["a", "y"] == (2, 2) and len(ranked) == 4
    tests = ranking.benjamini_hochberg(df, ["g"], "v")
    assert tests.count() == 4 and tests.where("v IS NULL AND q IS NOT NULL").count() == 0
    drawn = inference.bootstrap_counts(df, ["g"], "k", 5, "seed").groupBy("rep", "g").agg(F.sum("times").alias("n")).collect()
    assert all(r["n"] == 2 for r in drawn if r["g"] == "a")


def test_path_lengths_equal_breadth_first_search(spark):
    rng = random.Random(4)
    nodes = list(range(-10, 140))
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(230)] + [(5, 5)]
    want = {}
    for s in nodes:
        dist, queue = {s: 0}, [s]
        for v in queue:
            for a, b in edges:
                if a == v and b not in dist:
                    dist[b] = dist[v] + 1
                    queue.append(b)
        for v, d in dist.items():
            if v != s:
                want[d] = want.get(d, 0) + 1
    e = spark.createDataFrame(edges, "source_id bigint, target_id bigint")
    got = graph.path_lengths(e, spark.createDataFrame([(n,) for n in nodes], "node bigint"))
    assert {r["hops"]: r["pairs"] for r in got.collect()} == want
    assert graph.path_lengths(e.limit(0), spark.createDataFrame([], "node bigint")).collect() == []


def test_stored_claim_specs_have_defaults(spark, tmp_path):
    import pytest

    from veriframe.sources.specs import read_claim_specs

    (tmp_path / "a").write_text('{"claim_id": "c1", "claim_type": "causal", "scope": "all", "permitted_wording": "w"}\n')
    row = read_claim_specs(spark, f"file://{tmp_path}/a").first()
    assert (row["evidence_family"], row["severity"], row["uncertainty_policy"]) == ("causal", "medium", "deterministic")
    assert row["blocked_wording"] == [] and row["required_artifacts"] == [] and row["non_compensatory_requirements"] == []
    (tmp_path / "b").write_text('{"claim_id": "c1", "claim_type": "causal", "permitted_wording": "w"}\n')
    with pytest.raises(Exception, match="without scope"):
        read_claim_specs(spark, f"file://{tmp_path}/b").collect()


def test_continuous_frontier_equals_all_pairs(spark):
    rng = random.Random(3)
    pts = [(i, rng.choice([1.0, rng.random()]), rng.random(), rng.random()) for i in range(700)] + [(900 + i, 1.0, 0.5, 0.5) for i in range(3)]
    pts += [(1000 + i, 0.2 + 0.0007 * i, 0.9 + 0.0001 * i, 0.99 - 0.00005 * i) for i in range(300)]  # a long staircase
    dom = lambda o, p: o[1] <= p[1] and o[2] >= p[2] and o[3] >= p[3] and o[1:] != p[1:]
    want = {p[0] for p in pts if not any(dom(o, p) for o in pts)}
    d = spark.createDataFrame([*pts, (5000, None, 1.0, 1.0)], "id int, cost double, gain double, extra double").repartition(5)
    assert len(want) > 50 and {r["id"] for r in selection.pareto_frontier(d, "cost", "gain", "extra").collect()} == want
    assert {p[:3] for p in selection.staircase([p[1:] for p in pts])} == {p[1:] for p in pts if p[0] in want}


def test_only_large_groups_are_cut_into_buckets(spark, monkeypatch):
    from veriframe.operators import ranking

    monkeypatch.setattr(ranking, "BUCKET_ROWS", 50)
    rng = random.Random(8)
    rows = [(g, i, rng.choice([None, 1.0, 1.0, rng.random()])) for g in (None, *range(20)) for i in range(1200 if g in (None, 3) else 9)]
    df = spark.createDataFrame(rows, "g int, id int, v double").repartition(5).cache()
    key = ranking._order_key(F.col("v"), [F.col("id")])
    cut = {r["g"]: r["n"] for r in ranking._bucket(df, key, [F.col("g"), F.col("v"), F.col("id")], ["g"]).groupBy("g").agg(F.countDistinct("_b").alias("n")).collect()}
    assert all((n > 12) == (g in (None, 3)) and (n == 1) == (g not in (None, 3)) for g, n in cut.items())
    near = ranking.after_neighbour(df, ["g"], "v", [F.col("id")], ["id", "v"]).collect()
    ranked = ranking.value_rank(df, ["g"], F.col("v"), [F.col("id")]).collect()
    running = ranking.cumulative(df, ["g"], "v", {"c": F.count("*")}).collect()
    for g in cut:
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is not None, r[2] or 0.0, r[1]))
        assert {r["id"]: (r["prev_id"], r["prev_v"]) for r in near if r["g"] == g} == {b[1]: a[1:] for a, b in zip(order, order[1:], strict=False)}
        assert [r["id"] for r in sorted((r for r in ranked if r["g"] == g), key=lambda r: r["rn"])] == [r[1] for r in order] and {r["n"] for r in ranked if r["g"] == g} == {len(order)}
        values = [r[2] for r in order]
        assert {(r["v"], r["c"], r["cum_c"], r["all_c"]) for r in running if r["g"] == g} == {(v, values.count(v), len(values) - values[::-1].index(v), len(values)) for v in values}
