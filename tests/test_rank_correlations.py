"""Rank correlations over replicates: exact values, few moved rows, odd units."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriframe.operators import inference
from veriframe.plans import catalog


def moved_rows(spark) -> int:
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def ranks(values) -> np.ndarray:
    v = np.asarray(values)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_rank_correlations_by_force(spark):
    rng = np.random.default_rng(3)
    x, ys = rng.integers(0, 30, 400) / 7.0, np.column_stack([rng.integers(0, 4, 400), rng.random(400), np.ones(400)]).astype(float)
    df = spark.createDataFrame([(float(a), list(map(float, b))) for a, b in zip(x, ys, strict=True)], "x double, ys array<double>")
    got = {r["rep"]: r["rho"] for r in inference.rank_correlations(df, "x", "ys").collect()}
    assert got[2] == 0.0 and all(abs(got[k] - np.corrcoef(ranks(x), ranks(ys[:, k]))[0, 1]) < 1e-12 for k in (0, 1))
    assert inference.rank_correlations(df.limit(0), "x", "ys").collect() == []


def test_permuted_values_are_those_of_the_permutations(spark):
    units = spark.createDataFrame([(k * 3, float(k % 5)) for k in range(120)], "root bigint, cx double")
    value = {r["root"]: r["cx"] for r in units.collect()}
    place = {r["root"]: r["idx"] for r in inference.index_units(units, [], "root").collect()}
    want = {(place[r["root"]], r["rep"]): value[r["other"]] for r in inference.permutations(units.select("root"), [], "root", 4, "s").collect()}
    got = {(r["idx"], k): v for r in inference.permuted_values(units, "root", "cx", 4, "s").collect() for k, v in enumerate(r["moved"])}
    assert got == want and len(got) == 480


def test_topographic_constraint_moves_no_pairs_for_replicates(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.random(8)], int(k % 7)) for k in range(300)]
    rows += [(300, [1.0] * 8, 3), (301, None, 2), (302, [1.0] * 8, None)]  # no spread counts as 1; no vector or no place: no unit
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = moved_rows(spark)
    got = catalog.QUERIES["i37_topographic_constraint"](spark, str(tmp_path)).collect()
    assert len(got) == 1 and -1 < got[0]["observed"] < 1 and got[0]["null_median"] == pytest.approx(0, abs=0.1)
    assert moved_rows(spark) - before < 301 * 16 * 20
