"""Ridge folds against a loop, and what ranking a whole table moves."""

import numpy as np
from pyspark.sql import functions as F

from veriframe.operators import models as M
from veriframe.operators import ranking


def test_residual_ridge_equals_held_out_predictions(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) * [1.0, 20.0, 0.1] + [0.0, 5.0, 3.0]
    y = 4.0 + x @ [0.5, 0.02, 2.0] + rng.normal(size=300)
    df = spark.createDataFrame([(f"k{i}", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id string, a double, b double, c double, y double")
    alphas, betas = (1.0, 50.0), [0.0, 0.5, 1.0, 1.5]
    fold = {r["id"]: (r["rn"] - 1) % 5 for r in ranking.hash_rank(df, [], F.col("id"), "folds").collect()}
    f = np.array([fold[f"k{i}"] for i in range(300)])
    score = {}
    for alpha in alphas:
        for beta in betas:
            p = np.zeros(300)
            for k in range(5):
                t = f != k
                mu, sd, my = x[t].mean(0), x[t].std(0), y[t].mean()
                z = (x[t] - mu) / sd
                p[~t] = my + beta * ((x[~t] - mu) / sd) @ np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y[t] - my))
            score[alpha, beta] = np.corrcoef(p, y)[0, 1]
    got = M.residual_ridge_cv(df, F.col("id"), ["a", "b", "c"], "y", alphas, betas)
    best = max(score, key=score.get)
    assert np.isclose(got["score"], score[best], atol=1e-9) and (got["alpha"], got["beta"]) == best


def test_ranks_of_a_whole_table_move_its_rows_once(spark):
    df = spark.range(1000).withColumn("k", F.col("id").cast("string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ranking.hash_rank(df, [], F.col("k"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
