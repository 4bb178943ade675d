"""Queries on prediction models over line features, embeddings and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions import hashing as H
from veriframe.functions import numeric as N
from veriframe.operators import models as M
from veriframe.operators import ranking, risk, selection
from veriframe.plans.q_risk import CLAIMS4, risk_cases
from veriframe.plans.registry import query
from veriframe.session import cut, stored

r6 = lambda c: F.round(c, 6)
r9 = lambda c: F.round(c, 9)
XS = ["l_quantity", "l_discount", "l_tax"]


def trials(t):
    """Lines as trials with a hash role; the response is the extended price in thousands."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    d = t.lineitem.select("l_suppkey", *XS, (F.col("l_extendedprice") / 1000).alias("y"), key.alias("id"))
    return d.withColumn("tier", F.when(H.hash_mod(F.concat(F.lit("tier:"), F.col("id")), 4) == 0, "test").otherwise("train"))


@query("m01_closed_form_ridge", "WITH m AS (SELECT l_suppkey, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_pop(l_quantity) AS vx, covar_pop(l_quantity,l_extendedprice) AS c, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, round(n*c/(vx*(n+10)),6) AS slope, round(my-mx*n*c/(vx*(n+10)),4) AS intercept FROM m")
def m01(t):
    f = M.ridge_fit(t.lineitem, ["l_suppkey"], ["l_quantity"], "l_extendedprice", 10.0)
    return f.select("l_suppkey", r6(F.col("coef")[0]).alias("slope"), F.round("intercept", 4).alias("intercept"))


def evaluated(test, prediction, name):
    return test.agg(F.lit(name).alias("model"), r6(N.safe_corr(prediction, F.col("y"))).alias("correlation"), F.count("*").alias("n"))


@query("m02_residual_ridge")
def m02(t):
    d = cut(trials(t))
    m = M.residual_ridge_cv(d.filter("tier = 'train'"), F.col("id"), XS, "y", (1.0, 10.0, 100.0), [i * 0.025 for i in range(61)])
    return evaluated(d.filter("tier = 'test'"), M.residual_prediction(m, XS), "calibrated_residual_ridge").withColumn("alpha", F.lit(m["alpha"])).withColumn("beta", F.lit(float(m["beta"])))


def embedded(t):
    """Embedding columns as features; the response is the class label."""
    e = t.embeddings.withColumn("id", F.col("vec_id").cast("string"))
    d = e.select("id", F.col("label").cast("double").alias("y"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return d.withColumn("tier", F.when(H.hash_mod(F.concat(F.lit("emb:"), F.col("id")), 4) == 0, "test").otherwise("train"))


@query("m03_projection_ridge")
def m03(t):
    """Principal directions of the standardized training columns, then the calibrated residual ridge."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = cut(embedded(t))
    names = [f"e{i}" for i in range(64)]
    pipe = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="v"), StandardScaler(inputCol="v", outputCol="z", withMean=True, withStd=True), PCA(k=8, inputCol="z", outputCol="c")])
    fit = pipe.fit(d.filter("tier = 'train'"))
    x = cut(fit.transform(d).select("id", "tier", "y", vector_to_array("c").alias("c")).select("id", "tier", "y", *[F.col("c")[i].alias(f"c{i}") for i in range(8)]))
    best = None
    for k in (4, 8):
        xs = [f"c{i}" for i in range(k)]
        m = M.residual_ridge_cv(x.filter("tier = 'train'"), F.col("id"), xs, "y", (1.0, 10.0), [i * 0.1 for i in range(16)])
        if best is None or m["score"] > best[0]["score"]:
            best = (m, xs)
    m, xs = best
    return evaluated(x.filter("tier = 'test'"), M.residual_prediction(m, xs), "projection_residual_ridge").withColumn("components", F.lit(len(xs)))


@query("m04_random_feature_ridge")
def m04(t):
    d = trials(t)
    s = d.filter("tier = 'train'").agg(*[F.avg(x).alias(f"m_{x}") for x in XS], *[F.stddev_pop(x).alias(f"s_{x}") for x in XS]).first()
    z = d.select("id", "tier", "y", *[((F.col(x) - s[f"m_{x}"]) / (s[f"s_{x}"] or 1.0)).alias(x) for x in XS])
    z, names = M.random_features(z, XS, 16, "fourier")
    z = cut(z)
    m = M.residual_ridge_cv(z.filter("tier = 'train'"), F.col("id"), names, "y", (1.0, 10.0), [i * 0.1 for i in range(16)])
    return evaluated(z.filter("tier = 'test'"), M.residual_prediction(m, names), "random_feature_residual_ridge")


def score_table(t):
    """Case-claim rows with two features for score models and a role from the case key."""
    c = risk_cases(t).withColumn("f0", F.col("score")).withColumn("f1", F.col("admissible").cast("double")).withColumn("f2", F.pow("score", F.lit(2)))
    return c.withColumn("role", N.split_role(F.col("case_id")))


def claim_models(d):
    fits = {c: M.fit_logistic(d.filter((F.col("claim") == c) & (F.col("role") == "model_fit")), ["f0", "f1", "f2"], "label", 1.0) for c in CLAIMS4}
    parts = [fits[c](d.filter(F.col("claim") == c)) for c in CLAIMS4]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("m05_claim_scores")
def m05(t):
    s = claim_models(cut(score_table(t)))
    return s.groupBy("claim", "role").agg(F.count("*").alias("n"), F.round(F.avg("p"), 4).alias("mean_score"), F.round(F.avg(F.pow(F.col("p") - F.col("label").cast("int"), F.lit(2))), 4).alias("brier"))


@query("m06_isotonic_calibration")
def m06(t):
    s = cut(claim_models(cut(score_table(t))))
    cal = M.fit_isotonic(s.filter("role = 'threshold_calibration'"), "p", "label")(s)
    return cal.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg("calibrated"), 4).alias("mean_calibrated"), F.round(F.avg(F.col("label").cast("int")), 4).alias("rate"))


@query("m07_model_set_evaluation")
def m07(t):
    s = cut(claim_models(cut(score_table(t))))
    cal = M.fit_isotonic(s.filter("role = 'threshold_calibration'"), "p", "label")(s).withColumn("score", F.col("calibrated"))
    return risk.selective_metrics(risk.selective(cal.filter("role = 'locked_development_audit'"), F.lit(0.9)), ["claim"])


@query("m08_training_roles")
def m08(t):
    """Fit, calibrate and audit roles; scores are used only where the profile identity matches."""
    from veriframe.plans.bindings import V2

    s = cut(claim_models(cut(score_table(t))))
    frozen = s.withColumn("profile_hash", F.when(F.col("stratum") == "P", F.lit("sha256:other")).otherwise(F.lit(V2.source_hash)))
    ok = frozen.filter(F.col("profile_hash") == V2.source_hash).withColumn("score", F.col("p"))
    grid = risk.selective_grid(ok.filter("role = 'threshold_calibration'"), [0.5 + 0.05 * i for i in range(10)])
    best = grid.filter("decisions > 0").agg(F.max_by("threshold", F.struct(-F.round("selective_error", 6), "coverage", "threshold")).alias("threshold"), F.lit(1).alias("_one"))
    audit = ok.filter("role = 'locked_development_audit'").withColumn("_one", F.lit(1)).join(F.broadcast(best), "_one")
    return risk.selective_metrics(risk.selective(audit, F.col("threshold")), ["claim", "threshold"])


def behaviour(t):
    """Events as two-choice trials per user: clicks against views, with a prior and a signed contrast."""
    e = t.events.filter(F.col("event_type").isin("click", "view"))
    d = e.select("user_id", "event_id", (F.col("event_type") == "click").cast("int").alias("choice"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("prior"), F.col("value").alias("contrast"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return d.withColumn("fold", H.hash_mod(F.concat_ws(":", F.lit("trials"), F.col("user_id").cast("string"), F.col("event_id").cast("string")), 3))


@query("m09_candidate_against_baseline")
def m09(t):
    """Three-fold comparison of prior-plus-contrast with the prior alone, one fit per (user, fold)."""
    b = cut(behaviour(t).select("user_id", "fold", "choice", "prior", "contrast"))
    held = F.explode(F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda f: f != F.col("fold")))
    train = b.withColumn("held", held).drop("fold")
    both = train.groupBy("user_id", "held").agg(F.min("choice").alias("lo"), F.max("choice").alias("hi")).filter("lo <> hi").select("user_id", "held")
    train = train.join(both, ["user_id", "held"], "left_semi")
    test = b.withColumnRenamed("fold", "held")
    for name, xs in (("p0", ["prior"]), ("p1", ["prior", "contrast"])):
        m = M.grouped_logistic(train, ["user_id", "held"], xs, "choice")
        p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), M.logistic_score(xs)))
        test = test.join(m, ["user_id", "held"]).withColumn(name, p).drop("mu", "sd", "coef")
    y = F.col("choice") == 1
    loss = lambda p: -F.avg(F.when(y, F.log(F.col(p))).otherwise(F.log(1.0 - F.col(p))))
    g = test.groupBy("user_id", "held").agg((loss("p0") - loss("p1")).alias("gain"), (F.avg(F.when(y, F.col("p1"))) - F.avg(F.when(~y, F.col("p1")))).alias("tjur")).filter("tjur is not null")
    return g.groupBy("user_id").agg(F.count("*").alias("folds"), F.round(F.avg("gain"), 6).alias("mean_gain"), F.count_if(F.col("gain") > 0).alias("positive_folds"), F.round(F.avg("tjur"), 6).alias("tjur"))


@query("m10_cyclic_shift_controls", "WITH d AS (SELECT user_id, value, (event_type='click')::INT AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type IN ('click','view')), s AS (SELECT a.user_id, k, corr(b.value, a.c) AS r FROM d a CROSS JOIN range(4) o(k) JOIN d b ON b.user_id=a.user_id AND b.i=(a.i+k*7)%a.n GROUP BY 1,2) SELECT user_id, round(max(r) FILTER (k=0),6) AS own, round(max(r) FILTER (k>0),6) AS best_other FROM s GROUP BY 1")
def m10(t):
    """Rolled contrasts as a join on (row + offset) modulo the session length."""
    d = ranking.value_rank(behaviour(t), ["user_id"], F.col("us"), [F.col("event_id")]).select("user_id", "choice", "contrast", (F.col("rn") - 1).alias("i"), "n")
    a = d.select("user_id", "choice", "n", "i", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k")).withColumn("j", (F.col("i") + F.col("k") * 7) % F.col("n"))
    j = a.join(d.select("user_id", F.col("i").alias("j"), "contrast"), ["user_id", "j"])
    s = j.groupBy("user_id", "k").agg(N.corr(F.col("contrast"), F.col("choice").cast("double")).alias("r"))
    return s.groupBy("user_id").agg(r6(F.max(F.when(F.col("k") == 0, F.col("r")))).alias("own"), r6(F.max(F.when(F.col("k") > 0, F.col("r")))).alias("best_other"))


@query("m11_region_classifier")
def m11(t):
    """Median imputation, scaling and a balanced multinomial classifier; macro recall on held-out rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    from veriframe.plans.q_functions import confusion_scores

    names = [f"e{i}" for i in range(64)]
    d = embedded(t).select("id", "tier", "y", *names)
    w = d.filter("tier = 'train'").groupBy("y").agg((1.0 / F.count("*")).alias("w"))
    d = cut(d.join(F.broadcast(w), "y"))
    pipe = Pipeline(stages=[Imputer(strategy="median", inputCols=names, outputCols=[f"i_{n}" for n in names]), VectorAssembler(inputCols=[f"i_{n}" for n in names], outputCol="v"),
                            StandardScaler(inputCol="v", outputCol="z", withMean=True, withStd=True), LogisticRegression(featuresCol="z", labelCol="y", weightCol="w", regParam=0.01, maxIter=50)])
    scored = pipe.fit(d.filter("tier = 'train'")).transform(d.filter("tier = 'test'")).select("y", "prediction")
    return confusion_scores(scored, "y", "prediction").select(F.round("macro_recall", 4).alias("macro_recall"), F.round("mcc", 4).alias("mcc"))


@query("m12_contrast_response_model")
def m12(t):
    """Chronological split per user, contrast features and a grouped ridge, scored on the last fifth."""
    e = t.events.select("user_id", "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    d = selection.chronological_split(e, ["user_id"], F.col("us"), [F.col("event_id")])
    a = F.radians(F.col("k") * 3.6)
    d = d.select("user_id", "role", F.col("value").alias("y"), F.log1p("k").alias("x0"), F.sin(a).alias("x1"), F.cos(a).alias("x2"))
    xs = ["x0", "x1", "x2"]
    tr = d.filter("role = 'train'")
    m = M.ridge_fit(tr, ["user_id"], xs, "y", 1.0).join(tr.groupBy("user_id").agg(F.avg("y").alias("base")), "user_id")
    te = d.filter("role = 'test'").join(m, "user_id").withColumn("p", M.linear(xs))
    return te.groupBy("user_id").agg(F.count("*").alias("n"), r6(N.safe_corr(F.col("p"), F.col("y"))).alias("correlation"), F.round(F.sum(F.pow(F.col("y") - F.col("p"), F.lit(2))), 4).alias("model_sse"), F.round(F.sum(F.pow(F.col("y") - F.col("base"), F.lit(2))), 4).alias("baseline_sse"))


@query("m13_availability_gate", "SELECT user_id, concat_ws('|', CASE WHEN bool_or(event_type='click') THEN NULL ELSE 'click' END, CASE WHEN bool_or(event_type='purchase' AND value>=100) THEN NULL ELSE 'purchase' END, CASE WHEN bool_or(event_type='signup' AND value>=100) THEN NULL ELSE 'signup' END) AS missing FROM events GROUP BY 1")
def m13(t):
    big = F.when((F.col("event_type") == "click") | (F.col("value") >= 100), F.col("event_type"))
    g = t.events.groupBy("user_id").agg(F.collect_set(big).alias("have"))
    return g.select("user_id", F.array_join(F.array_except(F.array(F.lit("click"), F.lit("purchase"), F.lit("signup")), "have"), "|").alias("missing"))


@query("f03_named_adapters")
def f03(t):
    d = cut(trials(t))
    tr, te = d.filter("tier = 'train'"), d.filter("tier = 'test'")
    parts = [evaluated(te, M.get_adapter(n)(tr, XS, "y")[1], n) for n in ("mean", "ridge")]
    return parts[0].unionByName(parts[1])


@query("m14_adapter_benchmark")
def m14(t):
    """Mean, ridge and a scrambled control whose feature rows are permuted by hash rank."""
    d = cut(trials(t))
    tr, te = d.filter("tier = 'train'"), d.filter("tier = 'test'")
    a = ranking.hash_rank(tr.select("id", *XS), [], F.col("id"), "scramble").drop("n", "id")
    b = ranking.hash_rank(tr.select("id", "y"), [], F.col("id"), "order").drop("n")
    scrambled = cut(a.join(b, "rn"))
    parts = [evaluated(te, M.get_adapter(n)(x, XS, "y")[1], label) for n, x, label in (("mean", tr, "mean"), ("ridge", tr, "ridge"), ("ridge", scrambled, "scrambled"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("m15_median_neuron_correlation", "SELECT round(median(r),9) AS median_r, count(*) AS neurons FROM (SELECT l_suppkey, CASE WHEN stddev_pop(l_quantity)=0 OR stddev_pop(l_extendedprice)=0 THEN 0 ELSE corr(l_quantity,l_extendedprice) END AS r FROM lineitem GROUP BY 1)")
def m15(t):
    r = t.lineitem.groupBy("l_suppkey").agg(N.safe_corr(F.col("l_quantity"), F.col("l_extendedprice")).alias("r"))
    return r.agg(F.count("*").alias("neurons")).withColumn("median_r", r9(ranking.median_of(r, "r")))


MODELS = ("N", "A", "R")


def model_rows(t):
    return t.lineitem.groupBy(F.concat(F.lit("dynamic"), "l_suppkey").alias("mouse"), F.col("l_returnflag").alias("model")).agg(F.round(N.corr(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("corr"))


_MR = "mr AS (SELECT 'dynamic'||l_suppkey AS mouse, l_returnflag AS model, round(corr(l_quantity,l_extendedprice),6) AS corr FROM lineitem GROUP BY 1,2)"


@query("a34_model_table", f"WITH {_MR} SELECT mouse, max(corr) FILTER (model='N') AS N, max(corr) FILTER (model='A') AS A, max(corr) FILTER (model='R') AS R FROM mr GROUP BY 1")
def a34(t):
    return model_rows(t).groupBy("mouse").pivot("model", list(MODELS)).agg(F.first("corr"))


@query("j19_pairwise_models", f"WITH {_MR} SELECT a.model AS left_model, b.model AS right_model, count(*) AS n, count(*) FILTER (a.corr>b.corr) AS wins, count(*) FILTER (a.corr=b.corr) AS ties, round(median(a.corr-b.corr),9) AS median_delta FROM mr a JOIN mr b ON a.mouse=b.mouse AND a.model<b.model GROUP BY 1,2")
def j19(t):
    """Models are a fixed short list, so each subject's row carries all of them."""
    w = model_rows(t).groupBy("mouse").pivot("model", sorted(MODELS)).agg(F.first("corr"))
    pairs = [(a, b) for a in sorted(MODELS) for b in sorted(MODELS) if a < b]
    x = w.select(F.inline(F.array(*[F.struct(F.lit(a).alias("left_model"), F.lit(b).alias("right_model"), (F.col(a) - F.col(b)).alias("d")) for a, b in pairs]))).filter("d is not null")
    by = ["left_model", "right_model"]
    counts = x.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") == 0).alias("ties"))
    return counts.join(ranking.exact_median(x, by, "d", "m"), by).withColumn("median_delta", r9("m")).drop("m")


@query("j20_artifact_merge", f"WITH {_MR}, x AS (SELECT mouse, 'corr_'||model AS source, corr AS value FROM mr UNION ALL SELECT 'dynamic'||s_suppkey, 'acctbal', s_acctbal FROM supplier) SELECT mouse, count(*) AS sources, round(sum(value),4) AS total FROM x GROUP BY 1")
def j20(t):
    a = model_rows(t).select(N.mouse_key(F.concat(F.lit("results/"), "mouse", F.lit("-v2"))).alias("mouse"), F.concat(F.lit("corr_"), "model").alias("source"), F.col("corr").alias("value"))
    b = t.supplier.select(N.mouse_key(F.concat(F.lit("dynamic"), "s_suppkey")).alias("mouse"), F.lit("acctbal").alias("source"), F.col("s_acctbal").alias("value"))
    return a.unionByName(b).groupBy("mouse").agg(F.count("*").alias("sources"), F.round(F.sum("value"), 4).alias("total"))


@query("m16_model_comparator", f"WITH {_MR} SELECT mouse, CASE WHEN max(corr) FILTER (model='N') > greatest(max(corr) FILTER (model='A'), max(corr) FILTER (model='R'))+0.01 THEN 'clear_gain' WHEN max(corr) FILTER (model='N') > greatest(max(corr) FILTER (model='A'), max(corr) FILTER (model='R')) THEN 'small_gain' ELSE 'no_gain' END AS evidence FROM mr GROUP BY 1")
def m16(t):
    w = model_rows(t).groupBy("mouse").pivot("model", list(MODELS)).agg(F.first("corr"))
    rival = F.greatest("A", "R")
    return w.select("mouse", F.when(F.col("N") > rival + 0.01, "clear_gain").when(F.col("N") > rival, "small_gain").otherwise("no_gain").alias("evidence"))


@query("i35_prediction_and_topology", "WITH d AS (SELECT l_suppkey AS pair, l_quantity AS x, l_extendedprice AS y, l_tax AS c, l_linenumber%2=0 AS tr FROM lineitem), f AS (SELECT pair, regr_slope(y,x) AS b, regr_intercept(y,x) AS a, regr_slope(y,c) AS cb, regr_intercept(y,c) AS ca FROM d WHERE tr GROUP BY 1), m AS (SELECT pair, 1-sum(pow(y-a-b*x,2))/(var_pop(y)*count(*)) AS r2, 1-sum(pow(y-ca-cb*c,2))/(var_pop(y)*count(*)) AS c2 FROM d JOIN f USING (pair) WHERE NOT tr GROUP BY 1) SELECT pair, round(r2,6) AS r2, round(c2,6) AS control_r2, r2>0 AND r2-c2>0.02 AS topology_passed FROM m")
def i35(t):
    """Candidate and control predictors fitted on one cohort and scored on the other."""
    d = t.lineitem.select(F.col("l_suppkey").alias("pair"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_tax").alias("c"), (F.col("l_linenumber") % 2 == 0).alias("tr"))
    f = d.filter("tr").groupBy("pair").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.regr_slope("y", "c").alias("cb"), F.regr_intercept("y", "c").alias("ca"))
    e = d.filter("not tr").join(f, "pair")
    r2 = lambda p: F.when(F.var_pop("y") == 0, 0.0).otherwise(1 - F.sum(F.pow(F.col("y") - p, F.lit(2))) / (F.var_pop("y") * F.count("*")))
    m = e.groupBy("pair").agg(r2(F.col("a") + F.col("b") * F.col("x")).alias("r2"), r2(F.col("ca") + F.col("cb") * F.col("c")).alias("c2"))
    return m.select("pair", r6("r2").alias("r2"), r6("c2").alias("control_r2"), ((F.col("r2") > 0) & (F.col("r2") - F.col("c2") > 0.02)).alias("topology_passed"))


@query("i37_topographic_constraint")
def i37(t):
    """Tuning similarity against distance on hash-sampled pairs, with coordinates permuted for the null."""
    from veriframe.operators import inference as I

    reps = 20
    ok = "label IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('infinity'))"
    e = t.embeddings.where(ok).select(F.col("vec_id").alias("root"), F.col("embedding").alias("v"), F.col("label").cast("double").alias("cx"))
    double = lambda x: x.cast("double")
    n_ = F.size("v")
    e = e.withColumn("m", F.aggregate("v", F.lit(0.0), lambda a, x: a + double(x)) / n_)
    e = e.withColumn("sd", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (double(x) - F.col("m")) * (double(x) - F.col("m"))) / n_))
    e = e.withColumn("sd", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))
    # A unit's own coordinate and those it takes in the replicates are one array: a pair meets each of its units once.
    moved = I.permuted_values(e, "root", "cx", reps, "coords")
    u = stored(I.index_units(e, [], "root").join(moved, "idx").select("root", "idx", "n", "v", "m", "sd", F.concat(F.array("cx"), "moved").alias("cs")))
    off = H.hash_index(F.concat_ws(":", F.lit("topo"), F.col("root").cast("string"), F.col("j").cast("string")), F.col("n") - 1) + 1
    p = u.where("n > 1").select("root", "idx", "n", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("j"))
    p = p.select(F.col("idx").alias("a"), F.pmod(F.col("idx") + off, F.col("n")).alias("b"))
    p = p.join(u.select(F.col("idx").alias("b"), F.col("v").alias("v2"), F.col("m").alias("m2"), F.col("sd").alias("sd2"), F.col("cs").alias("c2")), "b")
    p = p.join(u.select(F.col("idx").alias("a"), F.transform("v", lambda x: (double(x) - F.col("m")) / F.col("sd")).alias("z1"), F.col("cs").alias("c1")), "a")
    sim = F.aggregate(F.zip_with("z1", "v2", lambda z, x: z * ((double(x) - F.col("m2")) / F.col("sd2"))), F.lit(0.0), lambda s, x: s + x) / F.size("z1")
    base = stored(p.select(r9(sim).alias("sim"), F.zip_with("c1", "c2", lambda x, y: -F.abs(x - y)).alias("near")))
    rho = cut(I.rank_correlations(base, "sim", "near"))
    j = rho.where("rep > 0").crossJoin(F.broadcast(rho.where("rep = 0").select(F.col("rho").alias("observed"))))
    return j.groupBy("observed").agg(F.median("rho").alias("null_median"), F.percentile("rho", F.lit(0.95)).alias("null_p95"), ((1 + F.count_if(F.col("rho") >= F.col("observed"))) / (F.count("*") + 1.0)).alias("p"))
