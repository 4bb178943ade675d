"""Risk-controlled authorization on long (case, claim) tables.

Columns: ``case_id, claim, score, label, admissible, unit_id, subgroup_id, stratum``.
Inference uses independent units only; lower levels are descriptive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.tails import bound_column
from veriframe.operators.ranking import cumulative

ONE = 1


def _n(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def decide(cases: DataFrame, threshold: Column | float) -> DataFrame:
    return cases.withColumn("decision", F.col("admissible") & (F.col("score") >= threshold))


def unit_flags(decided: DataFrame, unit: list[str]) -> DataFrame:
    """One row per independent unit: did it fail, act, could it be recovered, was it."""
    d, y, g = F.col("decision"), F.col("label"), F.col("admissible")
    u = decided.groupBy(*unit).agg(F.bool_or(d & ~y).alias("failed"), F.bool_or(d).alias("authorized"), F.bool_or(y & g).alias("eligible"), F.bool_or(d & y).alias("hit"))
    return u.withColumn("recovered", F.col("eligible") & F.col("hit")).drop("hit")


def level_summary(decided: DataFrame, unit: list[str], by: list[str] | None = None) -> DataFrame:
    by = by or []
    u = unit_flags(decided, [*by, *unit])
    out = u.groupBy(*by).agg(
        F.count("*").alias("units"), _n(F.col("failed")).alias("failing_units"), _n(F.col("authorized")).alias("authorized_units"),
        _n(F.col("eligible")).alias("eligible_positive_units"), _n(F.col("recovered")).alias("recovered_positive_units"))
    return (
        out.withColumn("failure_rate", ratio(F.col("failing_units"), F.col("units")))
        .withColumn("coverage", ratio(F.col("authorized_units"), F.col("units")))
        .withColumn("positive_recovery", ratio(F.col("recovered_positive_units"), F.col("eligible_positive_units")))
    )


def threshold_curve(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Unit and row counts at every candidate threshold.

    A unit fails at threshold t when its best false score reaches t, so one maximum
    per unit and kind stands for all its rows; running counts over distinct scores
    give every threshold in one pass instead of one pass per threshold.
    """
    by = by or []
    g, y, s = F.col("admissible"), F.col("label"), F.col("score")
    top = cases.groupBy(*by, "unit_id").agg(
        F.max(F.when(g, s)).alias("any"), F.max(F.when(g & ~y, s)).alias("bad"), F.max(F.when(g & y, s)).alias("good"))
    kinds = ["failing", "authorized", "recovered", "authorizations", "false_authorizations"]
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")

    def point(value: Column, **on: Column) -> Column:
        return F.struct(value.alias("threshold"), *[on.get(k, zero).alias(k) for k in kinds])

    per_unit = top.select(*by, F.inline(F.array(point(F.col("bad"), failing=one), point(F.col("any"), authorized=one), point(F.col("good"), recovered=one))))
    act = F.when(g, one).otherwise(zero)
    per_row = cases.select(*by, F.inline(F.array(point(s, authorizations=act, false_authorizations=F.when(g & ~y, one).otherwise(zero)))))
    ends = cases.select(*by).distinct().select(*by, F.inline(F.array(point(F.lit(0.0)), point(F.lit(1.0 + 2.220446049250313e-16))))) if by else \
        cases.sparkSession.range(1).select(F.inline(F.array(point(F.lit(0.0)), point(F.lit(1.0 + 2.220446049250313e-16)))))
    points = per_unit.unionByName(per_row).unionByName(ends).filter(F.col("threshold").isNotNull())
    c = cumulative(points, by, "threshold", {k: F.sum(k) for k in kinds}, descending=True)
    totals = top.groupBy(*by).agg(F.count("*").alias("units"), _n(F.col("good").isNotNull()).alias("eligible"))
    if not by:
        c, totals = c.withColumn("_one", F.lit(1)), totals.withColumn("_one", F.lit(1))
    joined = c.join(F.broadcast(totals) if not by else totals, by or ["_one"])
    return joined.select(*by, "threshold", "units", "eligible", *[F.col(f"cum_{k}").alias(k) for k in kinds])


def certify(curve: DataFrame, target_risk: float, min_coverage: float, min_recovery: float, confidence: float = 0.95) -> DataFrame:
    """Exact one-sided bounds for every threshold and the joint certificate."""
    out = (
        curve.withColumn("risk_upper", bound_column(F.col("failing"), F.col("units"), confidence, "upper"))
        .withColumn("coverage_lower", bound_column(F.col("authorized"), F.col("units"), confidence, "lower"))
        .withColumn("recovery_lower", bound_column(F.col("recovered"), F.col("eligible"), confidence, "lower"))
    )
    ok = (F.col("risk_upper") <= target_risk) & (F.col("coverage_lower") >= min_coverage) & (F.col("recovery_lower") >= min_recovery)
    return out.withColumn("certified", ok)


def select_certificate(certified: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Most active certified threshold: authorized, recovered, lower risk, higher threshold."""
    by = by or []
    cols = [c for c in certified.columns if c not in by]
    best = F.max_by(F.struct(*cols), F.struct("authorized", "recovered", -F.col("risk_upper"), "threshold")).alias("b")
    return certified.filter("certified").groupBy(*by).agg(best).filter(F.col("b").isNotNull()).select(*by, "b.*")


def hierarchy_violations(cases: DataFrame) -> DataFrame:
    """Subgroups assigned to more than one independent unit."""
    p = cases.groupBy("subgroup_id").agg(F.min("unit_id").alias("lo"), F.max("unit_id").alias("hi"))
    return p.filter("lo <> hi").select("subgroup_id")


def claim_thresholds(cases: DataFrame, grid: list[float], target: float, familywise: float, n_claims: int) -> DataFrame:
    """Per claim the lowest grid threshold whose false-authorization rate is certified.

    Cases are counted by (claim, grid level) before the grid is opened, then each
    threshold is tested exactly at the claim's share of the family-wise error.
    """
    level = sum((F.when(F.col("score") >= v, 1).otherwise(0) for v in grid), F.lit(0))
    pre = cases.filter("admissible").groupBy("claim", level.alias("level")).agg(F.count("*").alias("n"), _n(~F.col("label")).alias("k"))
    cells = F.array(*[F.struct(F.lit(i + 1).alias("need"), F.lit(v).alias("threshold")) for i, v in enumerate(grid)])
    opened = pre.withColumn("c", F.explode(cells)).filter(F.col("level") >= F.col("c.need"))
    sums = opened.groupBy("claim", F.col("c.threshold").alias("threshold")).agg(F.sum("n").alias("authorizations"), F.sum("k").alias("false_authorizations"))
    conf = 1.0 - (1.0 - familywise) / n_claims
    up = sums.withColumn("upper", bound_column(F.col("false_authorizations"), F.col("authorizations"), conf, "upper"))
    return up.withColumn("valid", F.col("upper") <= target)


def false_authorization_metrics(decided: DataFrame, by: list[str] | None = None) -> DataFrame:
    d = F.col("decision")
    out = decided.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"), _n(d).alias("authorizations"), _n(d & ~F.col("label")).alias("false_authorizations"))
    return out.withColumn("coverage", ratio(F.col("authorizations"), F.col("rows"))).withColumn("risk", ratio(F.col("false_authorizations"), F.col("authorizations")))


def selective(cases: DataFrame, threshold: Column | float, veto: bool = True) -> DataFrame:
    """Support (1), block (-1) or abstain (0); a failed veto blocks, an unresolved one abstains."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    raw = F.when(F.col("score") >= t, 1).when(F.col("score") <= F.lit(1.0) - t, -1).otherwise(0)
    if veto:
        raw = F.when((raw == 1) & (F.col("veto_state") == "failed"), -1).when((raw == 1) & (F.col("veto_state") == "unresolved"), 0).otherwise(raw)
    return cases.withColumn("choice", raw)


def selective_metrics(chosen: DataFrame, by: list[str] | None = None) -> DataFrame:
    c, y = F.col("choice"), F.col("label")
    out = chosen.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), _n(c != 0).alias("decisions"), _n(c == 1).alias("supports"), _n(c == -1).alias("blocks"),
        _n(((c == 1) & ~y) | ((c == -1) & y)).alias("errors"), _n((c == 1) & ~y).alias("false_authorizations"))
    return (
        out.withColumn("abstentions", F.col("total") - F.col("decisions")).withColumn("coverage", ratio(F.col("decisions"), F.col("total")))
        .withColumn("selective_error", ratio(F.col("errors"), F.col("decisions"), 1.0)).withColumn("false_fraction", ratio(F.col("false_authorizations"), F.col("supports")))
    )


def selective_grid(cases: DataFrame, grid: list[float]) -> DataFrame:
    """Selective metrics at every grid threshold from one count by (up level, down level, state, label)."""
    up = sum((F.when(F.col("score") >= v, 1).otherwise(0) for v in grid), F.lit(0))
    down = sum((F.when(F.col("score") <= F.lit(1.0) - v, 1).otherwise(0) for v in grid), F.lit(0))
    pre = cases.groupBy(up.alias("up"), down.alias("down"), "veto_state", "label").agg(F.count("*").alias("w"))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("threshold")) for i, v in enumerate(grid)])
    x = pre.withColumn("c", F.explode(cells))
    raw = F.when(F.col("up") > F.col("c.i"), 1).when(F.col("down") >= F.col("c.i") + 1, -1).otherwise(0)
    choice = F.when((raw == 1) & (F.col("veto_state") == "failed"), -1).when((raw == 1) & (F.col("veto_state") == "unresolved"), 0).otherwise(raw)
    x = x.withColumn("choice", choice)
    c, y, w = F.col("choice"), F.col("label"), F.col("w")
    tally = lambda cond: F.sum(F.when(cond, w).otherwise(0))
    out = x.groupBy(F.col("c.threshold").alias("threshold")).agg(
        F.sum(w).alias("total"), tally(c != 0).alias("decisions"), tally(((c == 1) & ~y) | ((c == -1) & y)).alias("errors"))
    return out.withColumn("coverage", ratio(F.col("decisions"), F.col("total"))).withColumn("selective_error", ratio(F.col("errors"), F.col("decisions"), 1.0))


def calibration_error(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Weighted gap between mean score and observed rate per score bin."""
    b = F.least(F.floor(F.round(F.col("score") * bins, 9)), F.lit(bins - 1))
    per = rows.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.sum("score").alias("p"), F.sum(F.col("label").cast("double")).alias("y"))
    return per.groupBy(*by).agg((F.sum(F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))
