"""Claim-gate evaluators as column expressions over a flat evidence table.

An allowed-claim set is a bit mask over ``CLAIM_TYPES`` so that confusion counts
pre-aggregate by (predicted mask, true mask): at most 256 x 256 groups per
evaluator leave the map side whatever the number of cases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Claim types from weakest to strongest.
CLAIM_TYPES = ("predictive", "reproducible", "topology_specific", "directed", "structure_function", "mechanistic", "causal", "digital_twin")
# Gate thresholds.
THRESHOLDS = {
    "predictive_score": 0.30,
    "reproducibility_score": 0.70,
    "topology_effect": 0.05,
    "directed_fraction": 0.50,
    "matched_structure_function_effect": 0.01,
}
# Threshold grid of the sensitivity study.
THRESHOLD_GRID = {
    "predictive_score": (0.25, 0.30, 0.35),
    "reproducibility_score": (0.65, 0.70, 0.75),
    "topology_effect": (0.04, 0.05, 0.06),
    "directed_fraction": (0.45, 0.50, 0.55),
    "matched_structure_function_effect": (0.008, 0.010, 0.012),
}
# Fixed values: (weight, scale) of the compensatory score.
COMPENSATORY = {
    "predictive_score": (0.25, 1.0),
    "reproducibility_score": (0.25, 1.0),
    "topology_effect": (0.20, 0.08),
    "directed_fraction": (0.15, 1.0),
    "matched_structure_function_effect": (0.15, 0.03),
}
# Evidence perturbations (prediction, reproducibility, topology, direction, structure-function).
VARIANTS = (
    ("nominal", (0.00, 0.00, 0.00, 0.00, 0.000)),
    ("high_prediction", (0.06, 0.00, 0.00, 0.00, 0.000)),
    ("low_prediction", (-0.10, 0.00, 0.00, 0.00, 0.000)),
    ("high_reproducibility", (0.00, 0.06, 0.00, 0.00, 0.000)),
    ("low_reproducibility", (0.00, -0.10, 0.00, 0.00, 0.000)),
    ("topology_margin_up", (0.00, 0.00, 0.025, 0.00, 0.000)),
    ("topology_margin_down", (0.00, 0.00, -0.035, 0.00, 0.000)),
    ("direction_margin_up", (0.00, 0.00, 0.00, 0.12, 0.000)),
    ("direction_margin_down", (0.00, 0.00, 0.00, -0.18, 0.000)),
    ("sf_margin_up", (0.00, 0.00, 0.00, 0.00, 0.006)),
    ("sf_margin_down", (0.00, 0.00, 0.00, 0.00, -0.008)),
    ("mild_ood", (-0.08, -0.08, -0.015, -0.08, -0.004)),
)
NUMERIC_FIELDS = tuple(THRESHOLDS)


def bits(*claims: str) -> int:
    return sum(1 << CLAIM_TYPES.index(c) for c in claims)


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _flag(condition: Column, *claims: str) -> Column:
    return F.when(condition, F.lit(bits(*claims))).otherwise(0)


def gate_components(thresholds: dict | None = None) -> dict[str, Column]:
    limit = {k: (v if isinstance(v, Column) else F.lit(v)) for k, v in (thresholds or THRESHOLDS).items()}
    return {
        "predictive": F.col("predictive_score") >= limit["predictive_score"],
        "reproducible": F.col("reproducibility_score") >= limit["reproducibility_score"],
        "topology": F.col("topology_specific") & (F.col("topology_effect") >= limit["topology_effect"]),
        "directed": F.col("directed_fraction") >= limit["directed_fraction"],
        "structure_function": (F.col("structure_function_effect") > 0.0)
        & (F.col("matched_structure_function_effect") >= limit["matched_structure_function_effect"])
        & F.col("structure_function_fdr_passed"),
    }


def gate_mask(thresholds: dict | None = None) -> Column:
    """Claims allowed by the gate in which no strong block can stand in for a weak one."""
    c = gate_components(thresholds)
    causal = F.col("causal_evidence")
    return (
        _flag(c["predictive"], "predictive")
        + _flag(c["reproducible"], "reproducible")
        + _flag(c["topology"], "topology_specific")
        + _flag(c["directed"], "directed")
        + _flag(c["structure_function"], "structure_function")
        + _flag(c["predictive"] & c["reproducible"] & c["topology"] & c["directed"], "mechanistic")
        + _flag(causal, "causal")
        + _flag(F.col("whole_brain_coverage") & F.col("independent_validation") & F.col("reproducible_compute") & causal, "digital_twin")
    ).cast("int")


def compensatory_score() -> Column:
    return sum((F.lit(w) * clip01(F.col(name) / scale) for name, (w, scale) in COMPENSATORY.items()), F.lit(0.0))


_BROAD = ("predictive", "reproducible", "topology_specific", "directed", "structure_function", "mechanistic")


def _compensatory() -> Column:
    score = F.round(compensatory_score(), 9)
    return (
        _flag(F.col("predictive_score") >= 0.30, "predictive")
        + _flag(F.col("reproducibility_score") >= 0.70, "reproducible")
        + _flag(score >= 0.62, "topology_specific", "directed", "structure_function", "mechanistic")
        + _flag((score >= 0.85) & F.col("independent_validation"), "digital_twin")
    )


def _ablated(omitted: str) -> Column:
    c = gate_components()
    kept = [c[name] for name in ("predictive", "reproducible", "topology", "directed") if name != omitted]
    opened = kept[0] & kept[1] & kept[2]
    return gate_mask().bitwiseOR(_flag(opened, "mechanistic"))


# Registry of evaluators: a name and a builder of the allowed-claim mask.
EVALUATORS: dict[str, Callable[[], Column]] = {
    "correlation_only": lambda: _flag(F.col("predictive_score") >= 0.50, *_BROAD),
    "leaderboard_only": lambda: _flag(F.col("predictive_score") >= 0.60, *_BROAD),
    "reliability_only": lambda: _flag(F.col("reproducibility_score") >= 0.80, "reproducible", "topology_specific", "directed", "mechanistic"),
    "topology_only": lambda: _flag(F.col("topology_specific") & (F.col("topology_effect") >= 0.05), "topology_specific", "directed", "mechanistic"),
    "compensatory_score": _compensatory,
    "ablated_claim_gate_no_topology": lambda: _ablated("topology"),
    "ablated_claim_gate_no_directed": lambda: _ablated("directed"),
    "ablated_claim_gate_no_reproducible": lambda: _ablated("reproducible"),
    "claim_gate": gate_mask,
}


def register_evaluator(name: str, build: Callable[[], Column]) -> None:
    """Add a user evaluator: any expression (or pandas UDF call) giving an allowed-claim mask."""
    if name in EVALUATORS:
        raise ValueError(f"evaluator {name} exists")
    EVALUATORS[name] = build


def evaluate(cases: DataFrame, names: tuple[str, ...] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per (case, evaluator) with the allowed mask; a narrow projection, no shuffle."""
    chosen = names or tuple(EVALUATORS)
    pairs = F.array(*[F.struct(F.lit(n).alias("evaluator"), EVALUATORS[n]().cast("int").alias("allowed")) for n in chosen])
    return cases.select(*keep, F.explode(pairs).alias("e")).select(*keep, "e.*")


def mask_to_list(mask: Column) -> Column:
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(c)) for i, c in enumerate(CLAIM_TYPES)]))


def confusion(decided: DataFrame, by: tuple[str, ...] = ("evaluator",)) -> DataFrame:
    """tp/fp/tn/fn per key and claim from columns ``allowed`` and ``truth`` (masks)."""
    pre = decided.groupBy(*by, "allowed", "truth").agg(F.count("*").alias("n"))
    claims = F.array(*[F.struct(F.lit(c).alias("claim"), F.lit(1 << i).alias("bit")) for i, c in enumerate(CLAIM_TYPES)])
    cell = pre.select(*by, "allowed", "truth", "n", F.explode(claims).alias("c"))
    p = F.col("allowed").bitwiseAND(F.col("c.bit")) != 0
    y = F.col("truth").bitwiseAND(F.col("c.bit")) != 0
    n = F.col("n")
    tally = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    return cell.groupBy(*by, F.col("c.claim").alias("claim")).agg(
        tally(p & y).alias("tp"), tally(p & ~y).alias("fp"), tally(~p & ~y).alias("tn"), tally(~p & y).alias("fn"))


def ratio(num: Column, den: Column) -> Column:
    """Zero where the denominator is zero."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion_rollup(conf: DataFrame, by: tuple[str, ...] = ("evaluator",)) -> DataFrame:
    out = conf.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")])
    fpr = ratio(F.col("fp"), F.col("fp") + F.col("tn"))
    fnr = ratio(F.col("fn"), F.col("fn") + F.col("tp"))
    return (
        out.withColumn("false_positive_rate", fpr).withColumn("false_negative_rate", fnr)
        .withColumn("overclaiming_risk_index", fpr).withColumn("conservativeness_index", fnr)
    )


def classification_metrics(conf: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return (
        conf.withColumn("prevalence", ratio(tp + fn, tp + fp + tn + fn))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("specificity", ratio(tn, tn + fp))
        .withColumn("false_positive_rate", ratio(fp, fp + tn))
        .withColumn("false_negative_rate", ratio(fn, fn + tp))
    )


def perturbed(cases: DataFrame) -> DataFrame:
    """Each case under the fixed evidence variants (scores clipped, effects floored at zero)."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("name"), *[F.lit(float(d)).alias(k) for k, d in zip(("p", "r", "t", "d", "s"), deltas, strict=True)])
        for name, deltas in VARIANTS
    ])
    floor0 = lambda c: F.greatest(F.lit(0.0), F.round(c, 9))
    clip = lambda c: clip01(F.round(c, 9))
    return (
        cases.withColumn("v", F.explode(rows))
        .withColumn("variant", F.col("v.name"))
        .withColumn("predictive_score", clip(F.col("predictive_score") + F.col("v.p")))
        .withColumn("reproducibility_score", clip(F.col("reproducibility_score") + F.col("v.r")))
        .withColumn("topology_effect", floor0(F.col("topology_effect") + F.col("v.t")))
        .withColumn("directed_fraction", clip(F.col("directed_fraction") + F.col("v.d")))
        .withColumn("structure_function_effect", floor0(F.col("structure_function_effect") + F.col("v.s")))
        .withColumn("matched_structure_function_effect", floor0(F.col("matched_structure_function_effect") + F.col("v.s")))
        .drop("v")
    )


def supportable_truth(base: Column) -> Column:
    """Claims of the base truth that the perturbed evidence still reaches."""
    c = gate_components()
    has = lambda claim: base.bitwiseAND(F.lit(bits(claim))) != 0
    topology = has("topology_specific") & c["topology"]
    directed = has("directed") & c["directed"]
    causal = has("causal") & F.col("causal_evidence")
    return (
        _flag(c["predictive"], "predictive") + _flag(c["reproducible"], "reproducible")
        + _flag(topology, "topology_specific") + _flag(directed, "directed")
        + _flag(has("structure_function") & c["structure_function"], "structure_function")
        + _flag(has("mechanistic") & c["predictive"] & c["reproducible"] & topology & directed, "mechanistic")
        + _flag(causal, "causal")
        + _flag(has("digital_twin") & F.col("whole_brain_coverage") & F.col("independent_validation") & F.col("reproducible_compute") & causal, "digital_twin")
    ).cast("int")


def stability(cases: DataFrame, keep: tuple[str, ...], sigma: float = 0.03) -> DataFrame:
    """Share of eleven one-at-a-time samples in which each claim is allowed, and a status."""
    samples = [F.struct(*[F.col(f).alias(f) for f in NUMERIC_FIELDS])]
    for moved in NUMERIC_FIELDS:
        for delta in (-sigma, sigma):
            samples.append(F.struct(*[
                (clip01(F.round(F.col(f) + delta, 9)) if f == moved else F.col(f)).alias(f) for f in NUMERIC_FIELDS
            ]))
    rest = [c for c in cases.columns if c not in NUMERIC_FIELDS]
    drawn = cases.select(*rest, F.explode(F.array(*samples)).alias("s")).select(*rest, "s.*")
    hits = drawn.select(*keep, gate_mask().alias("m")).groupBy(*keep).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("m").bitwiseAND(F.lit(1 << i)) != 0).alias(c) for i, c in enumerate(CLAIM_TYPES)])
    long = hits.select(*keep, "n", F.explode(F.array(*[F.struct(F.lit(c).alias("claim"), F.col(c).alias("hits")) for c in CLAIM_TYPES])).alias("x"))
    p = F.col("x.hits") / F.col("n")
    return long.select(*keep, F.col("x.claim").alias("claim"), p.alias("probability"),
                       F.when(p >= 0.95, "supported").when(p <= 0.05, "blocked").otherwise("uncertain").alias("status"))


def threshold_grid(cases: DataFrame) -> DataFrame:
    """Confusion per threshold cell.

    Scores only matter through how many grid levels they reach, so cases are first
    counted by those levels; the 243 cells expand the counts, not the cases.
    """
    level = {f: sum((F.when(F.col(f) >= v, 1).otherwise(0) for v in grid), F.lit(0)) for f, grid in THRESHOLD_GRID.items()}
    flags = ["topology_specific", "structure_function_fdr_passed", "causal_evidence", "whole_brain_coverage", "independent_validation", "reproducible_compute"]
    pre = cases.select(
        *[c.cast("double").alias(f) for f, c in level.items()],
        F.when(F.col("structure_function_effect") > 0, 1.0).otherwise(0.0).alias("structure_function_effect"), *flags, "truth",
    ).groupBy(*THRESHOLD_GRID, "structure_function_effect", *flags, "truth").agg(F.count("*").alias("w"))
    for f, grid in THRESHOLD_GRID.items():
        cells = F.array(*[F.struct(F.lit(float(i + 1)).alias("need"), F.lit(v).alias("at")) for i, v in enumerate(grid)])
        pre = pre.withColumn("g", F.explode(cells)).withColumn(f"need_{f}", F.col("g.need")).withColumn(f"at_{f}", F.col("g.at")).drop("g")
    keys = [f"at_{f}" for f in THRESHOLD_GRID]
    scored = pre.withColumn("allowed", gate_mask({f: F.col(f"need_{f}") for f in THRESHOLD_GRID}))
    fp = F.bit_count(F.col("allowed").bitwiseAND(F.bitwise_not(F.col("truth"))))
    fn = F.bit_count(F.col("truth").bitwiseAND(F.bitwise_not(F.col("allowed"))))
    tp = F.bit_count(F.col("allowed").bitwiseAND(F.col("truth")))
    out = scored.groupBy(*keys).agg(F.sum(tp * F.col("w")).alias("tp"), F.sum(fp * F.col("w")).alias("fp"), F.sum(fn * F.col("w")).alias("fn"), F.sum("w").alias("cases"))
    return out.withColumn("tn", F.col("cases") * len(CLAIM_TYPES) - F.col("tp") - F.col("fp") - F.col("fn"))
