"""Headline queries at one scale factor; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veriframe.plans import catalog  # noqa: E402
from veriframe.session import build_session  # noqa: E402

HEADLINE = (
    "g01_domain_gate",
    "g07_domain_and_integrity",
    "g05_structural_gate",
    "x02_mutation_scoring",
    "x04_attack_scoring",
    "t01_bm25_top_k",
    "c11_retrieval_audit",
    "a09_confusion_rollup",
    "g14_threshold_grid",
    "l04_threshold_curve",
    "j13_spike_windows",
    "e01_binned_rates",
    "w25_spearman",
    "j08_pair_frame",
    "i15_matched_null_means",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench")
    catalog.QUERIES["g01_domain_gate"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up, not timed
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    packages = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    rates = {
        "domain_packages_per_sec": round(packages / times["g01_domain_gate"]),
        "domain_integrity_packages_per_sec": round(packages / times["g07_domain_and_integrity"]),
        "structural_package_claims_per_sec": round(packages * 10 / times["g05_structural_gate"]),
    }
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "rates": rates,
    }))


main()
