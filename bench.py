"""Headline queries timed once each after a warm-up: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

from longomics.plans import catalog
from longomics.session import local_session

HEADLINE = [
    "transcript_to_gene", "profile_full", "key_characteristics", "method_recommendation",
    "library_quality", "gene_detection", "biological_signal", "variance_structure", "outliers_consensus",
    "quality_report", "quantile_normalise_ordinal", "median_ratio", "pool_inner", "pool_median_centre",
    "source_de_result", "de_standardise", "benjamini_hochberg", "per_gene_de_welch",
    "tuning_ground_truth", "tuning_fdr", "tuning_reproducibility",
    "fisher_ensemble", "rank_ensemble", "voting_ensemble", "weighted_ensemble",
    "consensus_ranking", "ratio_search", "auc", "bootstrap_auc", "decision_curve",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cores=cores, shuffle=cores)
    catalog.QUERIES["sample_totals"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
