"""Seconds per query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortry.catalog import QUERIES  # noqa: E402
from cohortry.plans.session import local_session  # noqa: E402

HEADLINE = [
    "a7_patient_complete_view", "e7_feature_table", "a1_variants_per_subject", "a3_counts_per_subject",
    "a8_prediction_stats", "a9_value_counts", "a11_describe", "a13_correlation_matrix", "a14_histogram",
    "a18_classification_metrics", "a19_roc_auc", "v5_unique_all_copies", "v7_failure_report", "v8_keep_valid_rows",
    "v9_first_per_key", "p10_interactions", "p11_polynomial", "e3_standard_scale", "j1_merge_modalities",
    "j3_imaging_join", "j5_similar_by_profile", "w1_top_k_per_group", "w3_stratified_split",
    "w5_compare_distributions", "u3_upsert", "u4_cascade_delete", "g1_merge_nodes", "g4_k_hop_nodes",
    "g5_similar_by_graph", "g7_degree_centrality", "g8_edge_index", "g10_propagate_features", "t1_recursive_chunks",
    "t1b_window_chunks", "t2_chunk_identity", "t5_vector_search", "m6_hard_vote", "m7_weighted_vote",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{folder}/nation.parquet").count()  # start-up is not a query's time
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds over headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
