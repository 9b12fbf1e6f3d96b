"""Time the headline queries and print one JSON line.

Every query runs to the end through the noop sink, so no column is pruned away and nothing
is collected. ``value`` is the sum of the warm times, ``cold`` that of the first runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from anchorgrid.plans import load_all  # noqa: E402
from anchorgrid.session import local_session  # noqa: E402

HEADLINE = (
    "flagship_anchor_grid", "J1_anchor_window_join", "J2_nearest_cue_distance", "J13_all_word_windows", "V9_window_grid",
    "W1_speaker_turns", "F28_turn_position", "X1_sentences", "M3_very_strict_controls", "M8_uniform_subsample",
    "V1_group_folds", "V2_rotated_splits", "V5_duplicate_audit", "T3_rates", "T9_grid_interpolation", "T10_channel_matrix",
    "T14_highpass_local_norm", "T25_grid_warp", "C3_four_poolings", "C6_sparse_scaler", "C11_symbolic_words",
    "C15_interval_features", "L1_anova_f", "L4_stable_ranking", "A1_threshold_metrics", "A2_roc_auc", "A5_best_threshold",
    "A11_bootstrap_macro_f1", "A15_cluster_bootstrap", "A20_sampled_shapley", "A23_robustness_conditions",
    "D6_inverse_distance_knn", "D10_frame_tags", "D12_score_exact", "K2_tokenize", "A36_model_ranking",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = load_all()[0]

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the session's threads
    cold = {name: run(name) for name in HEADLINE}
    warm = {name: run(name) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
        "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
