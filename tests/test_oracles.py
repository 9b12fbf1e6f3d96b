"""Registered queries against their SQL twins on the smallest tables.

ANCHORGRID_ORACLES=all runs every query; by default a spread of them keeps the suite short.
"""

import os

import pytest

from anchorgrid.plans import load_all
from tests.oracle_check import TABLES, check

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_all()
SPREAD = (
    "S1_scan_words_scope S7_read_predictions S10_negation_links S11_fold_sink F11_bit_flags F17_parse_family J1_anchor_window_join "
    "J2_nearest_cue_distance J12_dataset_inventory M1_coarse_controls M3_very_strict_controls M8_uniform_subsample V1_group_folds "
    "V5_duplicate_audit W1_speaker_turns X1_sentences T3_rates T9_grid_interpolation T14_highpass_local_norm T20_derived_standardization "
    "T21_mirror_copies T25_grid_warp A1_threshold_metrics A2_roc_auc A5_best_threshold A11_bootstrap_roc_auc A12_paired_bootstrap "
    "A20_sampled_shapley A36_model_ranking D6_inverse_distance_knn D10_frame_tags W7_decode_spans C6_sparse_scaler C13_chi2_top_words "
    "C15_interval_features L4_stable_ranking L5_budget_allocation K2_tokenize K5_span_corruption K7_inbetween Z2_stream_rates Z3_stream_sliding S6_load_fold_dataset "
    "S8_read_summaries V6_fold_compatibility V9_window_grid D5_keyed_components A11_bootstrap_macro_f1 A22_retraining_variants flagship_anchor_grid"
).split()
NAMES = list(QUERIES) if os.environ.get("ANCHORGRID_ORACLES") == "all" else SPREAD


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    ok, text = check(spark, duck, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert ok, text


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
