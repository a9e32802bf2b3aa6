"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from evalmill.plans import load_all
from evalmill.plans.catalog import QUERIES
from evalmill.session import get_session

HEADLINE = [
    "leaderboard_end_to_end", "f1_accuracy", "f7_token_f1", "f12_option_similarity", "f22_rouge_n", "f23_rouge_l", "f24_corpus_bleu",
    "f29_auc", "f32_class_report", "f38_pass_at_k", "f39_g_pass_at_k", "f42_majority_vote", "f43_min_loss_choice",
    "f45_choice_probabilities", "f47_bits_per_byte", "f49_min_k_percent", "f51_sliding_windows", "f57_circular_set", "f61_sliced_accuracy",
    "f62_instruction_following", "e1_general", "e3_first_option", "e6_final_answer", "e9_strip_reasoning", "b1_index_items",
    "b4_sample_exact", "b13_chat_histories_every", "b16_permute_options", "b22_dedup_items", "c3_retrieve_random", "c5_retrieve_bm25",
    "c6_retrieve_dense", "c8_select_vote_k", "d5_pair_predictions", "d9_bad_cases", "g6_mean_of_means", "g11_win_rates",
    "g21_bradley_terry", "g22_bootstrap_intervals", "g24_online_elo", "g28_group_scores", "g29_leaderboard_pivot", "h1_mask_tokens",
    "h6_continuation_probes", "h7_needle_haystack", "h17_running_accuracy",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").split("sf")[-1]}
        )
    )


if __name__ == "__main__":
    main()
