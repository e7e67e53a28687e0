"""Times the headline queries: every row is computed and discarded, nothing is collected. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import workload  # noqa: E402

HEADLINE = [
    "flagship_prepare_orders",
    "q_filter_select_sort_limit",
    "q_distinct_rows",
    "q_key_batches",
    "q_key_batches_hot_key",
    "q_primary_key_candidates",
    "q_frame_diff",
    "s_improve_schema",
    "s_date_sniff",
    "s_semantic_type",
    "s_csv_null_tokens",
    "s_schema_unify",
    "p_date_split_rows",
    "p_random_split",
    "a_numeric_stats",
    "a_mode_last_value",
    "a_unique_counts",
    "a_label_encoder",
    "e_clip_then_mean",
    "e_categorical_other",
    "n_one_hot",
    "n_ordinal_many",
    "d_normalize_train",
    "d_process_all_splits",
    "f_lag_by_user",
    "f_lag_hot_user",
    "f_last_purchase_before",
    "f_stored_feature",
    "w_append_only_dedupe",
    "w_partitioned_roundtrip",
    "w_compact_roundtrip",
    "b_embed_distinct",
    "b_incremental",
    "v_regression",
    "v_auc",
    "m_train_score_regression",
    "m_scoring_job",
    "t_stream_score",
    "t_stream_append_only",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tabflow-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().write.format("noop").mode("overwrite").save()
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        workload.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
