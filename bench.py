"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local threads. ``BENCH_QUERIES=all`` times
every registered query. The line also holds the machine and the time of a fixed calibration job, so
that runs on different machines can be compared, and ``derive_inputs``, the writing of the click log
and the interaction table that the queries read.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from clickmill.plans import registry
from clickmill.plans.fixtures import Tables

HEADLINE = [
    "rsh_1_interactions", "agg_1_article_clicks", "agg_4_article_table", "agg_4_category_table",
    "agg_5_counts_per_impression", "dt_4_hourly_clicks", "agg_8_rating_lists", "agg_10_median_hour",
    "fea_1_taste_profile", "fea_2_user_features", "fea_3_item_features", "win_6_long_tail",
    "win_8_next_item_examples", "voc_2_frequency_vocabulary", "txt_1_bag_of_words", "txt_2_tf_idf",
    "txt_3_token_ids", "spl_1_exact_counts", "agg_12_user_by_item_cluster",
    "agg_13_user_cluster_by_item", "fac_1_gradient_step", "fac_2_least_squares_round", "fm_3_scores",
    "knn_1_similar_users", "knn_3_both_sides_large", "ret_1_top_k_by_product", "rec_5_hybrid_top_n",
    "clu_4_user_clusters",
]


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    calibration = timed(
        lambda: spark.range(0, 400_000_000, 1, int(cpus)).selectExpr("sum(xxhash64(id) % 97)").collect()
    )
    tables = Tables(spark, sf_dir)
    derive = timed(lambda: (tables.behaviors, tables.interactions))
    names = list(registry.QUERIES) if os.environ.get("BENCH_QUERIES") == "all" else HEADLINE
    seconds = {"derive_inputs": derive}
    for name in names:
        seconds[name] = timed(
            lambda: registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        )
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "calibration_sec": calibration,
        "cpus": int(cpus),
        "memory_gb": round(os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
