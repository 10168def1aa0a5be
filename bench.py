"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from shelfline.registry import QUERIES

HEADLINE = [
    "basket_penetration", "basket_penetration_over_time", "basket_composition", "customer_entropy", "cohort_sizes", "cohort_retention", "abc_analysis", "xyz_analysis", "association_rules", "addon_lift",
    "affinity", "switching_matrix", "demand_transference", "rfm_segments", "value_segments", "clv_bg_nbd", "assortment_greedy", "own_price_elasticity", "kvi_scores", "detect_promotions", "promo_cannibalization", "category_kpis",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
