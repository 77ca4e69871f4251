"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from basketlens.plans import catalog
from basketlens.session import build_session, scratch

HEADLINES = (
    "category_performance",
    "monthly_trends",
    "order_lines",
    "rfm",
    "rfm_describe",
    "customer_features",
    "segment_summary",
    "top_categories_by_segment",
    "segment_price_sensitivity",
    "segment_trends",
    "ltv_class",
    "mall_best_seller",
    "top_products",
    "sales_overview",
    "mall_growth_index",
    "order_category_combinations",
    "copurchase_edges",
    "category_copurchase_edges",
    "largest_component",
    "price_frequency_table",
    "category_price_stats",
    "clean_product_ids",
    "kmeans_segments",
    "train_ltv_regressor",
    "predict_customers",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        "spark.checkpoint.dir": os.environ.get("BENCH_CHECKPOINT_DIR", os.path.abspath("spark-warehouse/bench")),
    })
    spark.sparkContext.setLogLevel("ERROR")
    # one untimed run starts the session: class loading, code generation, executor threads
    catalog.queries()["category_performance"](spark, folder).collect()
    timings = {}
    for name in HEADLINES:
        start = time.perf_counter()
        with scratch(spark):  # its own intermediate tables; a fresh set of queries shares no model fits with the one before
            catalog.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(folder).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
