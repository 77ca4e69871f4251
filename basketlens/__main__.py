"""Runs the analysis stages over CSV files: ``spark-submit`` or ``python -m basketlens --help``."""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import DataFrame

from basketlens.plans.stages import NAMED, run_all, run_ltv, run_patterns, run_profile, run_segmentation
from basketlens.session import build_session, scratch
from basketlens.sources import files, handoff


def show(report: object, out: str) -> None:
    """Where each report of a stage lies, and its single numbers."""
    for field in fields(report):
        value = getattr(report, field.name)
        if isinstance(value, DataFrame):
            value = f"{out}/reports/{NAMED.get(field.name, (field.name,))[0]}"
        print(f"{field.name}: {value}")


def main() -> None:
    parser = argparse.ArgumentParser(prog="basketlens")
    parser.add_argument("--customers", required=True)
    parser.add_argument("--products", required=True)
    parser.add_argument("--sales", required=True)
    parser.add_argument("--out", required=True, help="folder for tables and reports, shared by all executors")
    parser.add_argument("--stage", choices=("profile", "segmentation", "ltv", "patterns", "all"), default="all")
    parser.add_argument("--as-of-months", type=int, default=0, help="compute features only from before this many last months")
    parser.add_argument("--max-k", type=int, default=10, help="largest number of clusters that the scan tries")
    parser.add_argument("--master", help="only for local runs")
    options = parser.parse_args()

    spark = build_session(master=options.master)
    retail, shapes = handoff.hand_off_retail(spark, options.customers, options.products, options.sales, options.out)
    files.write_report(shapes, f"{options.out}/reports/dataset_shapes")
    tables = f"{options.out}/tables"
    with scratch(spark):
        if options.stage == "all":
            reports = run_all(retail, options.out, options.as_of_months, options.max_k)
        elif options.stage == "profile":
            reports = (run_profile(retail, options.out),)
        elif options.stage == "segmentation":
            reports = (run_segmentation(retail, options.out, max_k=options.max_k),)
        else:
            segments = spark.read.parquet(f"{tables}/segmentation")
            if options.stage == "ltv":
                reports = (run_ltv(retail, segments, options.out, as_of_months=options.as_of_months),)
            else:
                predictions = spark.read.parquet(f"{tables}/ltv_predictions")
                reports = (run_patterns(retail, segments, predictions, options.out),)
        for report in reports:
            show(report, options.out)


if __name__ == "__main__":
    main()
