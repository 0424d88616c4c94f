"""Times the headline queries: one JSON line. BENCH_SF_DIR: tables; BENCH_CPUS: local cores."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}".rstrip(":")

HEADLINES = [
    "rule_filter_revenue", "if_band", "mul", "add", "round_pos_neg", "cat", "stringformat", "datedif_units", "map", "sum_field_threshold", "valueat", "match_multi_df",
    "matchrange_df", "choose_df", "valueat_match_fused_df", "table_repeat_lag", "table_recurrence_fold", "schema_topo_fields", "validate_summary", "dependents_chain", "subform_rollup",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from ruleweave.queries import QUERIES

    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, rows = {}, {}
    spark.read.parquet(f"{d}/lineitem.parquet").count()
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    for name in ("if_band", "mul", "validate_summary", "schema_topo_fields"):
        n = QUERIES[name](spark, d).count()
        rows[name] = round(n / took[name])
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "documents_per_second": rows, "sf": os.path.basename(d.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
