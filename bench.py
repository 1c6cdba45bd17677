"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gleanframe.registry import QUERIES  # noqa: E402
from gleanframe.session import local_session  # noqa: E402

HEADLINE = [
    "describe_numeric", "null_profile", "quantiles", "outlier_counts", "table_quality", "health_score", "top_values",
    "profile_table", "segment_stats", "histogram", "clean_default_rules", "clean_dedup", "clean_dedup_by_key",
    "clip_outliers_iqr", "coerce_currency", "redact_text", "infer_types", "column_catalog", "corr_pearson",
    "corr_spearman", "driver_scenario", "cohort_uplift", "resample_monthly", "trend_forecast", "index_trend",
    "row_index", "ownership_chain", "usage_by_user", "token_usage", "conversation_list", "search_rows",
    "metrics_classification", "metrics_auc", "table_report", "load_csv_typed", "stream_kpi", "corr_kendall",
    "corr_spearman_nulls", "version_lineage", "conversation_threads", "safe_summary", "ml_linear",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    # one JSON line on the real output, whatever else writes there meanwhile
    out = os.dup(1)
    os.dup2(2, 1)
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # a query that is not timed, so that the first one does not pay for loading the engine's classes
    QUERIES["corr_pearson_nulls"](spark, folder).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # the noop sink computes every row and column without bringing them to the driver
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    line = {
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }
    os.write(out, (json.dumps(line) + "\n").encode())


if __name__ == "__main__":
    main()
