"""Times the headline queries on the parquet files of $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelfill.catalog import QUERIES  # noqa: E402
from panelfill.sources.survey import Survey  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "j1_attribute_matrix",
    "d4_count_distinct",
    "d6_pivot_labels",
    "j7_univariate_report",
    "f1_bootstrap_share_bounds",
    "f2_chi2_scores",
    "f5_ks_two_sample",
    "f6_roc_auc",
    "f9_best_mcc_threshold",
    "h4_calibrate_waves",
    "j5_next_round_features",
    "j14_audience_shares",
    "g7_fit_newton_boost",
    "i4_mice",
]
INPUTS = ["latent", "bsm", "matrix", "distributions", "model_plan", "scores", "answer_pairs"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    survey = Survey(spark, FOLDER)
    start = time.time()
    inputs = {}
    for name in INPUTS:
        begin = time.time()
        getattr(survey, name)
        inputs[name] = round(time.time() - begin, 3)
    prepare = time.time() - start
    times = {}
    for name in names:
        begin = time.time()
        # every result row is computed; nothing is stored
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds", "value": round(prepare + sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS),
                "prepare_inputs": {"value": round(prepare, 3), **inputs},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
