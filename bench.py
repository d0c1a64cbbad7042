"""Headline timings: one JSON line. Each query is warmed up once, then timed; the median counts."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pipescope.functions.text import whitespace_tokens  # noqa: E402
from pipescope.operators import permutation, vocabulary  # noqa: E402
from pipescope.plans.catalog import QUERIES  # noqa: E402
from pipescope.plans.catalog.analytics import timed_groups  # noqa: E402
from pipescope.session import get_session  # noqa: E402
from pipescope.sources import views  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
BUDGET = 25.0  # seconds after which a query is not repeated


def training_times(spark, sf_dir):
    from pyspark.sql import functions as F

    return timed_groups(spark, sf_dir).withColumn("x", F.col("grp") == "BOW")


def permutations(n):
    return lambda spark, d: permutation.monte_carlo_test(training_times(spark, d), "total_time", "x", "run_key", n)


def digest_permutations(n):
    return lambda spark, d: permutation.permutation_test(training_times(spark, d), "total_time", "x", "run_key", n)


def merges(rounds):
    return lambda spark, d: vocabulary.bpe_tokens(views.table(spark, d, "documents"), rounds)


BENCH = {
    "best_configs": QUERIES["best_configs"],
    "variance_decomposition": QUERIES["variance_decomposition"],
    "box_by_model": QUERIES["box_by_model"],
    "paired_features": QUERIES["paired_features"],
    "reconciled_log": QUERIES["reconciled_log"],
    "signed_rank_pairs": QUERIES["signed_rank_pairs"],
    "regression_metrics": QUERIES["regression_metrics"],
    "tf_idf_features": QUERIES["tf_idf_features"],
    "mean_word_vectors": QUERIES["mean_word_vectors"],
    "stemmed_text": QUERIES["stemmed_text"],
    "permutation_200_by_digest": digest_permutations(200),
    "permutation_1000": permutations(1000),
    "permutation_100000": permutations(100_000),
    "byte_pair_20_rounds": merges(20),
}


def seconds(spark, fn) -> float:
    start = time.perf_counter()
    fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = get_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, fn in BENCH.items():
        if len(sys.argv) > 1 and name not in sys.argv[1:]:
            continue
        first = seconds(spark, fn)
        runs, spent = [], first
        while len(runs) < RUNS and spent < BUDGET:
            runs.append(seconds(spark, fn))
            spent += runs[-1]
        times[name] = round(statistics.median(runs or [first]), 3)
        print(f"{name}: {times[name]} s (first {first:.2f}, {len(runs)} timed)", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": SF_DIR.rstrip("/").rsplit("/", 1)[-1]}))


if __name__ == "__main__":
    main()
