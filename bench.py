"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local cores, ``BENCH_QUERIES`` an optional
list of query names (``all`` for every registered query).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pulsewake.plans import catalogue
from pulsewake.runtime import build_session

HEADLINE = [
    "c01_influence_score", "c01_influence_by_bandwidth", "c02_shock_influence", "j05_range_join",
    "c08_volume_price_study", "w04_autocorrelation", "a10_percentiles", "a21_five_numbers", "x11_min_max_scale",
    "a16_key_distinct_first", "a18_article_distinct", "c06_corpus", "c07_post_cleanse", "c09_follower_band", "c10_account_timeline",
    "g02_degrees", "g03_pagerank", "g04_triangles", "g06_closeness",
    "e08_publish_date", "e12_choose_title", "e15_choose_text", "f19_article_classifier", "x31_link_edges", "c11_archive_to_articles",
    "w05_versions", "t04_throttle_batch", "t03_stream_volume", "t06_stream_interval_join",
]


def run_once(spark, name: str, folder: str) -> float:
    begin = time.perf_counter()
    catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = list(catalogue.QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session("bench", cores=cpus, partitions=int(cpus))
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{folder}/events.parquet").count()  # start the workers
    seconds = {}
    for name in names:
        times = [run_once(spark, name, folder) for _ in range(repeats)]
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name:40s} {seconds[name]:8.3f}  {[round(t, 2) for t in times]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_median_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
