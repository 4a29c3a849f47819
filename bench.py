"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. A query is executed in full and its rows
are thrown away. Each runs once to warm up and then up to three times; the median counts. Queries
slower than BENCH_ONCE_ABOVE seconds in their first run are taken from that run.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from dispatchery.plans import load
from dispatchery.session import local_session
from dispatchery.sources.archive import Archive

HEADLINE = (
    "k2_day_ranking", "a15_agreement", "p11_day_pool", "w6_arrangements", "j3_day_stories", "l2_reading_order",
    "a6_tag_counts", "a21_published_checks", "f1_numeral_values", "a16_word_budget", "p1_canonical_url",
    "p4_normal_title", "p9_body_choice", "a8_run_ledger", "w10_step_shares", "w8_source_health", "w11_daily_budget",
    "s4_insert_if_absent", "s13_rebuild", "k3_search_en", "s1_feed_items", "s2_page_text", "t2_source_state",
    "f17_title_scores", "k1_duplicate_resolution",
)


def timed(fn, spark, folder) -> float:
    started = time.perf_counter()
    fn(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    once = float(os.environ.get("BENCH_ONCE_ABOVE", "4"))
    spark = local_session(cores, partitions=max(cores, 1))
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().queries
    # What a press stores is written before the clock starts: bulletins, items and the facts of bodies.
    started = time.perf_counter()
    archive = Archive.at(spark, folder)
    for stored in (archive.bulletins, archive.items, archive.facts):
        stored.count()
    stored_seconds = round(time.perf_counter() - started, 3)
    seconds = {}
    for name in HEADLINE:
        first = timed(queries[name], spark, folder)
        if first > once:
            seconds[name] = round(first, 3)
            continue
        seconds[name] = round(statistics.median(timed(queries[name], spark, folder) for _ in range(3)), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "stored_before_sec": stored_seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cores,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
