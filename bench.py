"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (cores), BENCH_QUERIES (names, or "all"), BENCH_BLOCK_ROWS (groups
above so many rows are split, to time the split plans on small tables).
Every query is built and written to the no-op sink once, so the whole result is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from trailmark.catalog import registry

HEADLINE = (
    "bucket_counts", "assign_buckets", "domain_tertiles", "candidate_groups", "first_nav_candidate",
    "visible_elements", "simplify_observation", "clean_html", "parse_id_action", "action_key",
    "unusual_actions", "action_type_distribution", "judgement_stats", "score_answers", "must_include", "rouge1",
    "satisfies", "breakdown_by_site", "site_pass_rate", "upsert_tasks", "latest_run", "metric_pivot",
    "validation_by_agent", "drop_repeated_actions", "keep_recent_messages", "keep_head_tail",
    "stitch_conversations", "stop_reasons", "next_goal", "chunk_episodes", "sliding_clips", "nstep_transitions",
    "split_by_frames", "goal_satisfied", "inventory_totals", "promote_children", "render_tree", "label_boxes",
    "label_overlaps", "token_estimate", "parse_run_log", "merge_logs", "stream_run_ledger", "idle_sessions",
)


def session(cores: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trailmark-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("BENCH_BLOCK_ROWS"):
        spark.conf.set("trailmark.blockRows", os.environ["BENCH_BLOCK_ROWS"])
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    spark = session(cores)
    queries = registry.queries()
    names = list(queries) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "total wall clock of the headline queries", "value": total, "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
