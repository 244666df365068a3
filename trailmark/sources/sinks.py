"""Sinks: sorted CSV reports, bucket shards, traces, manifests and id lists.

All of them write from many tasks.  A sorted sink is range-partitioned, so its part files in name order hold
the sorted rows; small reports come out as one file because AQE joins their small partitions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.plans.lineage import ensure_checkpoint_dir

MAX_RECORDS = 1_000_000


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the session's checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/trailmark-{name}-{uuid.uuid4().hex}"


def write_csv_report(report: DataFrame, path: str, order: list[str]) -> None:
    report.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_bucket_shards(rows: DataFrame, path: str, filtered: bool = False) -> None:
    """One folder of JSON lines per bucket; ``|`` in a bucket name becomes ``__``."""
    name = F.replace(F.col("bucket"), F.lit("|"), F.lit("__"))
    name = F.concat(name, F.lit("__filtered")) if filtered else name
    shards = rows.withColumn("shard", name)
    shards.write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS).partitionBy("shard").json(path)


def write_result_json(details: DataFrame, path: str) -> None:
    """One JSON object per agent and task with summary and details."""
    details.write.mode("overwrite").json(path)


def write_trace_jsonl(traces: DataFrame, path: str, by_task: bool = False) -> None:
    """Trace lines, in one folder per task on demand.

    Inside a task the lines are sorted by index: rows are range-partitioned by (task, index), which also
    splits a very long task over several files.
    """
    ordered = traces.repartitionByRange("trace_id", "index").sortWithinPartitions("trace_id", "index")
    writer = ordered.write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS)
    (writer.partitionBy("trace_id") if by_task else writer).json(path)


def write_manifest(manifest: DataFrame, counts: DataFrame, path: str) -> None:
    """The listing of matched and missing ids, and one row of counts."""
    manifest.write.mode("overwrite").partitionBy("status").json(f"{path}/ids")
    counts.write.mode("overwrite").json(f"{path}/counts")


def split_rows_to_files(numbered_rows: DataFrame, path: str, position: str) -> None:
    """One folder per configuration row, named by its position."""
    numbered_rows.write.mode("overwrite").partitionBy(position).json(path)


def write_score_vector(lines: DataFrame, path: str) -> None:
    """Score lines in id order."""
    lines.orderBy("task_id").select("line").write.mode("overwrite").text(path)


def write_id_list(parts: DataFrame, path: str, name: str) -> None:
    """``{name}_train`` and ``{name}_val``: one episode per line."""
    for part in ("train", "val"):
        rows = parts.where(F.col("part") == part).select(F.col("episode_id").cast("string"))
        rows.write.mode("overwrite").text(f"{path}/{name}_{part}")
