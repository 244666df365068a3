"""Run logs: blocks per task, merged logs and error runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.text import contains_any

# Marks of failed runs and texts of logged-out pages.
ERROR_MARKS = ("[Unhandled Error]", "[OpenAI Error]")
LOGGED_OUT_TEXTS = (
    "Creating an account has many benefits: check out faster",
    "Welcome, please sign in",
    "Username or email",
    "Keep me logged in",
)


def log_blocks(logs: DataFrame, file: str, text: str) -> DataFrame:
    """One row per block of a log file: from a ``[Config file]`` line to the next one."""
    marked = logs.select(file, F.split(text, "\n").alias("_rows"))
    marks = F.array_compact(F.transform("_rows", lambda x, i: F.when(x.contains("[Config file]"), i + 1)))
    placed = marked.withColumn("_marks", marks)
    # Blocks are cut out before they become rows, so a row holds its own lines only.
    ends = F.concat(F.slice("_marks", 2, F.greatest(F.size("_marks") - 1, F.lit(0))), F.array(F.size("_rows") + 1))
    cut = F.transform(
        F.arrays_zip(F.col("_marks").alias("a"), ends.alias("b")), lambda m: F.slice("_rows", m["a"], m["b"] - m["a"])
    )
    flat = placed.where(F.size("_marks") > 0).select(file, F.posexplode(cut).alias("block", "_lines"))
    return flat.select(
        file, "block",
        F.regexp_extract(F.element_at("_lines", 1), r"([^/.]*)(?:\.[^/]*)?$", 1).try_cast("int").alias("task_id"),
        F.size("_lines").alias("n_lines"), F.array_join("_lines", "\n").alias("text"),
    )


def merge_logs(logs: DataFrame, file: str, text: str, renders: DataFrame) -> DataFrame:
    """The last block of every task that has a rendered page and at least three lines."""
    blocks = log_blocks(logs, file, text).where("n_lines >= 3 AND task_id IS NOT NULL")
    shown = blocks.join(renders.select("task_id").distinct(), "task_id", "left_semi")
    last = shown.groupBy("task_id").agg(
        F.max_by(F.struct(file, "n_lines", "text"), F.struct(file, "block")).alias("_b")
    )
    return last.select("task_id", "_b.*")


def unlogged_tasks(renders: DataFrame, merged: DataFrame) -> DataFrame:
    return renders.select("task_id").distinct().join(merged.select("task_id"), "task_id", "left_anti")


def unfinished_ids(expected: DataFrame, merged: DataFrame) -> DataFrame:
    return expected.select("task_id").join(merged.select("task_id"), "task_id", "left_anti")


def error_runs(merged: DataFrame) -> DataFrame:
    """Tasks with a failed line in their merged block, and how many such lines there are."""
    lines = F.filter(F.split("text", "\n"), lambda x: contains_any(x, ERROR_MARKS))
    return merged.select("task_id", F.size(lines).cast("long").alias("errors")).where("errors > 0")


def logged_out_pages(pages: DataFrame, text: str, marks: tuple[str, ...] = LOGGED_OUT_TEXTS) -> DataFrame:
    return pages.where(contains_any(F.col(text), marks))
