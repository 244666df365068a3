"""Profiles of actions and audits of single steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import actions as a
from trailmark.functions.text import truncate
from trailmark.plans.lookups import attach
from trailmark.plans.sequences import framed, numbered


def with_previous_step(steps: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Add ``has_prev_step`` and the named columns of the step before as ``prev_*``."""
    made = {"_before": lambda w: F.lag(F.lit(1)).over(w)}
    for name in columns:
        made[f"prev_{name}"] = lambda w, name=name: F.lag(name).over(w)
    out = framed(steps, ["task_id"], order, made, before=1)
    return out.withColumn("has_prev_step", F.col("_before").isNotNull()).drop("_before")


def goback_samples(steps: DataFrame, action: str = "chosen", name: str = "go_back") -> DataFrame:
    """Steps whose chosen action mentions ``name``."""
    return steps.where(a.contains_action(F.col(action), name)).withColumn("context", F.lit("chosen"))


def goback_by_context(samples: DataFrame) -> DataFrame:
    return samples.groupBy("context", "source_name").agg(F.count(F.lit(1)).alias("samples"))


def task_context(steps: DataFrame, wanted: DataFrame, texts: dict[str, int]) -> DataFrame:
    """Every step of the wanted tasks with its long texts cut, one row per step.

    A task's steps stay rows instead of one nested value, so a task of any length fits.
    """
    hit = wanted.select("task_id").distinct()
    kept = attach(steps, hit.withColumn("_hit", F.lit(1)), ["task_id"], "inner").drop("_hit")
    for name, size in texts.items():
        kept = kept.withColumn(name, truncate(F.col(name), size))
    return kept


VERDICTS = ("reasonable", "unreasonable", "skipped", "error", "parse_error", "missing")


def attach_judgements(steps: DataFrame, judgements: DataFrame, on: list[str]) -> DataFrame:
    """Steps with their stored verdict and one explicit ``verdict`` class."""
    found = attach(steps, judgements.withColumn("_found", F.lit(1)), on)
    verdict = (
        F.when(F.col("_found").isNull(), "missing")
        .when(F.col("skipped").isNotNull(), "skipped")
        .when(F.col("error").isNotNull(), "error")
        .when(F.coalesce(F.col("parse_error"), F.lit(False)), "parse_error")
        .when(F.coalesce(F.col("is_reasonable"), F.lit(False)), "reasonable")
        .otherwise("unreasonable")
    )
    return found.withColumn("verdict", verdict).drop("_found")


def judgement_stats(judged: DataFrame, by: list[str]) -> DataFrame:
    """Verdict classes, mean confidence over positive values and low-confidence count per group."""
    usable = F.col("verdict").isin("reasonable", "unreasonable", "parse_error", "skipped")
    positive = usable & (F.col("confidence") > 0)
    return judged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("verdict") == name).alias(name) for name in VERDICTS],
        F.avg(F.when(positive, F.col("confidence"))).alias("avg_confidence"),
        F.count_if(positive & (F.col("confidence") < 0.8)).alias("low_confidence"),
    )


def judgement_categories(judged: DataFrame) -> DataFrame:
    """Rows per category of the usable verdicts."""
    usable = judged.where(F.col("verdict").isin("reasonable", "unreasonable"))
    category = F.coalesce(F.col("category"), F.lit("unknown"))
    return usable.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("samples"))


def first_examples(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps only ``k`` per group before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def history_actions(steps: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct base action in the history of a step."""
    names = F.array_distinct(F.transform("history", a.base_action))
    return steps.select(*keys, F.explode(names).alias("action"))


def unusual_actions(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Actions outside the space: rows that hold them and distinct tasks."""
    outside = history_actions(steps, keys).where(~a.in_action_space(F.col("action")))
    return outside.groupBy("action").agg(
        F.count(F.lit(1)).alias("count"), F.count_distinct("task_id").alias("tasks")
    )


def unusual_action_rows(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Every (action, row) outside the space: the full listing behind the counts."""
    return history_actions(steps, keys).where(~a.in_action_space(F.col("action")))


def frequency_bands(counts: DataFrame, count: str = "count") -> DataFrame:
    """How many names fall into each frequency band."""
    n = F.col(count)
    band = (
        F.when(n >= 10, "high(>=10)").when(n >= 5, "mid(5-9)").when(n >= 2, "low(2-4)").otherwise("single")
    )
    return counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("names"))


def action_variants(names: DataFrame) -> DataFrame:
    """Standard actions that an unusual name may stand for; the standard side is a fixed list of 13."""
    standard = F.array(*[F.lit(name) for name in a.ACTION_SPACE])
    pairs = names.select("action", F.explode(standard).alias("standard"))
    return pairs.where(a.matches_variant(F.col("action"), F.col("standard")))


def all_actions(steps: DataFrame) -> Column:
    """History, chosen and rejected actions of a step as one array."""
    return F.concat("history", F.array("chosen"), F.array("rejected"))


def action_type_distribution(steps: DataFrame) -> DataFrame:
    """Uses of every action type, duplicates included, and distinct written actions."""
    flat = steps.select(F.explode(all_actions(steps)).alias("written"))
    written = flat.groupBy("written").agg(F.count(F.lit(1)).alias("_n"))
    return written.groupBy(a.action_type(F.col("written")).alias("action_type")).agg(
        F.sum("_n").alias("count"), F.count(F.lit(1)).alias("distinct_actions")
    )


def actions_by_source(steps: DataFrame) -> DataFrame:
    flat = steps.select("source_name", F.explode("history").alias("written"))
    return flat.groupBy("source_name", a.action_type(F.col("written")).alias("action_type")).agg(
        F.count(F.lit(1)).alias("count")
    )


def top_actions_by_source(counts: DataFrame, k: int = 10) -> DataFrame:
    return first_examples(counts, ["source_name"], [F.col("count").desc(), F.col("action_type")], k)


def keyword_actions(steps: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` distinct actions that mention each keyword, by name."""
    written = steps.select(F.explode(all_actions(steps)).alias("written")).distinct()
    words = F.array(*[F.lit(w) for w in a.ACTION_KEYWORDS])
    hits = written.select("written", F.explode(words).alias("keyword")).where(
        F.lower("written").contains(F.col("keyword"))
    )
    return first_examples(hits, ["keyword"], [F.col("written")], k)


def message_positions(steps: DataFrame, name: str = "send_msg_to_user") -> DataFrame:
    """Every mention of ``name`` in a history with its 1-based position and place; last wins over first."""
    flat = steps.select("source_name", F.size("history").alias("length"), F.posexplode("history").alias("_at", "written"))
    place = F.when(F.col("_at") == F.col("length") - 1, "last").when(F.col("_at") == 0, "first").otherwise("middle")
    hits = flat.where(a.contains_action(F.col("written"), name))
    return hits.select("source_name", (F.col("_at") + 1).alias("position"), place.alias("place"))


def message_position_totals(hits: DataFrame) -> DataFrame:
    """Mentions per place with their percentage."""
    counts = hits.groupBy("place").agg(F.count(F.lit(1)).alias("count"))
    everything = Window.partitionBy()
    return counts.withColumn("percent", F.col("count") / F.sum("count").over(everything) * 100)


def message_position_histogram(hits: DataFrame) -> DataFrame:
    return hits.groupBy("source_name", "position").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("place") == "last").alias("last"),
        F.count_if(F.col("place") != "last").alias("not_last"),
    )


def discoveries(actions: DataFrame, order: list[str]) -> DataFrame:
    """Quoted user messages with their running number in the task, from 0."""
    told = actions.withColumn("message", a.discovery_message(F.col("raw"))).where("message IS NOT NULL")
    return numbered(told, ["task_id"], order, "_n").withColumn("number", F.col("_n") - 1).drop("_n")


def recent_entries(steps: DataFrame, keys: list[str], order: list[str], k: int, text: Column) -> DataFrame:
    """The last ``k`` formatted entries before each step, joined by line feeds."""
    rows = steps.withColumn("_entry", text)
    out = framed(
        rows, keys, order, {"_recent": lambda w: F.collect_list("_entry").over(w.rowsBetween(-k, -1))}, before=k
    )
    joined = F.when(F.size("_recent") > 0, F.array_join("_recent", "\n")).otherwise("(empty)")
    return out.withColumn("recent", joined).drop("_entry", "_recent")


def checklist_timeline(steps: DataFrame, keys: list[str], order: list[str], items: str) -> DataFrame:
    """``change``: how many checklist items each step added to the step before it; 0 for the first step."""
    out = framed(steps, keys, order, {"_prev": lambda w: F.lag(items).over(w)}, before=1)
    return out.withColumn("change", F.coalesce(F.col(items) - F.col("_prev"), F.lit(0))).drop("_prev")
