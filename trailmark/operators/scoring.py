"""Scores of finished runs rolled up into rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.plans.lookups import attach


def success_rate(results: DataFrame, by: list[str], success: str = "success") -> DataFrame:
    """Total, success, fail and percentage; the rate is null for an empty class."""
    counted = results.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(success).alias("success"))
    rate = F.bround(F.try_divide(F.col("success"), F.col("total")), 4) * 100
    return counted.select(*by, "total", "success", (F.col("total") - F.col("success")).alias("fail"), rate.alias("success_rate"))


def breakdown_by_site(results: DataFrame, configs: DataFrame) -> DataFrame:
    """Rates per site; a task counts once for each of its sites."""
    sites = configs.select("task_id", F.array_distinct("sites").alias("sites"))
    joined = attach(results, sites, ["task_id"], "inner")
    return success_rate(joined.select("success", F.explode("sites").alias("site")), ["site"])


def task_type(eval_types: Column) -> Column:
    return (
        F.when(eval_types == F.array(F.lit("string_match")), "info_seeking")
        .when(eval_types == F.array(F.lit("url_match")), "site_nav")
        .otherwise("content_config")
    )


def breakdown_by_type(results: DataFrame, configs: DataFrame) -> DataFrame:
    kinds = configs.select("task_id", task_type(F.col("eval_types")).alias("task_type"))
    return success_rate(attach(results, kinds, ["task_id"], "inner"), ["task_type"])


def breakdown_achievable(results: DataFrame, configs: DataFrame) -> DataFrame:
    """Rates of achievable tasks and of those whose only right answer is "N/A"."""
    hopeless = (F.col("eval_types") == F.array(F.lit("string_match"))) & F.coalesce(
        F.col("fuzzy_match") == "N/A", F.lit(False)
    )
    flags = configs.where(hopeless).select("task_id", F.lit(False).alias("achievable"))
    marked = attach(results, flags, ["task_id"]).withColumn("achievable", F.coalesce("achievable", F.lit(True)))
    return success_rate(marked, ["achievable"])


def pass_rate(scores: DataFrame, by: list[str], expected: int) -> DataFrame:
    """Passed tasks over the finished ones and over a fixed number of expected ones."""
    counted = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("finished"), F.count_if(F.col("score") >= 1).alias("passed"))
    return counted.select(
        *by, "finished", "passed",
        F.bround(F.try_divide(F.col("passed"), F.col("finished")) * 100, 2).alias("partial_accuracy"),
        F.bround(F.col("passed") / expected * 100, 2).alias("overall_accuracy"),
    )


def best_of_runs(scores: DataFrame) -> DataFrame:
    return scores.groupBy("task_id").agg(F.max("score").alias("score"))


def site_scores(configs: DataFrame, scores: DataFrame) -> DataFrame:
    """Best score of every configured task, 0 for missing ones, keyed by the whole tuple of sites."""
    joined = attach(configs, best_of_runs(scores), ["task_id"])
    return joined.select(
        F.array_join("sites", ",").alias("sites"), "old_task_id", F.coalesce("score", F.lit(0.0)).alias("score")
    )


def site_pass_rate(configs: DataFrame, scores: DataFrame) -> DataFrame:
    rows = site_scores(configs, scores)
    return rows.groupBy("sites").agg(
        F.bround(F.avg("score") * 100, 1).alias("rate"), F.count_if(F.col("score") == 1).alias("solved")
    )


def solved_ids(configs: DataFrame, scores: DataFrame) -> DataFrame:
    """(sites, old id) of every task whose score equals 1."""
    return site_scores(configs, scores).where(F.col("score") == 1).select("sites", "old_task_id")


def export_score_vector(scores: DataFrame, ids: DataFrame, show_all: bool) -> DataFrame:
    """One line per expected id: 1.0, 0.0 or blank; missing ids become 0.0 with ``show_all``."""
    joined = attach(ids, best_of_runs(scores), ["task_id"])
    missing = "0.0" if show_all else ""
    line = F.when(F.col("score").isNull(), missing).when(F.col("score") >= 1, "1.0").otherwise("0.0")
    return joined.select("task_id", line.alias("line"))


def reward_summary(results: DataFrame, relative: bool) -> DataFrame:
    """Success rate and mean reward over all rows; only rows with a success field add to the sums."""
    final = F.col("final_reward")
    if relative:
        final = F.try_divide(final - F.col("initial_reward"), 1.0 - F.col("initial_reward"))
    reward = F.when(F.col("success"), F.lit(1.0)).when(~F.col("success"), F.greatest(F.lit(0.0), final))
    n = F.count(F.lit(1))
    return results.groupBy().agg(
        n.alias("total_count"), F.count_if("success").alias("success_count"),
        F.try_divide(F.count_if("success"), n).alias("success_rate"),
        F.try_divide(F.coalesce(F.sum(reward), F.lit(0.0)), n).alias("average_reward"),
    )


def distance_summary(results: DataFrame, by: list[str], expected: int | None = None) -> DataFrame:
    """Mean distance, share improved by more than 0.05 and share below 0.1, over n or a fixed number."""
    n = F.count(F.lit(1)) if expected is None else F.lit(expected)
    improved = F.count_if(F.col("new_distance") < F.col("distance") - 0.05)
    exact = F.count_if(F.col("new_distance") < 0.1)
    return results.groupBy(*by).agg(
        (F.sum("new_distance") / n).alias("distance"), (improved / n).alias("improve"), (exact / n).alias("em")
    )


def task_aggregates(results: DataFrame, families: dict, family: str) -> DataFrame:
    """The aggregate a task family registers for its results: the one plug-in point of the library.

    ``families`` maps a family name to a function from a grouped frame to a frame of aggregates.
    """
    if family not in families:
        raise ValueError(f"no aggregate registered for {family}")
    return families[family](results.groupBy("agent", "task"))
