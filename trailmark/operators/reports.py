"""Run reports: latest result per pair, main metrics, pivots and validation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.messages import normalise_status, validation_label

# Family, name patterns (as a regular expression), metric path, divisor and report order.
FAMILIES = (
    ("dcg", "card|^cg|^dcg", "$.score", 1.0, 4),
    ("hh", "^alf", "$.overall.success_rate", 1.0, 6),
    ("os", "^os|^operating", "$.overall.acc", 1.0, 1),
    ("db", "^db|^database", "$.overall_cat_accuracy", 1.0, 2),
    ("kg", "^kg|^knowledge", "$.main", 1.0, 3),
    ("ltp", "^ltp|^literal", "$.main", 1.0, 5),
    ("wb", "^m2w|^mind2web", "$.step_sr", 100.0, 8),
    ("ws", "^ws|^webshop", "$.reward", 1.0, 7),
    ("embodied", "minecraft|omnigibson", "$.success_rate", 1.0, 9),
    ("visual", "css|^web", "$.main", 1.0, 10),
)


def task_family(task: Column) -> Column:
    """Family of a task name; null when no pattern fits."""
    out = F.lit(None).cast("string")
    for name, pattern, *_ in reversed(FAMILIES):
        out = F.when(F.lower(task).rlike(pattern), name).otherwise(out)
    return out


def task_priority(task: Column) -> Column:
    family, out = task_family(task), F.lit(100000)
    for name, _, _, _, order in FAMILIES:
        out = F.when(family == name, order).otherwise(out)
    return out


def main_metric(task: Column, custom: Column) -> Column:
    """Main metric of a task's custom result, given as JSON text."""
    family, out = task_family(task), F.lit(None).cast("double")
    for name, _, path, divisor, _ in FAMILIES:
        value = F.get_json_object(custom, path).try_cast("double") / divisor
        if name == "dcg":
            value = F.coalesce(value, F.get_json_object(custom, "$.win_rate").try_cast("double"))
        out = F.when(family == name, value).otherwise(out)
    return out


def latest_run(overall: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Newest file per aliased agent and task; of equally new ones the last path counts."""
    agent = F.col("agent")
    if aliases:
        agent = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[F.col("agent")]
    named = overall.withColumn("agent", agent).where(F.col("agent").isNotNull())
    newest = named.groupBy("agent", "task").agg(
        F.max_by(F.struct(*overall.columns), F.struct("mtime", "path")).alias("_r")
    )
    return newest.select("_r.*")


def available_agents(configured: DataFrame, known: DataFrame) -> DataFrame:
    return configured.select("agent").intersect(known.select("agent"))


def validation_fractions(runs: DataFrame, by: list[str]) -> DataFrame:
    """Share of every status and the history lengths, one row per group."""
    n = F.count(F.lit(1))
    status = normalise_status(F.col("status"))
    shares = [
        F.try_divide(F.count_if(status == name), n).alias(name.replace(" ", "_"))
        for name in (
            "running", "completed", "agent context limit", "agent validation failed", "agent invalid action",
            "task limit reached", "unknown", "task error",
        )
    ]
    return runs.groupBy(*by).agg(
        n.alias("total"), *shares, F.avg("history_length").alias("average_history_length"),
        F.max("history_length").alias("max_history_length"), F.min("history_length").alias("min_history_length"),
    )


LABELS = ("Completed", "Context Limit Exceeded", "Invalid Format", "Invalid Action", "Task Limit Exceeded")


def label_shares(runs: DataFrame) -> DataFrame:
    """Share of each report label, in the order of ``LABELS``, per agent and task that has a run with a label."""
    labelled = runs.select("agent", "task", validation_label(F.col("status")).alias("_label"))
    total = F.count(F.lit(1))
    shares = F.array(*[F.count_if(F.col("_label") == label) / total for label in LABELS])
    return labelled.groupBy("agent", "task").agg(shares.alias("shares"), F.count("_label").alias("_n")).where("_n > 0").drop("_n")


def validation_shares(runs: DataFrame) -> DataFrame:
    """Long form: share of each report label that occurs, per agent and task."""
    names = F.array(*map(F.lit, LABELS))
    flat = label_shares(runs).select("agent", "task", F.explode(F.arrays_zip(names.alias("validation"), F.col("shares").alias("share"))).alias("_s"))
    return flat.select("agent", "task", "_s.validation", "_s.share").where(F.col("share") > 0)


def validation_means(shares: DataFrame, by: str, digits: int = 6) -> DataFrame:
    """Mean share of each label per agent or per task of ``label_shares``.

    A label that never occurs for a pair counts with share 0, as every report lists all labels.
    """
    means = F.array(*[F.round(F.avg(F.col("shares")[i]), digits) for i in range(len(LABELS))])
    wide = shares.groupBy(by).agg(means.alias("_means"))
    names = F.array(*map(F.lit, LABELS))
    flat = wide.select(by, F.explode(F.arrays_zip(names.alias("validation"), F.col("_means").alias("mean"))).alias("_s"))
    return flat.select(by, "_s.validation", F.coalesce(F.col("_s.mean").cast("string"), F.lit("--")).alias("mean_share"))


def metric_pivot(metrics: DataFrame, tasks: list[str]) -> DataFrame:
    """Agent by task table of the main metric, blank where missing; columns in the given order."""
    wide = metrics.groupBy("agent").pivot("task", tasks).agg(F.first("metric", ignorenulls=True).cast("string"))
    return wide.select("agent", *[F.coalesce(F.col(f"`{t}`"), F.lit("")).alias(t) for t in tasks])


def result_details(latest: DataFrame) -> DataFrame:
    """One JSON object per pair with the summary metric and the details, ready to be written as lines."""
    metric = main_metric(F.col("task"), F.col("custom"))
    return latest.select(
        "agent", "task", metric.alias("summary"),
        F.struct("path", F.date_format("mtime", "yyyy-MM-dd HH:mm:ss").alias("time"), "custom").alias("details"),
    )
