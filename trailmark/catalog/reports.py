"""Queries: run reports."""

from pyspark.sql import functions as F

from trailmark.catalog import views as v
from trailmark.catalog.registry import query
from trailmark.operators import reports as r
from trailmark.sources.readers import read_overall as read_overall_reports
from trailmark.sources.sinks import scratch_folder, write_result_json

CUSTOM = """CASE task WHEN 'os-std' THEN '{"overall": {"acc": ' || (o_orderkey % 100) || '}}' WHEN 'dbbench-std' THEN '{"overall_cat_accuracy": ' || (o_orderkey % 90) || '}'
 WHEN 'm2w-std' THEN '{"step_sr": ' || (o_orderkey % 80) || '}' WHEN 'card-game' THEN CASE o_orderkey % 2 WHEN 0 THEN '{"score": ' || (o_orderkey % 70) || '}' ELSE '{"win_rate": ' || (o_orderkey % 60) || '}' END
 ELSE '{"reward": ' || (o_orderkey % 50) || '}' END"""
METRIC = """CASE task WHEN 'os-std' THEN (o_orderkey % 100)::DOUBLE WHEN 'dbbench-std' THEN (o_orderkey % 90)::DOUBLE WHEN 'm2w-std' THEN (o_orderkey % 80)::DOUBLE / 100
 WHEN 'card-game' THEN CASE o_orderkey % 2 WHEN 0 THEN (o_orderkey % 70)::DOUBLE ELSE (o_orderkey % 60)::DOUBLE END ELSE (o_orderkey % 50)::DOUBLE END"""
LATEST = f"{v.RUNS}, latest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY agent, task ORDER BY ts DESC, lpad('' || o_orderkey, 12, '0') DESC) = 1)"


def overall(t):
    return v.runs(t).select(
        "agent", "task", F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("path"), F.col("ts").alias("mtime"),
        F.expr(CUSTOM).alias("custom"), "o_orderkey",
    )


@query("latest_run", "E4 A3", f"WITH {LATEST} SELECT agent, task, o_orderkey, ts AS mtime FROM latest")
def latest_run(t):
    return r.latest_run(overall(t)).select("agent", "task", "o_orderkey", "mtime")


@query("read_overall", "A3", f"WITH {v.RUNS} SELECT agent, task, count(*) AS files, max(ts) AS newest FROM runs WHERE ts >= TIMESTAMP '1998-01-01' GROUP BY 1, 2")
def read_overall(t):
    recent = overall(t).where(F.col("mtime") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return recent.groupBy("agent", "task").agg(F.count(F.lit(1)).alias("files"), F.max("mtime").alias("newest"))


@query("read_overall_files", "A3", f"WITH {LATEST} SELECT agent, task, o_orderkey AS total, {METRIC} AS metric FROM latest")
def read_overall_files(t):
    # One report per agent and task, written as a file of its own.
    folder = scratch_folder(t.spark, "overall")
    report = F.concat(F.lit('{"total": '), F.col("o_orderkey").cast("string"), F.lit(', "validation": {"COMPLETED": 0.5}, "custom": '), "custom", F.lit("}"))
    r.latest_run(overall(t)).select("agent", "task", report.alias("value")).write.partitionBy("agent", "task").text(folder)
    read = read_overall_reports(t.spark, folder, name="*.txt")
    read = read.select(F.regexp_replace("agent", "^agent=", "").alias("agent"), F.regexp_replace("task", "^task=", "").alias("task"), "total", "custom")
    return read.select("agent", "task", "total", r.main_metric(F.col("task"), F.col("custom")).alias("metric"))


@query("main_metric", "D24", f"WITH {v.RUNS} SELECT o_orderkey, {METRIC} AS metric, CASE task WHEN 'os-std' THEN 1 WHEN 'dbbench-std' THEN 2 WHEN 'm2w-std' THEN 8 WHEN 'card-game' THEN 4 ELSE 7 END AS priority FROM runs")
def main_metric(t):
    return overall(t).select("o_orderkey", r.main_metric(F.col("task"), F.col("custom")).alias("metric"), r.task_priority(F.col("task")).alias("priority"))


TASKS = ["os-std", "dbbench-std", "card-game", "webshop-std", "m2w-std"]


@query("metric_pivot", "D23", f"""WITH {LATEST}, m AS (SELECT agent, task, {METRIC} AS metric FROM latest WHERE NOT (agent = 'agent-1' AND task = 'os-std'))
SELECT agent, """ + ", ".join(f"""coalesce(CAST(max(metric) FILTER (task = '{x}') AS VARCHAR), '') AS "{x}" """ for x in TASKS) + " FROM m GROUP BY agent")
def metric_pivot(t):
    latest = r.latest_run(overall(t)).where("NOT (agent = 'agent-1' AND task = 'os-std')")
    metrics = latest.select("agent", "task", r.main_metric(F.col("task"), F.col("custom")).alias("metric"))
    return r.metric_pivot(metrics, TASKS)


@query("result_details", "A16", f"WITH {LATEST} SELECT agent, task, {METRIC} AS summary, lpad('' || o_orderkey, 12, '0') AS path, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time FROM latest")
def result_details(t):
    details, folder = r.result_details(r.latest_run(overall(t))), scratch_folder(t.spark, "details")
    write_result_json(details, folder)
    return t.spark.read.schema(details.schema).json(folder).select("agent", "task", "summary", "details.path", "details.time")


SHARES = f"""{v.RUNS}, n AS (SELECT agent, task, replace(lower(status), '_', ' ') AS status FROM runs),
l AS (SELECT agent, task, CASE status WHEN 'completed' THEN 'Completed' WHEN 'agent context limit' THEN 'Context Limit Exceeded' WHEN 'agent validation failed' THEN 'Invalid Format' WHEN 'agent invalid action' THEN 'Invalid Action' ELSE 'Task Limit Exceeded' END AS validation FROM n),
sh AS (SELECT agent, task, validation, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY agent, task) AS share FROM l GROUP BY 1, 2, 3),
labels_ AS (SELECT unnest(['Completed', 'Context Limit Exceeded', 'Invalid Format', 'Invalid Action', 'Task Limit Exceeded']) AS validation)"""


@query("validation_by_agent", "D25", f"WITH {SHARES}, p AS (SELECT agent, count(DISTINCT task) AS pairs FROM sh GROUP BY 1) SELECT p.agent, l2.validation, round(coalesce(sum(share), 0) / any_value(pairs), 4) AS mean_share FROM p CROSS JOIN labels_ l2 LEFT JOIN sh ON sh.agent = p.agent AND sh.validation = l2.validation GROUP BY 1, 2")
def validation_by_agent(t):
    return r.validation_means(r.label_shares(v.runs(t)), "agent").withColumn("mean_share", F.round(F.col("mean_share").cast("double"), 4))


@query("validation_by_task", "D25", f"WITH {SHARES}, p AS (SELECT task, count(DISTINCT agent) AS pairs FROM sh GROUP BY 1) SELECT p.task, l2.validation, round(coalesce(sum(share), 0) / any_value(pairs), 4) AS mean_share FROM p CROSS JOIN labels_ l2 LEFT JOIN sh ON sh.task = p.task AND sh.validation = l2.validation GROUP BY 1, 2")
def validation_by_task(t):
    return r.validation_means(r.label_shares(v.runs(t)), "task").withColumn("mean_share", F.round(F.col("mean_share").cast("double"), 4))


@query("validation_shares", "D25", f"WITH {SHARES} SELECT agent, task, validation, round(share, 6) AS share FROM sh")
def validation_shares(t):
    return r.validation_shares(v.runs(t)).withColumn("share", F.round("share", 6))


@query("validation_fractions", "D12", """WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), s AS (SELECT conv_id % 4 AS task, CASE conv_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'unknown' ELSE 'task error' END AS status, n FROM c)
SELECT task, count(*) AS total, count(*) FILTER (status = 'completed')::DOUBLE / count(*) AS completed, count(*) FILTER (status = 'unknown')::DOUBLE / count(*) AS unknown, count(*) FILTER (status = 'task error')::DOUBLE / count(*) AS task_error,
 round(avg(n), 6) AS average_history_length, max(n) AS max_history_length, min(n) AS min_history_length FROM s GROUP BY task""")
def validation_fractions(t):
    lengths = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("history_length"))
    runs = lengths.selectExpr("conv_id % 4 AS task", "CASE conv_id % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'unknown' ELSE 'TASK_ERROR' END AS status", "history_length")
    out = r.validation_fractions(runs, ["task"])
    return out.select("task", "total", "completed", "unknown", "task_error", F.round("average_history_length", 6).alias("average_history_length"), "max_history_length", "min_history_length")


@query("available_agents", "F8", "SELECT n_nationkey AS agent FROM nation INTERSECT SELECT s_nationkey FROM supplier")
def available_agents(t):
    return r.available_agents(t.nation.selectExpr("n_nationkey AS agent"), t.supplier.selectExpr("s_nationkey AS agent"))
