"""Queries: readers and sinks, written to a shared scratch folder and read back."""

from pyspark.sql import functions as F

from trailmark.catalog import views as v
from trailmark.catalog.registry import query
from trailmark.catalog.scoring import scores
from trailmark.operators import bucketing as b
from trailmark.operators import chats as c
from trailmark.operators import episodes as e
from trailmark.operators import scoring as s
from trailmark.operators import tasks as k
from trailmark.plans import numbered
from trailmark.sources import readers as r
from trailmark.sources import sinks as w


@query("read_runs", "A2", """SELECT 'agent-' || (event_id % 3) AS agent, event_type AS task, '' || user_id AS "index", 'completed' AS status, 2 AS messages FROM events WHERE event_id % 10 NOT IN (0, 1)""")
def read_runs(t):
    folder = w.scratch_folder(t.spark, "runs")
    line = F.expr("""CASE event_id % 10 WHEN 0 THEN '{"index": ' || user_id || ', "output": {' WHEN 1 THEN '{"output": {"status": "completed"}}'
      ELSE '{"index": ' || user_id || ', "error": null, "info": null, "output": {"index": ' || user_id || ', "status": "completed", "result": {"main": 1}, "history": [{"role": "user", "content": "a"}, {"role": "agent", "content": "b"}]}, "time": {"timestamp": 1, "str": "x"}}' END""")
    rows = t.events.select(F.expr("'agent-' || (event_id % 3)").alias("agent"), F.col("event_type").alias("task"), line.alias("value"))
    rows.write.partitionBy("agent", "task").text(folder)
    read = r.read_runs(t.spark, folder, "*.txt")
    tail = F.regexp_replace("agent", "^agent=", "")
    return read.select(tail.alias("agent"), F.regexp_replace("task", "^task=", "").alias("task"), "index", F.col("output.status").alias("status"), F.size("output.history").alias("messages"))


@query("read_steps", "A1", """SELECT '' || conv_id AS task_id, '' || turn AS step_id, text AS action, 1 AS rejected FROM conversations""")
def read_steps(t):
    folder = w.scratch_folder(t.spark, "steps") + "/steps.parquet"
    t.conversations.selectExpr(
        "'' || conv_id AS task_id", "turn AS step_id", "named_struct('thought', role, 'action', text) AS chosen",
        "array(named_struct('thought', role, 'action', 'go_back()')) AS rejected",
    ).write.parquet(folder)
    steps = r.read_steps(t.spark, folder)
    return steps.select("task_id", "step_id", F.col("chosen.action").alias("action"), F.size("rejected").alias("rejected"))


@query("read_task_config", "A6", """SELECT doc_id AS task_id, len(['a', lang]) AS n_include, source AS exact, source || ',' || lang AS sites FROM documents""")
def read_task_config(t):
    # Files of up to a hundred configurations, one list a file.
    folder = w.scratch_folder(t.spark, "configs")
    config = F.to_json(F.struct(
        F.col("doc_id").alias("task_id"), F.array("source", "lang").alias("sites"),
        F.struct(F.struct(F.array(F.lit("a"), F.col("lang")).alias("must_include"), F.col("source").alias("exact_match")).alias("reference_answers")).alias("eval"),
    ))
    lists = t.documents.select(F.expr("doc_id DIV 100").alias("file"), config.alias("c")).groupBy("file").agg(F.array_join(F.collect_list("c"), ",").alias("c"))
    lists.select(F.concat(F.lit("["), "c", F.lit("]")).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    refs = F.col("eval.reference_answers")
    return r.read_task_config(t.spark, folder).select(
        F.col("task_id").cast("long").alias("task_id"), F.size(refs["must_include"]).alias("n_include"),
        F.get(refs["exact_match"], F.lit(0)).alias("exact"), F.array_join("sites", ",").alias("sites"),
    )


@query("complete_episodes", "A11", """SELECT 'ep' || doc_id AS episode_id, CAST(n_chars AS INT) AS length FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 5 <> 0""")
def complete_episodes(t):
    names = F.explode(F.array(*[F.lit(n) for n in r.EPISODE_FILES]))
    files = t.documents.select(F.expr("'ep' || doc_id").alias("episode_id"), names.alias("name"), "doc_id", "n_chars")
    held = files.where("NOT (doc_id % 4 = 0 AND name = 'actions.pkl') AND NOT (doc_id % 5 = 0 AND name = 'len.txt')")
    return r.complete_episodes(held.withColumn("text", F.when(F.col("name") == "len.txt", F.expr("n_chars || ' '"))))


@query("read_boxes", "A12", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS top, l_quantity + 5 AS bottom, 'say, ' || l_returnflag || chr(10) || 'x' AS text, l_linestatus = 'F' AS interactable FROM lineitem")
def read_boxes(t):
    folder = w.scratch_folder(t.spark, "boxes")
    t.lineitem.selectExpr(
        "l_linenumber AS ID", "'' || l_orderkey AS Element", "l_quantity AS Top", "1.0D AS Right", "l_quantity + 5 AS Bottom", "0.0D AS Left", "1.0D AS Width", "5.0D AS Height",
        "'' || l_partkey AS Alt", "'c' AS Class", "'i' AS Id_attr", "'say, ' || l_returnflag || chr(10) || 'x' AS TextContent", "l_linestatus = 'F' AS Interactable",
    ).write.option("header", True).option("quoteAll", True).csv(folder)
    rows = r.read_boxes(t.spark, folder)
    return rows.select(F.col("Element").cast("long").alias("l_orderkey"), F.col("ID").alias("l_linenumber"), F.col("Alt").cast("long").alias("l_partkey"), F.col("Top").alias("top"), F.col("Bottom").alias("bottom"), F.col("TextContent").alias("text"), F.col("Interactable").alias("interactable"))


@query("read_input_events", "A10", f"WITH {v.KEYED_EVENTS} SELECT '' || event_type AS episode, count(*) AS events, CAST(sum(k) AS BIGINT) AS dx FROM keyed GROUP BY 1")
def read_input_events(t):
    folder = w.scratch_folder(t.spark, "events")
    line = F.expr("'{\"keyboard\": {\"keys\": []}, \"mouse\": {\"dx\": ' || k || ', \"buttons\": [0]}, \"hotbar\": 1, \"isGuiOpen\": false}'")
    v.keyed_events(t).select(F.col("event_type").alias("episode"), line.alias("value")).write.partitionBy("episode").text(folder)
    rows = r.read_input_events(t.spark, folder, by_folder=True).withColumn("episode", F.regexp_replace("episode_id", "^episode=", ""))
    return rows.groupBy("episode").agg(F.count(F.lit(1)).alias("events"), F.sum("mouse.dx").cast("long").alias("dx"))


@query("parse_run_log_files", "A5", """SELECT CAST(l_orderkey AS INT) AS task_id, l_returnflag <> 'R' AS success FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_returnflag DESC) = 1""")
def parse_run_log_files(t):
    # Logs of many orders: a line that names the order, then one result per line item.
    folder = w.scratch_folder(t.spark, "logs")
    named = t.lineitem.select("l_orderkey").distinct().selectExpr(
        "l_orderkey", "-1 AS l_linenumber", "'' AS l_returnflag", "'[Config file]: config_files/' || l_orderkey || '.json' AS value")
    told = t.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "l_returnflag", "'[Result] (' || CASE l_returnflag WHEN 'R' THEN 'FAIL' ELSE 'PASS' END || ') line ' || l_linenumber AS value")
    lines = named.union(told).repartitionByRange("l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber", "l_returnflag")
    lines.select("value").write.text(folder)
    return r.parse_run_log(t.spark, folder).select("task_id", "success")


@query("write_csv_report", "A14", f"WITH {v.DOMAIN_STEPS} SELECT website_name, count(*) AS count FROM domain_steps GROUP BY 1")
def write_csv_report(t):
    folder = w.scratch_folder(t.spark, "report")
    w.write_csv_report(b.domain_summary(v.domain_steps(t)), folder, ["website_name"])
    return t.spark.read.schema("website_name STRING, count BIGINT").csv(folder, header=True)


@query("write_bucket_shards", "A15", f"WITH {v.BUCKETS} SELECT page_id, replace(bucket, '|', '__') AS shard FROM buckets")
def write_bucket_shards(t):
    folder = w.scratch_folder(t.spark, "shards")
    w.write_bucket_shards(b.assign_buckets(v.domain_steps(t)), folder)
    return t.spark.read.schema("page_id BIGINT, shard STRING").json(folder)


@query("write_trace_jsonl", "A17", f"WITH {v.TURNS} SELECT conv_id AS trace_id, count(*) AS lines, CAST(max(length(content)) AS BIGINT) AS longest FROM turns WHERE role = 'agent' GROUP BY 1")
def write_trace_jsonl(t):
    folder = w.scratch_folder(t.spark, "traces")
    w.write_trace_jsonl(c.trace_rows(c.trajectory_states(v.turns(t))), folder, by_task=True)
    rows = t.spark.read.schema("trace_id BIGINT, response STRING").json(folder)
    return rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("lines"), F.max(F.length("response")).cast("long").alias("longest"))


@query("write_manifest_files", "A18", "SELECT CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE 'matched' END AS status, count(*) AS ids FROM (SELECT DISTINCT doc_id * 3 AS id FROM labels) w LEFT JOIN documents d ON d.doc_id = w.id GROUP BY 1")
def write_manifest_files(t):
    folder = w.scratch_folder(t.spark, "manifest")
    wanted = t.labels.select((F.col("doc_id") * 3).alias("doc_id"))
    manifest = k.subset_manifest(*k.subset_by_ids(wanted, t.documents.select("doc_id"), "doc_id"), "doc_id")
    w.write_manifest(manifest, k.manifest_counts(manifest), folder)
    return t.spark.read.schema("doc_id BIGINT, status STRING").json(f"{folder}/ids").groupBy("status").agg(F.count(F.lit(1)).alias("ids"))


@query("split_rows_to_files", "A19", "SELECT row_number() OVER (ORDER BY item_id) AS idx, item_id, text FROM benchmark")
def split_rows_to_files(t):
    folder = w.scratch_folder(t.spark, "configs")
    w.split_rows_to_files(numbered(t.benchmark, [], ["item_id"], "idx"), folder, "idx")
    return t.spark.read.schema("item_id BIGINT, text STRING, idx BIGINT").json(folder)


@query("write_score_vector", "A20", "WITH b AS (SELECT o_custkey AS task_id, max(CASE o_orderstatus WHEN 'O' THEN 0.0 WHEN 'F' THEN 1.0 ELSE 0.5 END) AS score FROM orders GROUP BY 1) SELECT CASE WHEN score >= 1 THEN '1.0' ELSE '0.0' END AS line, count(*) AS n FROM customer LEFT JOIN b ON task_id = c_custkey GROUP BY 1")
def write_score_vector(t):
    folder = w.scratch_folder(t.spark, "scores")
    w.write_score_vector(s.export_score_vector(scores(t), t.customer.selectExpr("c_custkey AS task_id"), show_all=True), folder)
    return t.spark.read.text(folder).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("write_id_list", "A22", """WITH o AS (SELECT doc_id, n_chars, (doc_id * 7919) % 100003 AS z FROM documents), q AS (SELECT doc_id, sum(n_chars) OVER (ORDER BY z, doc_id ROWS UNBOUNDED PRECEDING) - n_chars AS before FROM o) SELECT '' || doc_id AS id FROM q WHERE before < 200000""")
def write_id_list(t):
    folder = w.scratch_folder(t.spark, "ids")
    rows = t.documents.selectExpr("doc_id AS episode_id", "n_chars AS length", "(doc_id * 7919) % 100003 AS shuffle")
    w.write_id_list(e.split_by_frames(rows, 200000, 50000, "shuffle"), folder, "docs")
    return r.read_id_list(t.spark, f"{folder}/docs_train")
