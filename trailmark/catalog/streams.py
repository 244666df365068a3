"""Queries: streams run over everything there is."""

from pyspark.sql import functions as F

from trailmark.catalog import views as v
from trailmark.catalog.registry import query
from trailmark.catalog.chats import STOP_SQL, keyed_actions
from trailmark.streaming import ledgers as lg
from trailmark.streaming.stopping import stream_stops

ORDERS = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
NORMAL = "replace(lower(status), '_', ' ')"


class Live:
    """The same tables as streams, so that the batch views apply to them."""

    def __init__(self, t) -> None:
        self.spark = t.spark
        self.orders = lg.open_files(t.spark, t.folder, ORDERS, "orders.parquet")
        self.events = lg.open_files(t.spark, t.folder, EVENTS, "events.parquet")


def live_runs(t):
    return v.runs(Live(t)).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_run_ledger", "S1", f"WITH {v.RUNS} SELECT agent, task, {NORMAL} AS status, count(*) AS records FROM runs GROUP BY 1, 2, 3")
def stream_run_ledger(t):
    out = lg.run_available(lg.ledger_counts(live_runs(t)), "update", "ledger")
    return lg.collected(t.spark, out, "agent STRING, task STRING, status STRING, records BIGINT", ["agent", "task", "status"])


MEMORY_DAYS = 30


def arriving_runs(t):
    """Runs in the order in which they came: by date, some days late."""
    at = F.col("ts").cast("timestamp")
    came = at.cast("long") + (F.col("o_orderkey") % 5) * 86400
    return lg.arrive(v.runs(t).select(*lg.SAMPLE, at.alias("ts"), came.alias("came")), F.col("came"), 4, "ledger", "ts")


@query("stream_dedup_runs", "S5", f"""WITH {v.RUNS}, g AS (SELECT agent, task, sample, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY agent, task, sample ORDER BY ts) <= INTERVAL {MEMORY_DAYS} DAYS THEN 0 ELSE 1 END AS fresh FROM runs),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY agent, task, sample ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT agent, task, sample, strftime(min(ts), '%Y-%m-%d') AS first_day, count(*) - 1 AS repeats FROM s GROUP BY agent, task, sample, n""")
def stream_dedup_runs(t):
    came = arriving_runs(t)
    live = lg.first_samples(came.stream(), f"{MEMORY_DAYS} days", came.delay)
    shown = [*lg.SAMPLE, F.col("start").alias("ts"), (F.col("n") - 1).alias("repeats")]
    return lg.all_sessions(live, "samples", lg.SAMPLE, shown).select(*lg.SAMPLE, F.date_format("ts", "yyyy-MM-dd").alias("first_day"), "repeats")


@query("stream_completion", "S2", f"WITH {v.RUNS}, f AS (SELECT agent, task, count(DISTINCT sample) AS finished FROM runs GROUP BY 1, 2), e AS (SELECT agent, task, count(DISTINCT sample) - (CASE agent WHEN 'agent-1' THEN -1 ELSE 0 END) AS expected FROM runs GROUP BY 1, 2) SELECT agent, task, finished, expected FROM f JOIN e USING (agent, task) WHERE finished >= expected")
def stream_completion(t):
    samples = v.runs(t).select(*lg.SAMPLE).distinct()
    extra = samples.where("agent = 'agent-1'").select("agent", "task").distinct().withColumn("sample", F.lit("never run"))
    return lg.stream_completion(arriving_runs(t).stream(), samples.unionByName(extra), "completion")


@query("stream_early_stop", "S3", STOP_SQL)
def stream_early_stop(t):
    steps = lg.arrive(keyed_actions(t), F.col("step_no"), 3, "actions")
    return stream_stops(steps.stream(), max_steps=60, parse=3, repeat=3)


SESSIONS = """g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 240 SECONDS THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)"""


def stamped(sessions):
    return sessions.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("start", "end")], "updates")


@query("idle_sessions", "S4", f"""WITH {SESSIONS}
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 240 SECONDS, '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS updates FROM s GROUP BY user_id, n""")
def idle_sessions(t):
    out = lg.idle_sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "240 seconds")
    return stamped(out)


def arriving_events(t):
    rows = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return lg.arrive(rows, F.col("ts"), 4, "events", "ts")


@query("stream_idle_sessions", "S4", f"""WITH {SESSIONS}
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 240 SECONDS, '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS updates FROM s GROUP BY user_id, n""")
def stream_idle_sessions(t):
    came = arriving_events(t)
    live = lg.idle_sessions(came.stream(), "240 seconds", came.delay)
    return stamped(lg.all_sessions(live, "sessions", ["user_id"], ["user_id", "start", "end", F.col("n").alias("updates")]))


def silences_sql(seconds, event):
    return f"""SELECT user_id AS worker_id, strftime(max(ts) + INTERVAL {seconds} SECONDS, '%Y-%m-%d %H:%M:%S.%f') AS "at", count(*) AS visits, '{event}' AS event
 FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT user_id, ts,
  CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL {seconds} SECONDS THEN 0 ELSE 1 END AS fresh FROM visits)) GROUP BY user_id, n"""


@query("stream_silent_workers", "S4", f"""WITH visits AS (SELECT event_id % 3 AS user_id, to_timestamp(floor(epoch(ts) / 90)) AS ts FROM events)
{silences_sql(11, "marked")} UNION ALL {silences_sql(35, "removed")}""")
def stream_silent_workers(t):
    # Events as visits of three workers, on a clock that runs 90 times as fast.
    rows = t.events.selectExpr("event_id % 3 AS worker_id", "timestamp_seconds(unix_timestamp(cast(ts as timestamp)) DIV 90) AS ts")
    came = lg.arrive(rows, F.col("ts"), 3, "visits", "ts")
    shown = ["worker_id", F.col("start").alias("first_visit"), F.col("end").alias("at"), F.col("n").alias("visits")]
    made = [
        lg.all_sessions(lg.worker_silences(came.stream(), seconds, came.delay), "silences", ["worker_id"], shown)
        for seconds in (lg.MARK_AFTER, lg.REMOVE_AFTER)
    ]
    return lg.silent_workers(*made).select("worker_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "visits", "event")
