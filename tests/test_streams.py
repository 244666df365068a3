"""Streams over several files and batches give what the batch twin gives."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import FOLDER
from trailmark.catalog import registry
from trailmark.catalog.chats import keyed_actions
from trailmark.operators.chats import stop_reasons
from trailmark.streaming import ledgers as lg
from trailmark.streaming.stopping import stream_stops


@pytest.fixture(scope="module")
def tables(spark):
    return registry.Tables(spark, FOLDER)


def in_files(df, path, order, n=3):
    """Rows in ``n`` files that the stream reads one by one, in order."""
    rows = df.orderBy(order).toPandas()
    size = -(-len(rows) // n)
    for i in range(n):
        df.sparkSession.createDataFrame(rows.iloc[i * size:(i + 1) * size], df.schema).coalesce(1).write.parquet(f"{path}/b{i}")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    reader = df.sparkSession.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1)
    return reader.parquet(str(path))


def as_set(df, *names):
    return {tuple(r) for r in df.select(*names).collect()}


def test_ledger(spark, tables, tmp_path):
    runs = tables.orders.selectExpr("'a' || (o_custkey % 3) AS agent", "o_orderpriority AS task", "CASE WHEN o_orderkey % 2 = 0 THEN 'COMPLETED' ELSE 'unknown' END AS status", "o_orderkey")
    live = in_files(runs, tmp_path, "o_orderkey")
    out = lg.run_available(lg.ledger_counts(live), "update", "t1")
    got = lg.collected(spark, out, "agent STRING, task STRING, status STRING, records BIGINT", ["agent", "task", "status"])
    names = ("agent", "task", "status", "records")
    assert as_set(got, *names) == as_set(lg.ledger_counts(runs), *names)


def sampled(tables):
    return tables.orders.selectExpr("'a' AS agent", "o_orderpriority AS task", "'' || (o_custkey % 40) AS sample", "cast(o_orderdate as timestamp) AS ts")


def shown():
    return [*lg.SAMPLE, F.col("start").alias("ts"), (F.col("n") - 1).alias("repeats")]


def test_first_samples_are_those_of_the_table(spark, tables):
    runs = sampled(tables)
    came = lg.arrive(runs, F.col("ts").cast("long") + F.hash("sample") % 500_000, 4, "t2", "ts")
    assert came.lateness > 0 and came.files_a_slice == 1
    got = lg.all_sessions(lg.first_samples(came.stream(), "20 days", came.delay), "t2", lg.SAMPLE, shown())
    names = [*lg.SAMPLE, "ts", "repeats"]
    want = lg.first_samples(runs, "20 days")
    assert sorted(got.select(*names).collect()) == sorted(want.select(*names).collect())
    assert want.agg(F.sum("repeats") + F.count("*")).first()[0] == runs.count()


def test_old_samples_leave_the_state_and_late_ones_are_counted(spark, tmp_path):
    day = lambda n: f"timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, {n})"
    slices = [(1, ["x", "y"]), (20, ["x"]), (21, ["x"]), (3, ["y"]), (40, ["z"]), (41, ["x"])]
    for number, (at, names) in enumerate(slices):
        rows = spark.createDataFrame([(n,) for n in names], "sample string")
        rows.selectExpr("'a' AS agent", "'t' AS task", "sample", f"{day(at)} AS ts").coalesce(1).write.parquet(f"{tmp_path}/in/s={number}")
    reader = spark.readStream.schema("agent STRING, task STRING, sample STRING, ts TIMESTAMP").option("recursiveFileLookup", True)
    live = reader.option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = (
        lg.first_samples(live, "5 days", "1 day").writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state")
        .trigger(availableNow=True).foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/b={number}")).start()
    )
    query.awaitTermination()
    state = [p["stateOperators"][0] for p in query.recentProgress]
    # Day 3 comes when the watermark is past its session's end; of x, y, x, z, x two sessions are open at the end, z and the last x.
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 1
    assert state[-1]["numRowsTotal"] == 2 and max(s["numRowsTotal"] for s in state) <= 3
    closed = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out")
    assert sorted(r.sample for r in closed.collect()) == ["x", "x", "y"]


def test_completion(spark, tmp_path):
    expected = spark.createDataFrame([("a", "t", s) for s in "123"] + [("a", "u", s) for s in "12"] + [("b", "t", "1")], lg.REMAINING)
    ledger = lg.CompletionLedger(expected, str(tmp_path))
    batches = [[("a", "t", "1"), ("a", "t", "1"), ("a", "t", "9")], [("a", "t", "2"), ("b", "t", "1")], [("a", "t", "1"), ("a", "u", "1")], [("a", "t", "3"), ("b", "t", "1")]]
    for number, rows in enumerate(batches):
        ledger.add(spark.createDataFrame(rows, lg.REMAINING), number)
        ledger.add(spark.createDataFrame(rows, lg.REMAINING), number)
    assert as_set(ledger.complete(), "agent", "task", "expected") == {("b", "t", 1), ("a", "t", 3)}
    assert ledger.remaining(3).count() == 1


def test_completion_counts_the_finished_samples(spark, tmp_path):
    expected = spark.createDataFrame([("a", "t", "1"), ("a", "t", "2"), ("b", "t", "1"), ("c", "t", "1")], lg.REMAINING)
    ledger = lg.CompletionLedger(expected, str(tmp_path))
    for number, rows in enumerate([[("a", "t", "1"), ("a", "t", "9"), ("b", "t", "1")], [("a", "t", "9"), ("a", "t", "2")], [("a", "t", "8"), ("c", "t", "7")]]):
        ledger.add(spark.createDataFrame(rows, lg.REMAINING), number)
        ledger.add(spark.createDataFrame(rows, lg.REMAINING), number)
    assert as_set(ledger.complete(), "agent", "task", "finished", "expected") == {("a", "t", 4, 2), ("b", "t", 1, 1)}


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_stops(spark, tables, batches):
    actions = keyed_actions(tables)
    steps = lg.arrive(actions, F.col("step_no"), batches, "t3")
    got = stream_stops(steps.stream(), max_steps=20, parse=2, repeat=2)
    want = stop_reasons(actions, ["step_no"], max_steps=20, parse=2, repeat=2)
    assert as_set(got, "task_id", "step_no", "reason") == as_set(want, "task_id", "step_no", "reason")


def test_stops_of_one_task_with_a_third_of_the_rows(spark, split_mode):
    rows = [(0, i, "CLICK" if i % 3 else "TYPE", f"k{i % 3}" if i % 3 else f"t{i}") for i in range(400)]
    rows += [(0, 400 + i, "CLICK", "same") for i in range(6)] + [(0, 500, "CLICK", "x")]
    rows += [(1 + i % 40, i // 40, "TYPE" if i % 2 else None, f"w{i % 5}") for i in range(800)]
    actions = spark.createDataFrame(rows, "task_id long, step_no long, action_type string, key string")
    for batches in (1, 4):
        steps = lg.arrive(actions, F.col("step_no"), batches, "t5")
        got = as_set(stream_stops(steps.stream(), max_steps=10_000, parse=3, repeat=5), "task_id", "step_no", "reason")
        assert got == as_set(stop_reasons(actions, ["step_no"], max_steps=10_000, parse=3, repeat=5), "task_id", "step_no", "reason")
        assert (0, 404, "same_action") in got


def test_sessions_are_those_of_the_table(spark, tables):
    events = tables.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    came = lg.arrive(events, F.col("ts"), 3, "t4", "ts")
    live = lg.idle_sessions(came.stream(), "6 hours", came.delay)
    names = ("user_id", "start", "end", "updates")
    got = lg.all_sessions(live, "t4", ["user_id"], ["user_id", "start", "end", F.col("n").alias("updates")])
    assert as_set(got, *names) == as_set(lg.idle_sessions(events, "6 hours"), *names)
    assert got.count() == len(as_set(got, *names))


def test_silent_workers(spark):
    visits = spark.createDataFrame([("w", s) for s in (0, 5, 16, 28, 70)] + [("v", 10)], "worker_id string, s int")
    visits = visits.select("worker_id", F.timestamp_seconds("s").alias("ts"))
    made = [lg.worker_silences(visits, s) for s in (lg.MARK_AFTER, lg.REMOVE_AFTER)]
    got = lg.silent_workers(*made).select("worker_id", F.unix_timestamp("at"), "event")
    assert {tuple(r) for r in got.collect()} == {
        ("w", 27, "marked"), ("w", 39, "marked"), ("w", 81, "marked"), ("v", 21, "marked"),
        ("w", 63, "removed"), ("w", 105, "removed"), ("v", 45, "removed"),
    }
