"""Split plans give the rows of the plain plans, with one key holding most of the rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.compare import compare
from tests.conftest import FOLDER
from trailmark.plans.sequences import _placed
from trailmark.plans import GroupSizes, Scan, attach, framed, global_rank_by_count, measure, numbered, running

PLAIN = GroupSizes(("k",), None)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(400):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        data.append((key, rng.choice([i, i, i * i]), i, rng.choice([None, rng.randint(-9, 9)])))
    return spark.createDataFrame(data, "k STRING, t BIGINT, id BIGINT, x INT").cache()


def scans():
    x = F.col("x")
    return {
        "s": Scan("sum", x), "c": Scan("count", x), "hi": Scan("max", x, exclusive=True), "lo": Scan("min", x),
        "seen": Scan("last", x), "before": Scan("last", x, exclusive=True),
    }


def as_set(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("order", [["t", "id"], ["-t", "-id"]])
def test_running(rows, split_mode, order):
    assert measure(rows, ["k"]).large is not None
    names = ["k", "id", *scans()]
    plain = running(rows, ["k"], order, scans(), PLAIN)
    assert as_set(running(rows, ["k"], order, scans()), *names) == as_set(plain, *names)


def test_whole_table(rows, split_mode):
    got = numbered(rows, [], ["t", "id"], "n")
    want = rows.select("*", F.row_number().over(Window.orderBy("t", "id")).alias("n"))
    assert as_set(got, "id", "n") == as_set(want, "id", "n")


def test_string_order(rows, split_mode):
    text = rows.withColumn("name", F.concat(F.lit("host"), F.col("id").cast("string")))
    got = numbered(text, ["k"], ["name"], "n")
    want = text.select("*", F.row_number().over(Window.partitionBy("k").orderBy("name")).alias("n"))
    assert as_set(got, "id", "n") == as_set(want, "id", "n")


def test_framed(rows, split_mode):
    cols = {
        "prev": lambda w: F.lag("x", 3).over(w), "next": lambda w: F.lead("id", 2).over(w),
        "near": lambda w: F.array_join(F.collect_list("id").over(w.rowsBetween(-3, 2)), ","),
    }
    got = framed(rows, ["k"], ["t", "id"], cols, before=3, after=2)
    want = framed(rows, ["k"], ["t", "id"], cols, before=3, after=2, sizes=PLAIN)
    assert as_set(got, "id", *cols) == as_set(want, "id", *cols)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_attach(rows, split_mode, how):
    table = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 'b'")
    assert as_set(attach(rows, table, ["k"], how), "id", "n") == as_set(rows.join(table, "k", how), "id", "n")


def test_rank_by_count(rows, split_mode):
    counts = rows.where("x IS NOT NULL").groupBy(F.col("t").cast("string").alias("name")).agg(F.count("*").alias("n"))
    want = counts.select("*", (F.row_number().over(Window.orderBy(F.desc("n"), "name")) - 1).alias("rank0"))
    got = global_rank_by_count(counts, "name", "n")
    assert as_set(got, "name", "rank0") == as_set(want, "name", "rank0")
    assert {r[0] for r in got.select("total").distinct().collect()} == {counts.count()}


SPLIT_QUERIES = (
    "assign_buckets", "unusual_actions", "has_prev_step", "task_context", "discoveries", "drop_repeated_actions",
    "keep_recent_messages", "keep_head_tail", "stitch_conversations", "stop_reasons", "next_goal", "sliding_clips",
    "split_by_frames", "mixture", "milestone_reward", "stalled", "score_answers", "upsert_tasks",
)


@pytest.mark.parametrize("name", SPLIT_QUERIES)
def test_query_in_split_mode(spark, con, split_mode, name):
    ok, note = compare(spark, con, FOLDER, name)
    assert ok, note


def test_ranges_stay_small(spark, split_mode):
    """Null keys, equal leading values and long common prefixes are cut into ranges of about equal size."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(4000).select(
        F.lit(None).cast("string").alias("k"), F.lit(7).alias("t"), F.concat(F.lit("0000000000/https://"), F.format_string("%06d", "id")).alias("id")
    )
    try:
        sizes = [r["count"] for r in _placed(rows, ["k"], ["t", "id"]).groupBy("_tm_part").count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 16 and max(sizes) < 2 * 4000 / 16
    got = numbered(rows, ["k"], ["t", "id"], "n").where("n <> cast(substring(id, 20) AS int) + 1")
    assert got.isEmpty()


def test_groups_within_the_bound_are_not_split(spark):
    assert measure(spark.read.parquet(f"{FOLDER}/events.parquet"), ["user_id"]).large is None
