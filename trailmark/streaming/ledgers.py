"""Streams over run ledgers: counts, completion, repeats, idle sessions, silent workers.

Sessions, repeats and silences are session windows: state lives as long as a session is open and leaves it when the
watermark has passed the session's end. A run over all there is ends with open sessions; ``all_sessions`` reads them
from the state, so that its result is whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.functions.messages import normalise_status
from trailmark.plans.lineage import store
from trailmark.sources.sinks import scratch_folder

SAMPLE = ["agent", "task", "sample"]


def open_files(spark: SparkSession, folder: str, schema: str, glob: str, form: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """Stream of the files in a folder whose names fit ``glob``."""
    reader = spark.readStream.format(form).schema(schema).option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(folder)


#: Rows of a file that arrives.
FILE_ROWS = 1_000_000


@dataclass(frozen=True)
class Arrivals:
    """Rows in files that arrived one slice after the other, and how many seconds late the latest row was."""

    spark: SparkSession
    folder: str
    schema: str
    files_a_slice: int
    lateness: float

    @property
    def delay(self) -> str:
        """A watermark delay that drops no row."""
        return f"{int(self.lateness) + 1} seconds"

    def stream(self) -> DataFrame:
        """The slices in the order of their arrival, one a batch."""
        reader = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", True)
        return reader.option("maxFilesPerTrigger", self.files_a_slice).parquet(self.folder)


def arrive(rows: DataFrame, by: Column, slices: int, name: str, time: str | None = None) -> Arrivals:
    """Write rows as a source would deliver them: in slices of about equal size by the number ``by``, one after the other.

    All slices have the same number of files, so that a batch of the stream is a slice. ``lateness`` is measured over
    column ``time``. A window over one row per file finds it.
    """
    spark, folder = rows.sparkSession, scratch_folder(rows.sparkSession, name)
    placed = store(rows.withColumn("_by", by.cast("double")), name)
    cuts = placed.approxQuantile("_by", [i / slices for i in range(1, slices)], 0.01) if slices > 1 else []
    slot = F.lit(0)
    for value in cuts:
        slot = slot + F.when(F.col("_by") > value, 1).otherwise(0)
    placed, files = placed.withColumn("_slot", slot), placed.count() // slices // FILE_ROWS + 1
    for number in range(slices):
        placed.where(F.col("_slot") == number).drop("_by", "_slot").repartition(files).write.parquet(f"{folder}/s={number}")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    stored = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)
    return Arrivals(spark, folder, schema, files, _lateness(stored, time) if time else 0.0)


def _lateness(stored: DataFrame, time: str) -> float:
    """Seconds by which a row lies behind the newest row of a file that came before its own or with it, at most."""
    at = F.col(time).cast("double")
    files = stored.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("came"))
    files = files.agg(F.min(at).alias("low"), F.max(at).alias("high"))
    newest = F.max("high").over(Window.orderBy("came").rangeBetween(Window.unboundedPreceding, 0))
    return files.select((newest - F.col("low")).alias("late")).agg(F.max("late")).first()[0] or 0.0


def ledger_counts(runs: DataFrame) -> DataFrame:
    """Records per agent, task and status; partial counts are combined before the shuffle."""
    return runs.groupBy("agent", "task", normalise_status(F.col("status")).alias("status")).agg(
        F.count(F.lit(1)).alias("records")
    )


def first_samples(runs: DataFrame, memory: str, delay: str | None = None) -> DataFrame:
    """First record of every sample with the records that repeat it; works on a stream and on a table.

    A repeat is a record that comes at most ``memory`` behind another of its sample. On a stream a sample leaves the
    state when the watermark is ``memory`` past its last record, and a record that comes more than ``delay`` behind
    the newest one of the batches before is dropped and counted (``numRowsDroppedByWatermark``).
    """
    rows = runs if delay is None else runs.withWatermark("ts", delay)
    window = F.session_window("ts", memory)
    return rows.groupBy(*SAMPLE, window).agg(F.count(F.lit(1)).alias("records")).select(
        *SAMPLE, F.col("session_window.start").alias("ts"), (F.col("records") - 1).alias("repeats")
    )


def idle_sessions(events: DataFrame, gap: str, delay: str | None = None) -> DataFrame:
    """Sessions per user that end when nothing came for more than ``gap``; works on a stream and on a table."""
    rows = events if delay is None else events.withWatermark("ts", delay)
    window = F.session_window("ts", gap)
    return rows.groupBy("user_id", window).agg(F.count(F.lit(1)).alias("updates")).select(
        "user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "updates"
    )


# Seconds of silence after which a worker is marked and after which it is removed.
MARK_AFTER, REMOVE_AFTER = 11, 35


def worker_silences(visits: DataFrame, seconds: int, delay: str | None = None) -> DataFrame:
    """When each worker (worker_id, ts) was silent for longer than so: ``at`` is the end of the allowed time, and its visits since the silence before."""
    rows = visits if delay is None else visits.withWatermark("ts", delay)
    window = F.session_window("ts", f"{seconds} seconds")
    return rows.groupBy("worker_id", window).agg(F.count(F.lit(1)).alias("visits")).select(
        "worker_id", F.col("session_window.start").alias("first_visit"), F.col("session_window.end").alias("at"), "visits"
    )


def silent_workers(marks: DataFrame, removals: DataFrame) -> DataFrame:
    """Marks and removals of workers as one table of events."""
    return marks.withColumn("event", F.lit("marked")).unionByName(removals.withColumn("event", F.lit("removed")))


def run_available(stream: DataFrame, mode: str, name: str) -> str:
    """Run a stream over everything there is into a folder of Parquet files, with the batch number kept."""
    spark = stream.sparkSession
    out = scratch_folder(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        # Each batch owns its folder, so a batch that is run again replaces its own rows only.
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/b={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()
    return f"{out}/rows"


def collected(spark: SparkSession, folder: str, schema: str, keys: list[str] | None = None) -> DataFrame:
    """Rows of all batches; with ``keys``, the newest row of every key (for update and complete modes)."""
    rows = spark.read.schema(f"{schema}, _batch INT").option("recursiveFileLookup", True).parquet(folder)
    if keys is None:
        return rows.drop("_batch")
    rest = [c for c in rows.columns if c not in [*keys, "_batch"]]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")


def all_sessions(sessions: DataFrame, name: str, keys: list[str], shown: list[Column]) -> DataFrame:
    """Run a stream of counted session windows to its end: closed sessions, and those that its state still holds open.

    ``shown`` makes the columns of ``sessions`` from ``keys``, ``start``, ``end`` and ``n``, its count.
    """
    spark = sessions.sparkSession
    rows = run_available(sessions, "append", name)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sessions.schema.fields)
    state = spark.read.format("statestore").load(f"{rows.rsplit('/', 1)[0]}/state")
    held = state.select("value.*")
    # The state's row has the keys, the window and the count, in this order.
    window, count = held.columns[len(keys)], held.columns[len(keys) + 1]
    held = held.select(*keys, F.col(f"{window}.start").alias("start"), F.col(f"{window}.end").alias("end"), F.col(count).alias("n"))
    return collected(spark, rows, schema).unionByName(held.select(*shown))


REMAINING = "agent STRING, task STRING, sample STRING"
COMPLETE = "agent STRING, task STRING, expected BIGINT"


class CompletionLedger:
    """Which pairs of agent and task have a record for every expected sample.

    The state is the table of samples without a record: it shrinks with every batch, a record that comes again finds
    nothing to remove, and a pair is complete when its last sample goes. Each batch writes its own version, and its own
    samples, expected or not, for the number of finished ones.
    """

    def __init__(self, expected: DataFrame, folder: str) -> None:
        self.spark, self.folder = expected.sparkSession, folder
        expected.select(*SAMPLE).distinct().write.parquet(f"{folder}/remaining/b=-1")
        self.expected = self.remaining(-1).groupBy("agent", "task").agg(F.count(F.lit(1)).alias("expected"))

    def remaining(self, number: int) -> DataFrame:
        return self.spark.read.schema(REMAINING).parquet(f"{self.folder}/remaining/b={number}")

    def add(self, batch: DataFrame, number: int) -> None:
        """Settle one batch of runs."""
        before, came = self.remaining(number - 1), f"{self.folder}/came/b={number}"
        batch.select(*SAMPLE).distinct().write.mode("overwrite").parquet(came)
        left = before.join(self.spark.read.schema(REMAINING).parquet(came), SAMPLE, "left_anti")
        left.write.mode("overwrite").parquet(f"{self.folder}/remaining/b={number}")
        pairs = before.select("agent", "task").distinct().join(self.remaining(number), ["agent", "task"], "left_anti")
        done = pairs.join(self.expected, ["agent", "task"])
        done.write.mode("overwrite").parquet(f"{self.folder}/complete/b={number}")

    def complete(self) -> DataFrame:
        """Pairs that are complete so far, each as it was told once, with their ``finished`` samples so far."""
        done = self.spark.read.schema(COMPLETE).option("recursiveFileLookup", True).parquet(f"{self.folder}/complete")
        came = self.spark.read.schema(REMAINING).option("recursiveFileLookup", True).parquet(f"{self.folder}/came")
        finished = came.groupBy("agent", "task").agg(F.count_distinct("sample").alias("finished"))
        return done.join(finished, ["agent", "task"]).select("agent", "task", "finished", "expected")


def stream_completion(runs: DataFrame, expected: DataFrame, name: str) -> DataFrame:
    """Run a stream of runs over all there is; pairs whose every expected (agent, task, sample) has a record, with their samples that have one."""
    folder = scratch_folder(runs.sparkSession, name)
    ledger = CompletionLedger(expected, folder)
    query = runs.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(ledger.add).start()
    query.awaitTermination()
    return ledger.complete()
