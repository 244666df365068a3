"""Early stop of runs, batch by batch; the state is two small tables, and no step of it runs in Python.

Every rule but the typing rule looks at the last few steps, so a task's past is summed up by its last
``max(parse, repeat) - 1`` steps and by how often each typing action was seen. A batch is joined to that state and
goes through the batch operator, whose plan splits tasks with very many steps. Tasks that stopped leave the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators.chats import first_stops
from trailmark.plans.sequences import numbered
from trailmark.sources.sinks import scratch_folder

STEPS = "task_id BIGINT, step_no BIGINT, action_type STRING, key STRING"
TYPED = "task_id BIGINT, key STRING, seen BIGINT"
STOPS = "task_id BIGINT, step_no BIGINT, reason STRING"


class StopLedger:
    """Stops of a stream of steps. Each batch writes its own version of the state, so a batch may run again."""

    def __init__(self, spark: SparkSession, folder: str, max_steps: int, parse: int, repeat: int) -> None:
        self.spark, self.folder = spark, folder
        self.max_steps, self.parse, self.repeat = max_steps, parse, repeat

    def _read(self, name: str, number: int, schema: str) -> DataFrame:
        if number < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/b={number}")

    def _write(self, rows: DataFrame, name: str, number: int, schema: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/b={number}")
        return self._read(name, number, schema)

    def stops(self, before: int) -> DataFrame:
        """Stops of the batches up to a number."""
        paths = [f"{self.folder}/stops/b={n}" for n in range(before + 1)]
        return self.spark.read.schema(STOPS).parquet(*paths) if paths else self.spark.createDataFrame([], STOPS)

    def add(self, batch: DataFrame, number: int) -> None:
        """Settle one batch: its stops, then the state behind it."""
        near = max(self.parse, self.repeat) - 1
        order = ["step_no"]
        fresh = batch.select("task_id", "step_no", "action_type", "key").join(self.stops(number - 1), "task_id", "left_anti")
        past = self._read("near", number - 1, STEPS).withColumn("_old", F.lit(True))
        rows = self._write(
            past.unionByName(fresh.withColumn("_old", F.lit(False))), "rows", number, f"{STEPS}, _old BOOLEAN"
        )
        typed = self._read("typed", number - 1, TYPED)
        found = first_stops(rows, typed, order, self.max_steps, self.parse, self.repeat)
        found = self._write(found, "stops", number, STOPS)
        going = rows.join(found, "task_id", "left_anti")
        last = numbered(going, ["task_id"], ["-step_no"], "_back").where(F.col("_back") <= near)
        self._write(last.select("task_id", "step_no", "action_type", "key"), "near", number, STEPS)
        counts = going.where("NOT _old AND action_type = 'TYPE' AND key IS NOT NULL").groupBy("task_id", "key").agg(F.count(F.lit(1)).alias("seen"))
        all_typed = typed.join(found, "task_id", "left_anti").unionByName(counts)
        self._write(all_typed.groupBy("task_id", "key").agg(F.sum("seen").alias("seen")), "typed", number, TYPED)


def stream_stops(actions: DataFrame, max_steps: int = 30, parse: int = 3, repeat: int = 5) -> DataFrame:
    """First stop of every task over a stream of (task_id, step_no, action_type, key), run over all there is.

    Steps of a task must arrive in order between batches; inside a batch any order will do.
    """
    spark = actions.sparkSession
    folder = scratch_folder(spark, "early-stops")
    ledger, done = StopLedger(spark, folder, max_steps, parse, repeat), [-1]

    def settle(batch: DataFrame, number: int) -> None:
        ledger.add(batch, number)
        done[0] = number

    query = (
        actions.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(settle).start()
    )
    query.awaitTermination()
    return ledger.stops(done[0])
