"""Readers: files of the stored layouts as DataFrames with fixed schemas."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark import schemas
from trailmark.operators.bucketing import load_group_map
from trailmark.plans import Scan, attach, running
from trailmark.plans.lineage import store

_PAIR_LIST = f"array<{schemas.THOUGHT_ACTION}>"


def _pairs(value: Column) -> Column:
    """A thought/action pair or a list of them, given as JSON text, as a list."""
    text = F.trim(value)
    as_list = F.from_json(text, _PAIR_LIST)
    as_one = F.array(F.from_json(text, schemas.THOUGHT_ACTION))
    empty = F.expr(f"cast(array() as {_PAIR_LIST})")
    return F.coalesce(
        F.when(text.startswith("["), as_list).when(text.startswith("{"), as_one), empty
    )


def normalise_pair_shapes(raw: DataFrame) -> DataFrame:
    """``chosen`` and ``rejected`` given as JSON text of either shape: a struct and an array of structs."""
    return raw.withColumn("chosen", F.get(_pairs(F.col("chosen")), F.lit(0))).withColumn(
        "rejected", _pairs(F.col("rejected"))
    )


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """Steps from a Parquet folder or from JSON arrays."""
    if path.rstrip("/").endswith(".parquet"):
        return _steps_from_columns(spark.read.parquet(path))
    loose = T._parse_datatype_string(schemas.STEPS)
    for name in ("chosen", "rejected"):
        loose[name].dataType = T.StringType()
    return normalise_pair_shapes(spark.read.schema(loose).json(path, multiLine=True))


def _steps_from_columns(stored: DataFrame) -> DataFrame:
    for name in ("chosen", "rejected"):
        if name in stored.columns:
            stored = stored.withColumn(name, F.to_json(F.col(name)))
    return normalise_pair_shapes(stored).withColumn("step_id", F.col("step_id").cast("string"))


def _path_part(from_end: int) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)" + r"/[^/]+" * from_end + r"$", 1)


def read_runs(spark: SparkSession, root: str, name: str = "runs.jsonl") -> DataFrame:
    """Run records of ``{agent}/{task}/runs.jsonl``; malformed and index-less lines are skipped."""
    schema = schemas.RUN_BODY + ", _broken STRING"
    lines = (
        spark.read.schema(schema)
        .option("columnNameOfCorruptRecord", "_broken")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .json(root)
    )
    records = lines.select("*", _path_part(2).alias("agent"), _path_part(1).alias("task"))
    return valid_run_records(records)


def valid_run_records(records: DataFrame) -> DataFrame:
    """Parsed lines that hold an index and an output."""
    kept = records.where(F.col("_broken").isNull() & F.col("index").isNotNull() & F.col("output").isNotNull())
    return kept.drop("_broken")


def read_overall(spark: SparkSession, root: str, since: datetime | None = None, name: str = "overall.json") -> DataFrame:
    """``overall.json`` files at any depth that are not older than ``since``."""
    reader = (
        spark.read.schema(schemas.OVERALL_BODY)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
    )
    if since is not None:
        reader = reader.option("modifiedAfter", since.strftime("%Y-%m-%dT%H:%M:%S"))
    return reader.json(root, multiLine=True).select(
        _path_part(2).alias("agent"), _path_part(1).alias("task"),
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"),
        "total", "validation", "custom",
    )


def task_scores_from_json(lines: DataFrame, text: str = "value") -> DataFrame:
    """One score record per JSON text: other shapes and open runs (score below 0) are dropped."""
    parsed = F.from_json(F.col(text), schemas.TASK_SCORES_BODY)
    is_object = F.trim(F.col(text)).startswith("{") & parsed.isNotNull()
    rest = [c for c in lines.columns if c != text]
    return (
        lines.where(is_object)
        .select(*rest, parsed.alias("_r"))
        .select(
            *rest,
            F.coalesce(F.col("_r.task_id"), F.lit(1000)).alias("task_id"),
            F.coalesce(F.col("_r.score"), F.lit(0.0)).alias("score"),
            F.col("_r.actions").alias("actions"),
        )
        .where(F.col("score") >= 0)
    )


def read_task_scores(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``actions/{id}.json`` of several run folders."""
    paths = [f"{folder.rstrip('/')}/actions" for folder in folders]
    texts = spark.read.option("pathGlobFilter", "*.json").text(paths, wholetext=True)
    return task_scores_from_json(texts.select("value", _path_part(2).alias("run_dir")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files that may be cut over many tasks: (file, block, line, value).

    ``block`` is the byte at which the line's split begins and ``line`` grows within a split, so the two order the lines
    of a file; no file is held in one row.
    """
    texts = spark.read.option("lineSep", "\n").text(path)
    return texts.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value",
    )


def placed_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Some of the lines of ``read_lines`` with ``row``, which grows by one from line to line of a block; and their blocks.

    A block (file, block, first, n) has ``n`` rows from ``first`` on, so what goes from line to line over a whole file
    is worked out over the few blocks. The rows are stored once: a second read could cut the files elsewhere.
    """
    rows = store(lines.withColumn("row", F.monotonically_increasing_id()), "lines")
    return rows, store(rows.groupBy("file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")), "blocks")


def _told(text: Column) -> tuple[Column, Column, Column]:
    """Of a line of a run log: whether it names a task, the number in that name, and the verdict of a result."""
    config = text.contains("[Config file]")
    file_id = F.regexp_extract(F.rtrim(text), r"(?:^|[/\s])([^./\s]+)[^/\s]*$", 1).try_cast("int")
    return config, file_id, F.when(text.contains("(FAIL)"), False).when(text.contains("(PASS)"), True)


def run_log_results(lines: DataFrame, key: str, order: list[str], text: str = "value") -> DataFrame:
    """Last result per task id of each log: ``[Config file]`` sets the id of the results after it.

    ``lines`` has a row per line; the id is carried over however many tasks a log is cut into.  A result of neither
    kind gives a null ``success``; results under a name that is no number are left out.
    """
    config, file_id, verdict = _told(F.col(text))
    told = lines.where(config | F.col(text).contains("[Result]"))
    # A struct, so that a name that is no number ends the id before it.
    told = told.select(key, *order, F.when(config, F.struct(file_id.alias("task_id"))).alias("_config"), verdict.alias("success"))
    seen = running(told, [key], order, {"_task": Scan("last", F.col("_config"))})
    results = seen.where(F.col("_config").isNull() & F.col("_task.task_id").isNotNull())
    return results.groupBy(key, F.col("_task.task_id").alias("task_id")).agg(F.max_by("success", F.struct(*order)).alias("success"))


def parse_run_log(spark: SparkSession, path: str) -> DataFrame:
    """``run_log_results`` of each file of logs.

    The id is carried inside each block, and over the blocks of a file from the last one that each names. Rows hold
    numbers only: ``first`` for their block and ``log``, the smallest one, for their file.
    """
    lines = read_lines(spark, path)
    config, file_id, verdict = _told(F.col("value"))
    told = lines.where(config | F.col("value").contains("[Result]"))
    # A name that is no number ends the id before it.
    told = told.select("file", "block", config.alias("names"), F.when(config, file_id).alias("id"), verdict.alias("success"))
    rows, blocks = placed_lines(told)
    lasts = rows.where("names").groupBy("file", "block").agg(F.max("row").alias("row"))
    ends = attach(lasts, rows.where("names").select("row", F.struct("id").alias("end")), ["row"], "inner")
    blocks = attach(blocks, ends.drop("row"), ["file", "block"])
    blocks = running(blocks, ["file"], ["block"], {
        "before": Scan("sum", F.col("n"), exclusive=True), "carried": Scan("last", F.col("end"), exclusive=True)})
    blocks = store(attach(blocks, blocks.groupBy("file").agg(F.min("first").alias("log")), ["file"]), "blocks")
    placed = attach(rows, blocks.select("file", "block", "first"), ["file", "block"], "inner")
    so_far = Window.partitionBy("first").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    named = F.last(F.when(F.col("names"), F.struct("id")), ignorenulls=True).over(so_far)
    seen = placed.select("first", "row", "names", "success", named.alias("named")).where("NOT names")
    seen = attach(seen, blocks.select("first", "log", "before", "carried"), ["first"], "inner")
    line = F.coalesce("before", F.lit(0)) + F.col("row") - F.col("first")
    results = seen.select("log", F.coalesce("named", "carried")["id"].alias("task_id"), line.alias("line"), "success")
    results = results.where("task_id IS NOT NULL").groupBy("log", "task_id").agg(F.max_by("success", "line").alias("success"))
    return attach(results, blocks.select("log", "file").distinct(), ["log"], "inner").select("file", "task_id", "success")


def read_task_config(spark: SparkSession, path: str) -> DataFrame:
    """Task configurations; reference answers become a map of lists whatever shape they have in the file."""
    raw = spark.read.schema(schemas.TASK_CONFIG).json(path, multiLine=True)
    return raw.withColumn("eval", F.col("eval").withField(
        "reference_answers", reference_answers(F.col("eval.reference_answers"))))


def reference_answers(text: Column) -> Column:
    """JSON object of strings and lists as ``map<string,array<string>>``."""
    loose = F.from_json(text, "map<string,string>")
    return F.transform_values(
        loose,
        lambda _, value: F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(value)),
    )


def read_group_map(spark: SparkSession, path: str | None, steps: DataFrame) -> DataFrame:
    """Domain groups from a CSV lookup, else from the steps."""
    if path is None:
        lookup = spark.createDataFrame([], schemas.GROUP_MAP_FILE)
    else:
        lookup = spark.read.schema(schemas.GROUP_MAP_FILE).csv(path, header=True)
    return load_group_map(lookup, steps)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """One row per message of conversations stored one per line."""
    return conversation_turns(spark.read.schema(schemas.CONVERSATIONS_FILE).json(path))


def conversation_turns(records: DataFrame) -> DataFrame:
    """Messages in file order; list content given as JSON text becomes an array of parts."""
    flat = records.select("input", "output", F.posexplode("history").alias("turn", "_m"))
    return flat.select(
        F.col("input").alias("conv_id"), "turn", F.col("_m.role").alias("role"), "output",
        message_parts(F.col("_m.content")).alias("content"),
    )


def message_parts(content: Column) -> Column:
    """A plain string as one text part, a JSON list as its parts."""
    plain = F.struct(F.lit("text").alias("type"), content.alias("text"), F.lit(None).cast("string").alias("image_url"))
    parts = F.from_json(content, f"array<{schemas.CONTENT_PART}>")
    return F.when(content.rlike(r"^\s*\[\s*\{"), F.coalesce(parts, F.array(plain))).otherwise(F.array(plain))


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """One recipe per JSON file; the file name is the item."""
    raw = spark.read.schema(schemas.RECIPES_BODY).json(path, multiLine=True)
    named = raw.withColumn("item", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
    return recipe_results(named)


def recipe_results(raw: DataFrame) -> DataFrame:
    """Result item and count from both spellings: an object, or the bare item name."""
    as_object = F.from_json(F.col("result"), "item STRING, count INT")
    is_object = F.trim(F.col("result")).startswith("{")
    return raw.withColumn(
        "result_item", F.when(is_object, as_object["item"]).otherwise(F.col("result"))
    ).withColumn("result_count", F.coalesce(F.when(is_object, as_object["count"]), F.lit(1)))


def episode_urls(index: DataFrame) -> DataFrame:
    """Video and event URLs of an index of base folder and relative paths."""
    base = F.regexp_replace(F.col("basedir"), r".\z", "")
    flat = index.select("basedir", F.posexplode("relpaths").alias("idx", "_p"))
    stem = F.concat(base, F.lit("/"), F.replace(F.col("_p"), F.lit(".mp4"), F.lit("")))
    return flat.select(
        "idx", F.concat(stem, F.lit(".mp4")).alias("video_url"), F.concat(stem, F.lit(".jsonl")).alias("action_url")
    )


def read_input_events(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """Recorder events, one JSON object per line, numbered by line from 0; blank lines do not count.

    An episode is a file, or with ``by_folder`` all files of a folder in the order of their names.
    """
    name = r"([^/]*)/[^/]*$" if by_folder else r"([^/]*)\.jsonl$"
    rows, blocks = placed_lines(read_lines(spark, path).where(F.trim("value") != "").select("file", "block", "value"))
    blocks = blocks.withColumn("episode_id", F.regexp_extract("file", name, 1))
    blocks = running(blocks, ["episode_id"], ["file", "block"], {"before": Scan("sum", F.col("n"), exclusive=True)})
    shift = (F.coalesce("before", F.lit(0)) - F.col("first")).alias("shift")
    events = attach(rows, blocks.select("file", "block", "episode_id", shift), ["file", "block"], "inner")
    return events.select("episode_id", (F.col("row") + F.col("shift")).alias("t"), F.from_json("value", schemas.INPUT_EVENTS_BODY).alias("_e")).select(
        "episode_id", "t", "_e.*"
    )


EPISODE_FILES = ("frames", "metadata.json", "actions.pkl", "embeds_attn.pkl", "len.txt")


def complete_episodes(files: DataFrame, required: tuple[str, ...] = EPISODE_FILES) -> DataFrame:
    """Episodes of a (episode_id, name, text) file listing that hold every required file."""
    held = [F.max((F.col("name") == name).cast("int")) for name in required]
    complete = held[0]
    for flag in held[1:]:
        complete = complete + flag
    length = F.max(F.when(F.col("name") == "len.txt", F.trim(F.col("text")).try_cast("int")))
    grouped = files.groupBy("episode_id").agg(complete.alias("_held"), length.alias("length"))
    return grouped.where(F.col("_held") == len(required)).drop("_held")


def scan_episodes(spark: SparkSession, root: str) -> DataFrame:
    """Complete episode folders below ``root`` with their stored length.

    The listing reads no contents; only the ``len.txt`` files are opened, in a read of their own.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    relative = F.regexp_extract(F.col("path"), r"/([^/]+/(?:frames/)?[^/]+)$", 1)
    where = [F.substring_index(relative, "/", 1).alias("episode_id"), F.element_at(F.split(relative, "/"), 2).alias("name")]
    names = listing.load(root).select(*where, F.lit(None).cast("string").alias("text"))
    lengths = listing.option("pathGlobFilter", "len.txt").load(root).select(*where, F.col("content").cast("string").alias("text"))
    return complete_episodes(names.union(lengths))


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Element boxes from quoted CSV with line breaks inside cells."""
    return spark.read.schema(schemas.BOXES_FILE).csv(path, header=True, quote='"', multiLine=True, enforceSchema=True)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.OBSERVATIONS).json(path, multiLine=True)
    return without_tabs(raw)


def without_tabs(observations: DataFrame) -> DataFrame:
    return observations.withColumn("text_observation", F.replace(F.col("text_observation"), F.lit("\t"), F.lit("")))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Stripped non-empty lines of a list file."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where(F.col("id") != "")


def register_views(frames: dict[str, DataFrame]) -> None:
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


