"""Readers and sinks on small files in the stored layouts."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trailmark.operators import bucketing
from trailmark.sources import readers as r
from trailmark.sources import sinks as w


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_steps_of_both_shapes(spark, tmp_path):
    steps = [
        {"task_id": "1", "step_id": "2", "chosen": {"thought": "t", "action": "a"}, "rejected": {"thought": "x", "action": "b"}},
        {"task_id": "1", "step_id": "10", "chosen": [{"thought": "t", "action": "c"}], "rejected": [{"action": "d"}, {"action": "e"}]},
        {"task_id": "2", "step_id": "0", "chosen": {"action": "z"}, "rejected": []},
    ]
    got = r.read_steps(spark, put(tmp_path / "steps.json", json.dumps(steps, indent=1))).orderBy("task_id", "step_id").collect()
    assert [(s.chosen.action, [x.action for x in s.rejected]) for s in got] == [("c", ["d", "e"]), ("a", ["b"]), ("z", [])]


def test_runs_and_overall(spark, tmp_path):
    good = {"index": 3, "output": {"status": "completed", "history": []}, "error": None, "time": {"timestamp": 1, "str": "x"}}
    put(tmp_path / "m1" / "os" / "runs.jsonl", json.dumps(good) + "\n{broken\n" + json.dumps({**good, "index": None}) + "\n")
    put(tmp_path / "m1" / "os" / "overall.json", json.dumps({"total": 2, "validation": {"COMPLETED": 0.5}, "custom": {"score": 1}}, indent=2))
    runs = r.read_runs(spark, str(tmp_path)).collect()
    assert [(x.agent, x.task, x["index"]) for x in runs] == [("m1", "os", "3")]
    overall = r.read_overall(spark, str(tmp_path), datetime(2000, 1, 1)).collect()
    assert [(x.agent, x.task, x.total, json.loads(x.custom)) for x in overall] == [("m1", "os", 2, {"score": 1})]
    assert r.read_overall(spark, str(tmp_path), datetime(2100, 1, 1)).count() == 0


def test_task_scores(spark, tmp_path):
    for name, body in {"1": '{"task_id": 1, "score": 1.0, "actions": ["a"]}', "2": '{"task_id": 2, "score": -0.1}', "3": "[1]", "4": "{}"}.items():
        put(tmp_path / "run1" / "actions" / f"{name}.json", body)
    got = r.read_task_scores(spark, [str(tmp_path / "run1")]).collect()
    assert {(x.run_dir, x.task_id, x.score) for x in got} == {("run1", 1, 1.0), ("run1", 1000, 0.0)}


def test_log_and_config(spark, tmp_path):
    log = put(tmp_path / "run.log", "x [Config file]: cfg/12.json\n[Result] (FAIL) cfg\n[Result] (PASS) cfg\n[Config file]: cfg/7.json\n[Result] (FAIL)\n")
    assert {x.task_id: x.success for x in r.parse_run_log(spark, log).collect()} == {12: True, 7: False}
    config = put(tmp_path / "cfg.json", json.dumps([{"task_id": 5, "sites": ["map"], "eval": {"eval_types": ["string_match"], "reference_answers": {"must_include": ["a", "b"], "fuzzy_match": "N/A"}}}]))
    row = r.read_task_config(spark, config).first()
    assert row.eval.reference_answers == {"must_include": ["a", "b"], "fuzzy_match": ["N/A"]} and row.sites == ["map"]


@pytest.fixture
def small_splits(spark):
    """Files are cut every few hundred bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def logged(n):
    """A log whose ids reach over many lines, with a name that is no number, and its last results."""
    lines, want, now = [], {}, None
    for i in range(n):
        if i % 37 == 0:
            now = None if i % 5 == 4 else i // 74
            lines.append(f"noise [Config file]: cfg/{'odd' if now is None else now}.json")
        says = i % 3
        lines += ["x" * (i % 50), f"[Result] {['(PASS)', '(FAIL)', 'odd'][says]} step {i}"]
        if now is not None:
            want[now] = [True, False, None][says]
    return "\n".join(lines) + "\n", want


@pytest.mark.parametrize("mode", ["whole", "small_splits", "both"])
def test_a_log_cut_over_many_splits(spark, tmp_path, request, mode):
    if mode != "whole":
        request.getfixturevalue("small_splits")
    if mode == "both":
        request.getfixturevalue("split_mode")
    text, want = logged(600)
    for name in ("a.log", "b.log"):
        put(tmp_path / "logs" / name, text)
    if mode != "whole":
        assert r.read_lines(spark, str(tmp_path / "logs")).rdd.getNumPartitions() > 20
    got = r.parse_run_log(spark, str(tmp_path / "logs")).collect()
    assert {x.file.rsplit("/", 1)[1] for x in got} == {"a.log", "b.log"} and len(got) == 2 * len(want)
    assert all(x.success == want[x.task_id] for x in got)


def test_events_cut_over_many_splits(spark, tmp_path, small_splits):
    line = '{"keyboard": {"keys": []}, "mouse": {"dx": %d}, "hotbar": 1, "isGuiOpen": false}'
    put(tmp_path / "one" / "e1.jsonl", "\n\n".join(line % i for i in range(200)) + "\n")
    put(tmp_path / "one" / "e2.jsonl", "\n".join(line % i for i in range(200, 250)))
    rows = r.read_input_events(spark, str(tmp_path / "one")).collect()
    assert sorted((x.episode_id, x.t, x.mouse.dx) for x in rows) == [("e1", i, float(i)) for i in range(200)] + [("e2", i, 200.0 + i) for i in range(50)]
    rows = r.read_input_events(spark, str(tmp_path / "one"), by_folder=True).collect()
    assert sorted((x.episode_id, x.t, x.mouse.dx) for x in rows) == [("one", i, float(i)) for i in range(250)]


def test_numbering_events_moves_no_line(spark, tmp_path, small_splits, split_mode):
    line = '{"keyboard": {"keys": []}, "mouse": {"dx": %d}, "hotbar": 1, "isGuiOpen": false}'
    for part in range(3):
        put(tmp_path / "one" / f"part-{part}.txt", "\n \n".join(line % (100 * part + i) for i in range(100)) + "\n")
    rows = r.read_input_events(spark, str(tmp_path / "one"), by_folder=True)
    assert sorted((x.episode_id, x.t, x.mouse.dx) for x in rows.collect()) == [("one", i, float(i)) for i in range(300)]
    plan = rows.select("t", "hotbar")._jdf.queryExecution().optimizedPlan().toString()
    lines = [x for x in plan.splitlines() if "value#" in x]
    assert lines and not any("Window" in x or "regexp" in x or "Sort" in x for x in lines)


def test_ids_of_a_log_are_carried_over_blocks_without_one(spark, tmp_path, small_splits):
    fails = [f"[Result] (FAIL) {i} " + "x" * 60 for i in range(80)]
    text = "\n".join(["[Result] (PASS) early", "[Config file]: c/7.json", *fails, "[Result] (PASS) last", "[Config file]: c/no.json", *fails, "[Config file]: c/9.json", "[Result] (PASS)"])
    for name in ("a.log", "b.log"):
        put(tmp_path / "logs" / name, text + "\n")
    got = r.parse_run_log(spark, str(tmp_path / "logs"))
    assert sorted((x.file.rsplit("/", 1)[1], x.task_id, x.success) for x in got.collect()) == [(f, i, True) for f in ("a.log", "b.log") for i in (7, 9)]
    # Results are combined by hash, not sorted, and their groups are numbers.
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_group_map(spark, tmp_path):
    steps = spark.createDataFrame([("1", "1", "a"), ("1", "2", "b"), ("2", "1", "b")], "task_id STRING, step_id STRING, website_name STRING")
    path = put(tmp_path / "g.csv", "website_name,count,group\na,1,\nb,2,G1_High\n,3,G1_High\n")
    assert {(x.website_name, x.group) for x in r.read_group_map(spark, path, steps).collect()} == {("a", "G3_Low"), ("b", "G1_High")}
    empty = put(tmp_path / "e.csv", "website_name,count,group\n")
    want = {("b", "G1_High"), ("a", "G2_Mid")}
    assert {(x.website_name, x.group) for x in r.read_group_map(spark, empty, steps).collect()} == want
    assert {(x.website_name, x.group) for x in r.read_group_map(spark, None, steps).collect()} == want


def test_conversations_with_parts(spark, tmp_path):
    line = {"input": "d1", "output": "o", "history": [{"role": "user", "content": "hi"}, {"role": "user", "content": [{"type": "image_url", "image_url": "f.png"}, {"type": "text", "text": "x"}]}]}
    got = r.read_conversations(spark, put(tmp_path / "c.jsonl", json.dumps(line))).orderBy("turn").collect()
    assert got[0].content[0].text == "hi" and [p.type for p in got[1].content] == ["image_url", "text"] and got[1].content[0].image_url == "f.png"


def test_recipes_events_boxes_observations(spark, tmp_path):
    put(tmp_path / "rec" / "boat.json", json.dumps({"type": "minecraft:crafting_shaped", "pattern": ["# #", "###"], "key": {"#": {"item": "minecraft:planks"}}, "result": {"item": "minecraft:boat", "count": 2}}))
    put(tmp_path / "rec" / "glass.json", json.dumps({"type": "minecraft:smelting", "ingredient": {"tag": "minecraft:sand"}, "result": "minecraft:glass"}))
    got = {x.item: (x.result_item, x.result_count) for x in r.read_recipes(spark, str(tmp_path / "rec")).collect()}
    assert got == {"boat": ("minecraft:boat", 2), "glass": ("minecraft:glass", 1)}
    events = [{"keyboard": {"keys": ["key.keyboard.w"]}, "mouse": {"dx": i, "dy": 0, "buttons": [], "newButtons": []}, "hotbar": i, "isGuiOpen": False} for i in range(3)]
    put(tmp_path / "ev" / "ep1.jsonl", "\n".join(map(json.dumps, events)) + "\n")
    rows = r.read_input_events(spark, str(tmp_path / "ev")).orderBy("t").collect()
    assert [(x.episode_id, x.t, x.hotbar) for x in rows] == [("ep1", i, i) for i in range(3)]
    box = put(tmp_path / "b.csv", 'ID,Element,Top,Right,Bottom,Left,Width,Height,Alt,Class,Id,TextContent,Interactable\n"1","A","0","5","5","0","5","5","","c","","a, b\nc","true"\n')
    assert r.read_boxes(spark, box).first().TextContent == "a, b\nc"
    seen = put(tmp_path / "o.json", json.dumps({"url": "u", "text_observation": "\t[1] x", "viewport_size": {"width": 3, "height": 4}}))
    assert r.read_observations(spark, seen).first().text_observation == "[1] x"


def test_scan_episodes(spark, tmp_path):
    for ep, files in {"e1": ["frames/0.png", "metadata.json", "actions.pkl", "embeds_attn.pkl", "len.txt"], "e2": ["frames/0.png", "len.txt"]}.items():
        for name in files:
            put(tmp_path / ep / name, "20" if name == "len.txt" else "x")
    assert [tuple(x) for x in r.scan_episodes(spark, str(tmp_path)).collect()] == [("e1", 20)]


def test_shards_and_reports(spark, tmp_path):
    steps = spark.createDataFrame([(str(i % 2), str(i), "ab"[i % 2]) for i in range(6)], "task_id STRING, step_id STRING, website_name STRING")
    w.write_bucket_shards(bucketing.assign_buckets(steps), str(tmp_path / "s"))
    assert (tmp_path / "s" / "shard=G1_High__Q1_0-25%25").exists() or any("__" in p.name for p in (tmp_path / "s").iterdir())
    assert spark.read.json(str(tmp_path / "s")).count() == 6
    w.write_csv_report(bucketing.domain_summary(steps), str(tmp_path / "c"), ["website_name"])
    parts = sorted(p for p in (tmp_path / "c").iterdir() if p.name.endswith(".csv"))
    assert "".join(p.read_text() for p in parts).splitlines()[0] == "website_name,count"
    ids = spark.createDataFrame([("e1", "train"), ("e2", "val")], "episode_id STRING, part STRING")
    w.write_id_list(ids, str(tmp_path / "l"), "x")
    assert [x.id for x in r.read_id_list(spark, str(tmp_path / "l" / "x_val")).collect()] == ["e2"]
    lines = spark.createDataFrame([(2, "1.0"), (0, ""), (1, "0.0")], "task_id INT, line STRING")
    w.write_score_vector(lines, str(tmp_path / "v"))
    assert spark.read.text(str(tmp_path / "v")).where(F.col("value") != "").count() == 2
