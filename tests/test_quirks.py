"""Pinned semantics, one hand-made table each."""

import pytest
from pyspark.sql import functions as F

from trailmark.functions import actions as a
from trailmark.functions import answers as n
from trailmark.functions import geometry as g
from trailmark.functions import messages as m
from trailmark.functions import observations as o
from trailmark.functions import text as x
from trailmark.functions import urls as u
from trailmark.operators import audits, boxes, bucketing, chats, scoring, tasks
from trailmark.sources import readers


def values(spark, items, make, kind="STRING"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i INT, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_safe_int(spark):
    assert values(spark, [" 4 ", "3.7", "", None, "-12", "1_000", "true", "+5", "1__0"], x.safe_int) == [4, 0, 0, 0, -12, 1000, 0, 5, 0]


def test_rel_bins_are_half_open(spark):
    got = values(spark, [0.0, 0.249, 0.25, 0.5, 0.75, 1.0], x.rel_bin, "DOUBLE")
    assert [b[:2] for b in got] == ["Q1", "Q1", "Q2", "Q3", "Q4", "Q4"]


def test_truncate_and_clip(spark):
    assert values(spark, ["abcdefgh", "abcd", None], lambda c: x.truncate(c, 6)) == ["abc...", "abcd", None]
    assert values(spark, ["abcdefgh"], lambda c: x.clip(c, 6)) == ["abcdef..."]


def test_segments_and_tokens(spark):
    assert values(spark, ["abcdefghij kl!\n", "é" * 8, "1 2"], x.segments) == [4, 2, 2]
    assert values(spark, ["hello wonderful ## you\n\nend", "a-b"], x.token_estimate) == [1 + 2 + 1 + 1 + 1 + 1, 2]


def test_split_intent_and_steps(spark):
    got = values(spark, ["buy it\n\nPrevious Discoveries: a", "plain"], x.split_intent)
    assert [tuple(r) for r in got] == [("buy it", "\n\nPrevious Discoveries: a"), ("plain", "")]
    assert values(spark, ["7", "2b", " 9 "], x.increment_step) == ["8", "2b+1", "10"]


def test_base_action_and_type(spark):
    assert values(spark, ["click('12')", "click [Save]", " scroll down ", "f[1](2)"], a.base_action) == ["click", "click", "scroll down", "f"]
    assert values(spark, ["click [a](b)", "go_back"], a.action_type) == ["click [a]", "go_back"]


PARSE = {
    "click [12]": ("CLICK", "12", None, None, None), "click [Save all]": ("CLICK", None, "Save all", "button", None),
    "click('12')": (None, None, None, None, None), "type [3] [a b]": ("TYPE", "3", None, None, "a b\n"),
    "type [3] [a] [0]": ("TYPE", "3", None, None, "a"), "type [Name] [x] [1]": ("TYPE", None, "Name", "textbox", "x\n"),
    "scroll down": ("SCROLL", None, None, None, None), "go_back": ("GO_BACK", None, None, None, None),
    "clear [4]": ("CLEAR", "4", None, None, None), "close_tab": ("PAGE_CLOSE", None, None, None, None),
    "send_msg_to_user('hi')": ("SEND_MESSAGE_TO_USER", None, None, None, None), "fly [1]": (None, None, None, None, None),
}


def test_parse_id_action(spark):
    got = values(spark, list(PARSE), a.parse_id_action)
    fields = ("action_type", "element_id", "element_name", "element_role", "text")
    assert [tuple(r[f] for f in fields) for r in got] == list(PARSE.values())
    assert values(spark, ["stop", "stop [42]"], lambda c: a.parse_id_action(c)["answer"]) == ["", "42"]


def test_parse_id_action_takes_odd_lines(spark):
    """Brackets within arguments, no or too many blanks, a second line, quotes within a message."""
    written = ["goto [http://a.b/c?x[1]=2]", "goto  [http://a.b]", "click[7]", "click [a] b [c]", "click []]", "type [5] [x [y] z] [0]",
               "type [5] [x]", "stop [a]\n[b]", "scroll[up", "tab_focus [x]", None]
    got = values(spark, written, a.parse_id_action)
    assert [r["url"] for r in got[:2]] == ["http://a.b/c?x[1]=2", None] and got[1]["action_type"] is None
    assert [(r["element_id"], r["element_name"]) for r in got[2:5]] == [("7", None), (None, "a"), (None, "]")]
    assert [r["text"] for r in got[5:7]] == ["x [y] z", "x\n"]
    assert got[7]["answer"] == "a" and got[8]["direction"] == "up" and got[9]["action_type"] is None and got[10]["action_type"] is None
    messages = ['send_msg_to_user("a \'b\' (c)")', "send_msg_to_user ( 'it\n' ) x", "send_msg_to_user('x\")"]
    assert values(spark, messages, lambda c: a.parse_id_action(c)["answer"]) == ["a 'b' (c)", "it\n", None]


def test_parse_keeps_the_key(spark):
    written = ["click [12]", "hover [3]", "type [3] [a b] [0]", "press [Enter]", "goto [http://x.y/z]", "scroll [up]",
               "new_tab", "close_tab", "go_back", "go_forward", "stop [42]", 'send_msg_to_user("hi there")']
    once = values(spark, written, lambda c: a.action_key(a.parse_id_action(c)))
    back = values(spark, written, lambda c: a.action_to_str(a.parse_id_action(c), F.lit("x")))
    again = values(spark, back, lambda c: a.action_key(a.parse_id_action(F.regexp_replace(c, r" where \[.*$", ""))))
    assert None not in once and once == again


def test_action_keys(spark):
    same = values(spark, ["scroll [up]", "scroll up", "click [1]", "click [Save]", "click [Save]"], lambda c: a.action_key(a.parse_id_action(c)))
    assert same[0] == same[1] and same[3] == same[4] and same[2] != same[3]


def test_parse_do_and_calls(spark):
    done = values(spark, ['# think\n\ndo(action="Click", element="5")', 'do(action="Search", argument="a", element="2")', 'do(action="Press Enter")',
                          'exit(message="ok")', "send_msg('x')", 'do(action="Click")'], a.parse_do_action)
    assert [r["action_type"] for r in done] == ["CLICK", "SEARCH", "KEY_PRESS", "STOP", "STOP", None]
    assert [r["answer"] for r in done][3:5] == ["ok", "x"] and done[1]["text"] == "a"
    calls = values(spark, ['page.get_by_label("v1.2").click()', 'page.goto("http://a.b/c.d")', 'page.stop("x")', 'page.press("Meta+a")', "page.jump()"], a.parse_call_action)
    assert [r["action_type"] for r in calls] == ["CLICK", "GOTO_URL", "STOP", "KEY_PRESS", None]
    assert calls[1]["url"] == "http://a.b/c.d"


def test_reply_extraction(spark):
    replies = ["thought: why\naction: ```click [1]```", "So. In summary, the next action I will perform is ```stop [2]```",
               "see ```go_back``` or ```x```", "In summary, the next action I will perform is ` scroll down `", " plain "]
    got = values(spark, replies, a.extract_thought_action)
    assert [tuple(r) for r in got] == [("why", "click [1]"), ("So.", "stop [2]"), ("", "go_back"), ("", "scroll down"), ("", "plain")]


def test_answer_cleaning_and_tokens(spark):
    assert values(spark, ["'A b'", '"X"', "it's", "'", "'a\""], n.clean_answer) == ["a b", "x", "it's", "", "'a\""]
    checks = [("10", "on 10/12 now", 1.0, 1.0), ("0", "100", 0.0, 1.0), ("two words", "Two Words here", 1.0, 0.0), ("12", "12", 1.0, 0.0)]
    rows = spark.createDataFrame(checks, "r STRING, p STRING, inc DOUBLE, exc DOUBLE")
    got = rows.select(n.must_include(F.col("r"), F.col("p")), n.must_exclude(F.col("r"), F.col("p")), "inc", "exc").collect()
    assert all(r[0] == r[2] and r[1] == r[3] for r in got)


def test_bounds_are_tolerant(spark):
    rows = [(300.0, ">= 300"), (300.0, "< 300"), (300.0, "> 300"), (299.0, "< 300 |OR| == 7"), (7.0, "> 9 |OR| == 7"), (7.0, "<= 6.9")]
    got = spark.createDataFrame(rows, "v DOUBLE, r STRING").select(n.satisfies(F.col("v"), F.col("r"))).collect()
    assert [r[0] for r in got] == [True, True, True, True, True, False]


def test_str_to_int(spark):
    assert values(spark, [" 1,234 ", "12.5", "abc", "-3"], n.str_to_int) == [1234, None, None, -3]


def test_verdicts(spark):
    assert values(spark, ["Correct", "partially correct", "INCORRECT", "hm"], n.fuzzy_verdict) == [1.0, 0.0, 0.0, None]
    assert values(spark, ["<Answer>Response 2</Answer>", "response 1", "x"], n.pairwise_vote) == [-1, 1, 0]


def test_urls(spark):
    rows = spark.createDataFrame([("http://localhost/a/", "http://127.0.0.1/a |OR| b", "EXACT"), ("http://x/a/b", "x/a", "GOLD in PRED"), ("http://x", "y", "??")], "u STRING, r STRING, k STRING")
    assert [r[0] for r in rows.select(u.url_match(F.col("u"), F.col("r"), F.col("k"))).collect()] == [1.0, 1.0, None]
    here = "http://s.com/a?x=1#top"
    links = ["http://s.com/a?x=1#b", "#x", "javascript:1", "mailto:a@b", "/rel", here, "https://o.com", "", None, "http://s.com/b#c"]
    assert values(spark, links, lambda c: u.is_navigation_url(c, F.lit(here))) == [False] * 6 + [True, False, False, True]
    assert values(spark, ["http://r.com/f/books/12/title", "http://r.com/x/1/2/3", "http://r.com/f/a"], u.post_url) == [
        "http://r.com/f/books/12/", "http://r.com/x/1/2/3", "http://r.com/f/a"]
    assert values(spark, ["b.html", "/c", "//d.com/e", "?q", "http://z"], lambda c: u.resolve(F.lit("http://s.com/p/a.html?x#y"), c)) == [
        "http://s.com/p/b.html", "http://s.com/c", "http://d.com/e", "http://s.com/p/a.html?q", "http://z"]


OBS = "\n".join(["Tab 0", "[1] RootWebArea 'x'", "\t[2] link 'Shop', url='/shop'", "[3] link 'Quick View', url='http://a/q.html'", "[4] link 'A', url='http://a/i.html'",
                 "[5] button 'Go' expanded: True controls: menu-1", "[6] textbox 'Mail' required: True", "[7] StaticText 'Go'", "[8] generic ''", "[5] link 'late', url='http://b'", "[9] link 'A', url='http://a/i.html'"])


def test_observation_lookups(spark):
    rows = [("click('4')",), ('CLICK("2")',), ("click('4\")",), ("click(4)",), ("click('5')",), ("click('99')",)]
    df = spark.createDataFrame(rows, "act STRING").withColumn("obs", F.lit(OBS))
    got = df.select(o.parse_click_id(F.col("act")), o.link_url_by_id(F.col("obs"), o.parse_click_id(F.col("act"))),
                    o.has_nav_rejected(F.col("obs"), F.col("act")), o.resolve_rejected_url(F.col("obs"), F.col("act"), F.lit("http://s/p"))).collect()
    assert [tuple(r) for r in got] == [
        ("4", "http://a/i.html", True, 'page.goto("http://a/i.html")'), ("2", "/shop", False, 'page.goto("http://s/shop")'),
        ("4", "http://a/i.html", True, 'page.goto("http://a/i.html")'), (None, None, False, None), ("5", None, False, None), ("99", None, False, None)]


def test_observation_texts(spark):
    simple = values(spark, [OBS], o.simplify_observation)[0].split("\n")
    assert simple == ["[2] link 'Shop', url='/shop'", "[3] link 'Quick View', url='http://a/q.html'", "[4] link 'A', url='http://a/i.html'",
                      "[5] button 'Go', expanded=True, controls='menu-1'", "[6] textbox 'Mail'", "[7] StaticText 'Go'", "[5] link 'late', url='http://b'", "[9] link 'A', url='http://a/i.html'"]
    assert values(spark, [OBS], o.visible_elements) == ["link: Shop, link: Quick View, link: A, button: Go, textbox: Mail, link: late"]
    assert values(spark, [OBS], lambda c: o.element_context(c, F.lit("1"), 1)) == ["\n".join(OBS.split("\n")[:3])]
    seen = "[1] link 'a b'\n[2] StaticText 'a'\n[3] link 'c'\n[4] link 'd'\n[5] link 'e'\n[6] StaticText 'a'\n[7] StaticText ''"
    assert values(spark, [seen], o.clean_static_text) == ["[1] link 'a b'\n[3] link 'c'\n[4] link 'd'\n[5] link 'e'\n[6] StaticText 'a'"]


def test_viewport_ratio(spark):
    row = spark.range(1).select(*[F.lit(float(v)).alias(c) for c, v in zip("xywh", (-50, 0, 100, 10))])
    cols = [F.col(c) for c in "xywh"]
    got = row.select(g.viewport_ratio(*cols, 1280, 720), g.viewport_ratio(*cols, 1280, 720, compat=True)).first()
    assert tuple(got) == (0.5, 50.0)


def test_statuses_and_names(spark):
    assert values(spark, ["TASK_LIMIT_REACHED", "completed", "odd"], m.normalise_status) == ["task limit reached", "completed", None]
    got = values(spark, ["/d/ep_models[a,b]_mxFrm9_nmFrm77_seed1_termDeath", "/d/ep_x"], m.parse_episode_name)
    assert [tuple(r) for r in got] == [(77, True, "Death"), (None, False, "Incomplete")]
    assert values(spark, ["Ordered12", "Ordered", None], m.ordered_quantity) == [12, 0, 0]


def test_buckets_with_edges(spark):
    rows = [("t1", "2", "a.com"), ("t1", "10", " a.com "), ("t1", "3.7", ""), ("t2", " 4 ", None), ("", "5", "b.com")]
    steps = spark.createDataFrame(rows, "task_id STRING, step_id STRING, website_name STRING")
    got = {(r.task_id, r.step_id): r.bucket for r in bucketing.assign_buckets(steps).collect()}
    assert got == {("t1", "2"): "G1_High|Q1_0-25%", ("t1", "10"): "G1_High|Q4_75-100%", ("t1", "3.7"): "G2_Mid|Q1_0-25%",
                   ("t2", " 4 "): "G2_Mid|Q1_0-25%", ("", "5"): "G3_Low|Q1_0-25%"}
    assert sum(r["count"] for r in bucketing.bucket_counts(steps).collect()) == len(rows)


def test_verdict_classes(spark):
    steps = spark.range(6).withColumnRenamed("id", "step")
    told = spark.createDataFrame([(0, True, 0.9, None, None, None), (1, False, 0.79, None, None, None), (2, None, None, "off", None, None), (3, None, None, None, "e", None), (4, None, None, None, None, True)],
                                 "step BIGINT, is_reasonable BOOLEAN, confidence DOUBLE, skipped STRING, error STRING, parse_error BOOLEAN")
    got = {r.step: r.verdict for r in audits.attach_judgements(steps, told, ["step"]).collect()}
    assert got == dict(enumerate(["reasonable", "unreasonable", "skipped", "error", "parse_error", "missing"]))


def test_empty_class_has_no_rate(spark):
    none = spark.createDataFrame([], "success BOOLEAN")
    assert scoring.success_rate(none, []).first()["success_rate"] is None


def test_upsert_outcomes(spark):
    target = spark.createDataFrame([(1, 0, ["a"]), (1, 1, ["a"]), (2, 2, [])], "id INT, pos INT, sources ARRAY<STRING>")
    base = spark.createDataFrame([(3, 0, []), (3, 5, [])], "id INT, pos INT, sources ARRAY<STRING>")
    wanted = spark.createDataFrame([(1,), (3,), (4,)], "id INT")
    got = {(r.id, r.pos, tuple(r.sources or ()), r.outcome) for r in tasks.upsert_tasks(target, base, wanted, "id", "pos", "w").collect()}
    assert got == {(1, 0, ("a",), "kept"), (1, 1, ("a", "w"), "tagged"), (2, 2, (), "kept"), (3, 5, ("w",), "added"), (4, None, (), "missing")}


def test_repeated_actions_drop_their_replies(spark):
    talk = ["u:go", "a:Action: x()", "u:ok", "a:Action: x()", "a:Action: x()", "u:gone", "u:stays", "a:Action: revert_last_edit()\nlast", "u:end"]
    rows = [("c", i, "agent" if s[0] == "a" else "user", s[2:]) for i, s in enumerate(talk)]
    turns = spark.createDataFrame(rows, "conv_id STRING, turn INT, role STRING, content STRING")
    assert [r.turn for r in chats.drop_repeated_actions(turns).orderBy("turn").collect()] == [0, 1, 2, 6, 7, 8]


def test_long_first_message_stays(spark):
    rows = [("c", 0, "user", "word " * 50), ("c", 1, "agent", "a"), ("c", 2, "user", "b")]
    turns = spark.createDataFrame(rows, "conv_id STRING, turn INT, role STRING, content STRING")
    got = chats.keep_recent_messages(turns, budget=20).collect()
    assert len(got) == 1 and got[0].content.endswith("[NOTICE] 2 messages are omitted.")


def test_rebuild(spark):
    done = "You have successfully edited the rule."
    talk = ["u:task", 'a:Action: get_selectors_by_html_elements("div")', "u:.a and .b", 'a:Action: edit_rule(".a", "color", "red")', f"u:{done}",
            "a:Action: revert_last_edit()", "u:You have successfully reverted the last edit.", "a:Action: other()", "u:ok", "a:Action: other2()", "u:ok",
            'a:Action: edit_rule(".b", "color", "red")', f"u:{done}", 'a:Action: edit_rule(".c", "color", "red")', f"u:{done}"]
    rows = [("c", i, "agent" if s[0] == "a" else "user", s[2:]) for i, s in enumerate(talk)]
    turns = spark.createDataFrame(rows, "conv_id STRING, turn INT, role STRING, content STRING")
    out = chats.rebuild_conversations(turns).orderBy("pos", "sub").collect()
    own = [r.content for r in out if r["sub"] == 0]
    assert own == [talk[i][2:] for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 11, 12)]
    added = [r for r in out if r["sub"] > 0]
    assert [r.role for r in added] == ["agent", "user"] and added[0].content.endswith("Action: revert_last_edit()")
    assert {r.pos for r in added} == {13}


def test_overlap_rule(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 7.0, 7.0, 17.0, 17.0), (1, 3, 9.0, 0.0, 19.0, 10.0), (2, 4, 0.0, 0.0, 10.0, 10.0)],
                                 "page_id INT, id INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")
    assert {r.id for r in boxes.label_overlaps(rows, 4, 20).collect()} == set()
    assert {r.id for r in boxes.label_overlaps(rows, 2, 20).collect()} == {2, 3}


@pytest.mark.parametrize("log,want", [("[Config file]: a/3.json\n[Result] (PASS) x\n[Result] (FAIL) x", {3: False}), ("[Result] (PASS)\n[Config file]: 4.json\n[Result] odd", {4: None})])
def test_log_results(spark, log, want):
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(log.split("\n"))], "file STRING, line INT, value STRING")
    assert {r.task_id: r.success for r in readers.run_log_results(lines, "file", ["line"]).collect()} == want


def test_equal_action_texts_stop_a_run(spark):
    rows = [(1, i, "TYPE", f"k{i}", "type [1] [x]" if i > 2 else f"go {i}") for i in range(6)]
    actions = spark.createDataFrame(rows, "task_id BIGINT, step_no BIGINT, action_type STRING, key STRING, raw STRING")
    assert chats.stop_reasons(actions, ["step_no"], repeat=3).count() == 0
    got = chats.stop_reasons(actions, ["step_no"], repeat=3, text="raw").collect()
    assert [(r.step_no, r.reason) for r in got] == [(5, "same_action")]


def test_stitch_rebuilt(spark):
    edit, done = 'Action: edit_rule("#a", "color", "red")', "You have successfully edited the rule."
    failed = [("user", "task"), ("agent", edit), ("user", done), ("agent", "Action: look at #a")]
    success = [("user", "task"), ("agent", "x"), ("user", "y"), ("agent", edit), ("user", done), ("agent", "finish()")]
    frame = lambda rows: spark.createDataFrame(
        [(k, i, r, m) for k, told in rows for i, (r, m) in enumerate(told)], "conv_id BIGINT, turn BIGINT, role STRING, content STRING"
    )
    closed = failed[:3]
    rich = success[:5] + [("agent", 'Action: edit_rule("#b", "top", "1")'), ("user", done)]
    got = chats.stitch_rebuilt(frame([(1, failed), (2, closed), (3, failed)]), frame([(1, success), (2, success), (3, rich)]))
    rows = got.orderBy("conv_id", "part", "pos", "sub").collect()
    assert {r.conv_id for r in rows} == {1}
    texts = [(r.part, r.content) for r in rows]
    assert [t for p, t in texts if p == "failed"][:3] == ["task", edit, done]
    assert "revert_last_edit()" in texts[3][1] and texts[4][1] == "You have successfully reverted the last edit."
    assert [t for p, t in texts if p == "success"] == [edit, done, "finish()"] and len(texts) == 8
