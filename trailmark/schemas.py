"""Schemas of the tables the operators read, as Spark DDL."""

THOUGHT_ACTION = "STRUCT<thought:STRING,action:STRING>"

STEPS = (
    "task_id STRING, step_id STRING, website_name STRING, intent STRING, start_url STRING, "
    "current_url STRING, text_observation STRING, thought_history ARRAY<STRING>, "
    f"action_history ARRAY<STRING>, chosen {THOUGHT_ACTION}, rejected ARRAY<{THOUGHT_ACTION}>, "
    "checklist STRING, checklist_target_list ARRAY<STRING>"
)

JUDGEMENTS = (
    "task_id STRING, step_id STRING, is_reasonable BOOLEAN, category STRING, confidence DOUBLE, "
    "reason STRING, flow_analysis STRING, model STRING, error STRING, skipped STRING, "
    "parse_error BOOLEAN, raw STRING"
)

ACTION = (
    "STRUCT<action_type:STRING, coords:ARRAY<FLOAT>, element_role:STRING, element_name:STRING, "
    "element_id:STRING, text:STRING, page_number:INT, url:STRING, nth:INT, direction:STRING, "
    "key_comb:STRING, pw_code:STRING, answer:STRING, raw_prediction:STRING>"
)
ACTIONS = f"task_id STRING, step_no INT, action {ACTION}"

RUN_BODY = (
    "index STRING, error STRING, info STRING, "
    "output STRUCT<index:STRING, status:STRING, result:STRING, "
    "history:ARRAY<STRUCT<role:STRING,content:STRING>>>, "
    "time STRUCT<timestamp:BIGINT,str:STRING>"
)
RUNS = f"agent STRING, task STRING, {RUN_BODY}"

OVERALL_BODY = "total BIGINT, validation MAP<STRING,DOUBLE>, custom STRING"
OVERALL = f"agent STRING, task STRING, path STRING, mtime TIMESTAMP, {OVERALL_BODY}"

TASK_SCORES_BODY = "task_id INT, score DOUBLE, actions ARRAY<STRING>"

TASK_CONFIG = (
    "task_id INT, old_task_id INT, sites ARRAY<STRING>, intent STRING, start_url STRING, "
    "sources ARRAY<STRING>, eval STRUCT<eval_types:ARRAY<STRING>, "
    "reference_answers:STRING, reference_url:STRING, url_note:STRING, string_note:STRING, "
    "program_html:ARRAY<STRUCT<url:STRING,locator:STRING,required_contents:STRING>>>"
)

CONTENT_PART = "STRUCT<type:STRING,text:STRING,image_url:STRING>"
CONVERSATIONS_FILE = "input STRING, output STRING, history ARRAY<STRUCT<role:STRING,content:STRING>>"

OBSERVATIONS = (
    "url STRING, page_title STRING, text_observation STRING, timestamp STRING, "
    "viewport_size STRUCT<width:INT,height:INT>, current_viewport_only BOOLEAN"
)

BOXES_FILE = (
    "ID INT, Element STRING, Top DOUBLE, Right DOUBLE, Bottom DOUBLE, Left DOUBLE, Width DOUBLE, "
    "Height DOUBLE, Alt STRING, Class STRING, Id_attr STRING, TextContent STRING, Interactable BOOLEAN"
)

INPUT_EVENTS_BODY = (
    "keyboard STRUCT<keys:ARRAY<STRING>>, mouse STRUCT<dx:DOUBLE,dy:DOUBLE,x:DOUBLE,y:DOUBLE,"
    "buttons:ARRAY<INT>,newButtons:ARRAY<INT>>, hotbar INT, isGuiOpen BOOLEAN"
)

RECIPES_BODY = (
    "type STRING, pattern ARRAY<STRING>, key MAP<STRING,STRUCT<item:STRING,tag:STRING>>, "
    "ingredients ARRAY<STRUCT<item:STRING,tag:STRING>>, ingredient STRUCT<item:STRING,tag:STRING>, "
    "result STRING"
)

NODES = (
    "page_id STRING, node_id STRING, parent_id STRING, ord INT, role STRING, name STRING, "
    "properties ARRAY<STRUCT<name:STRING,value:STRING>>, bound ARRAY<DOUBLE>"
)

COMMENTS = (
    "post_id STRING, comment_id STRING, parent_id STRING, username STRING, net_score INT, "
    "content STRING, time TIMESTAMP"
)

GROUP_MAP_FILE = "website_name STRING, count BIGINT, group STRING"
