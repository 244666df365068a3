"""Expressions over accessibility-tree text, one line per element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions.text import let, lines, strip
from trailmark.functions.urls import is_absolute, resolve

# Roles listed as visible elements.
VISIBLE_ROLES = (
    "button", "link", "textbox", "input", "combobox", "checkbox", "radio", "menuitem", "option", "tab",
    "switch", "image",
)
# Roles kept by the simplified observation.
SIMPLE_ROLES = (
    "link", "button", "textbox", "combobox", "checkbox", "radio", "select", "input", "StaticText",
)
LINK_LINE = r"(?i)^\[(\d+)\]\s+link\s+'([^']+)'\s*,\s*url='([^']+)'"
ELEMENT_LINE = r"(?i)\[\d+\]\s+(" + "|".join(VISIBLE_ROLES) + r")\s+'([^']+)'"
CLICK_CALL = r"""(?i)^click\(['"](\d+)['"]\)\z"""


def parse_click_id(action: Column) -> Column:
    found = F.regexp_extract(strip(action), CLICK_CALL, 1)
    return F.nullif(found, F.lit(""))


def link_url_by_id(observation: Column, element_id: Column) -> Column:
    """URL of the first line of the element; null when that line is no link."""
    prefix = F.concat(F.lit("["), element_id, F.lit("]"))
    hits = F.filter(lines(observation), lambda row: row.contains(prefix) & strip(row).startswith(prefix))
    first = strip(F.get(hits, F.lit(0)))
    return let(F.regexp_extract(first, LINK_LINE, 3), lambda url: F.nullif(url, F.lit("")))


def has_nav_rejected(observation: Column, rejected_action: Column) -> Column:
    url = link_url_by_id(observation, parse_click_id(rejected_action))
    return let(url, lambda found: F.coalesce(is_absolute(found), F.lit(False)))


def resolve_rejected_url(observation: Column, rejected_action: Column, current_url: Column) -> Column:
    """``page.goto("…")`` for a rejected click on a link; null when nothing can be resolved."""
    url = link_url_by_id(observation, parse_click_id(rejected_action))

    def call(found: Column) -> Column:
        target = F.when(is_absolute(found), found).otherwise(resolve(current_url, found))
        return F.concat(F.lit('page.goto("'), target, F.lit('")'))

    return let(url, call)


def visible_elements(observation: Column, limit: int = 24) -> Column:
    """``role: label`` of the first distinct elements, joined by commas."""
    rows = F.filter(lines(observation), lambda row: row.rlike(ELEMENT_LINE))
    labelled = F.transform(
        rows,
        lambda row: F.concat(
            F.lower(F.regexp_extract(row, ELEMENT_LINE, 1)), F.lit(": "),
            strip(F.regexp_extract(row, ELEMENT_LINE, 2)),
        ),
    )
    return F.array_join(F.slice(F.array_distinct(labelled), 1, limit), ", ")


def element_context(observation: Column, element_id: Column, around: int = 2) -> Column:
    """The element's line with its neighbours; empty when it is missing."""
    rows = lines(observation)
    prefix = F.concat(F.lit("["), element_id, F.lit("]"))

    def cut(found: Column) -> Column:
        all_rows, at = found["rows"], found["at"]
        start = F.greatest(F.lit(1), at - around)
        window = F.slice(all_rows, start, at + around - start + 1)
        return F.when(at > 0, F.array_join(window, "\n")).otherwise("")

    def locate(all_rows: Column) -> Column:
        flags = F.transform(all_rows, lambda row: row.contains(prefix) & strip(row).startswith(prefix))
        return F.struct(all_rows.alias("rows"), F.array_position(flags, True).cast("int").alias("at"))

    return let(let(rows, locate), cut)


def _quoted_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"""^['"]+|['"]+$""", "")


def simple_line(raw: Column) -> Column:
    """One line of the simplified observation, or null when the line is left out."""
    wanted = raw.contains("[") & raw.contains("]") & ~F.lower(raw).contains("generic")
    return F.when(wanted, let(strip(raw), lambda line: let(_line_parts(line), _simple_line)))


def _line_parts(line: Column) -> Column:
    rest = strip(F.regexp_extract(line, r"^[^\]]*\](.*)$", 1))
    return F.struct(line.alias("line"), F.regexp_extract(line, r"^[^\[]*\[(.*?)\]", 1).alias("id"), rest.alias("rest"))


def _simple_line(parts: Column) -> Column:
    line, element_id, rest = parts["line"], parts["id"], parts["rest"]
    role = F.substring_index(rest, " ", 1)
    content = F.regexp_extract(rest, r"^[^ ]* (.*)$", 1)
    visible = F.when(content.rlike("'[^']*'"), F.regexp_extract(content, "'([^']*)'", 1)).otherwise(content)
    typed = F.when(
        content.contains("required:"), _quoted_trim(strip(F.substring_index(content, "required:", 1)))
    ).otherwise(_quoted_trim(content))
    label = F.when(role.isin("button", "link"), visible).when(role == "textbox", typed).otherwise(_quoted_trim(content))
    quoted_url = F.regexp_extract(line, r"url='([^']*)'", 1)
    bare_url = F.regexp_replace(F.regexp_extract(line, r"url:\s*(\S+)", 1), r"""^['" ,;]+|['" ,;]+$""", "")
    url = F.coalesce(F.nullif(quoted_url, F.lit("")), bare_url, F.lit(""))
    expanded_true = line.contains("expanded: True")
    controls = F.regexp_extract(line, r"controls:\S*\s+(\S+)", 1)
    properties = F.array_compact(F.array(
        F.when(role == "link", F.concat(F.lit("url='"), url, F.lit("'"))),
        F.when((role == "button") & line.contains("hasPopup:") & line.contains("dialog"), F.lit("hasPopup='dialog'")),
        F.when((role == "button") & expanded_true, F.lit("expanded=True")),
        F.when(
            (role == "button") & expanded_true & line.contains("controls:"),
            F.concat(F.lit("controls='"), controls, F.lit("'")),
        ),
        F.when((role == "button") & line.contains("expanded:") & ~expanded_true, F.lit("expanded=False")),
        F.when((role == "textbox") & line.contains("focused"), F.lit("focused")),
        F.when(line.contains("focused: True"), F.lit("focused")),
    ))
    head = F.concat(F.lit("["), element_id, F.lit("] "), role, F.lit(" '"), label, F.lit("'"))
    full = F.when(F.size(properties) > 0, F.concat(head, F.lit(", "), F.array_join(properties, ", "))).otherwise(head)
    keep = (
        ~line.startswith("Tab") & ~line.startswith("RootWebArea") & rest.contains(" ")
        & role.isin(*SIMPLE_ROLES) & ((role == "link") | (label != ""))
    )
    return F.when(keep, full)


def simplify_observation(observation: Column) -> Column:
    kept = F.array_compact(F.transform(F.split(observation, "\n"), simple_line))
    return F.array_join(kept, "\n")


def clean_static_text(observation: Column) -> Column:
    """Drop static text that one of the last three kept lines already shows."""
    pattern = r"(?s)\[\d+\] StaticText (.+)"

    rows = F.split(observation, "\n")
    start = F.expr("cast(array() as array<string>)")

    def fold(kept: Column, line: Column) -> Column:
        quoted = F.regexp_extract(line, pattern, 1)
        inner = F.regexp_extract(quoted, r"(?s)^.(.*).\z", 1)
        recent = F.slice(kept, F.greatest(F.size(kept) - 2, F.lit(1)), 3)
        fresh = (inner != "") & ~F.exists(recent, lambda seen: seen.contains(inner))
        keep = ~F.lower(line).contains("statictext") | fresh
        return F.when(keep, F.concat(kept, F.array(line))).otherwise(kept)

    return F.array_join(F.aggregate(rows, start, fold), "\n")
