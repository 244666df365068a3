"""Scalar text and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the four relative-position bins.
REL_BINS = ("Q1_0-25%", "Q2_25-50%", "Q3_50-75%", "Q4_75-100%")
# Labels of the three domain groups, largest domains first.
DOMAIN_GROUPS = ("G1_High", "G2_Mid", "G3_Low")
# Word lists of the context-limit message rule.
CONTEXT_WORDS = ("prompt", "context", "tokens")
LIMIT_WORDS = ("limit", "exceed", "max", "long", "much", "many", "reach", "over", "up", "beyond")

LINE_BREAK = "\r\n|\r|\n"


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once per row, however often ``body`` reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Remove white space at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """The lines of a text; a final line break opens no further line."""
    return F.split(F.regexp_replace(text, r"(\r\n|\r|\n)\z", ""), LINE_BREAK)


def safe_int(value: Column, default: int = 0) -> Column:
    text = strip(value.cast("string"))
    whole = text.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$")
    number = F.when(whole, F.replace(text, F.lit("_"), F.lit("")).try_cast("bigint"))
    return F.coalesce(number, F.lit(default).cast("bigint"))


def norm_domain(name: Column) -> Column:
    text = strip(name)
    return F.when(text.isNull() | (text == ""), "unknown").otherwise(text)


def rel_bin(rel: Column) -> Column:
    return (
        F.when(rel < 0.25, REL_BINS[0])
        .when(rel < 0.50, REL_BINS[1])
        .when(rel < 0.75, REL_BINS[2])
        .otherwise(REL_BINS[3])
    )


def rel_position(step: Column, lo: Column, hi: Column) -> Column:
    """Position of a step in its task; the step itself widens the range."""
    low, high = F.least(lo, step), F.greatest(hi, step)
    return F.when(high == low, F.lit(0.0)).otherwise((step - low) / (high - low))


def truncate(text: Column, size: int) -> Column:
    """At most ``size`` characters, the last three of them dots when something was cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))).otherwise(text)


def clip(text: Column, size: int) -> Column:
    """The first ``size`` characters followed by dots when something was cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def summarize_page_state(observation: Column, size: int = 500) -> Column:
    return F.concat(F.lit("Top accessibility snippet: "), truncate(strip(observation), size))


def truncate_observation(text: Column, size: int) -> Column:
    return F.substring(text, 1, size)


def clean_html(html: Column) -> Column:
    """Drop comments, style and script elements, and collapse white space."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?s)<style.*?>.*?</style>", "")
    text = F.regexp_replace(text, r"(?s)<script.*?>.*?</script>", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_non_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]+", "")


def segments(text: Column) -> Column:
    """Runs of letters cut every seven, plus one for each other sign but space and line feed."""
    return F.regexp_count(text, F.lit(r"\p{L}{1,7}")) + F.regexp_count(text, F.lit(r"[^\p{L} \n]"))


def token_estimate(text: Column) -> Column:
    """One per sign that is no letter, digit or space, plus one per started six letters of a word."""
    small = F.replace(text, F.lit("\n\n"), F.lit("\n"))
    small = F.replace(F.replace(small, F.lit("```"), F.lit("`")), F.lit("##"), F.lit("#"))
    signs = F.regexp_count(small, F.lit(r"[^\p{L}\p{N} ]"))
    words = F.regexp_replace(small, r"[^\p{L}\p{N}\s]", "")
    return signs + F.regexp_count(words, F.lit(r"[\p{L}\p{N}]{1,6}"))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def context_limit_error(message: Column) -> Column:
    lowered = F.lower(message)
    return contains_any(lowered, CONTEXT_WORDS) & contains_any(lowered, LIMIT_WORDS)


def increment_step(step: Column) -> Column:
    text = strip(step.cast("string"))
    whole = text.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$")
    number = F.replace(text, F.lit("_"), F.lit("")).try_cast("bigint")
    return F.when(whole, (number + 1).cast("string")).otherwise(F.concat(step.cast("string"), F.lit("+1")))


DISCOVERIES = "\n\nPrevious Discoveries:"  # Fixed value: heading that splits an intent.


def split_intent(intent: Column) -> Column:
    """Struct of the goal and the discoveries part, heading included."""
    parts = F.split(intent, DISCOVERIES)
    found = F.size(parts) > 1
    rest = F.when(found, F.concat(F.lit(DISCOVERIES), F.get(parts, F.lit(1)))).otherwise(F.lit(""))
    return F.struct(F.get(parts, F.lit(0)).alias("goal"), rest.alias("discoveries"))


def thought_prompt_inputs(goal: Column, history: Column, page_state: Column, visible: Column) -> Column:
    """The inputs block of a thought prompt; missing inputs are empty."""
    def part(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"- {label}: "), F.coalesce(value, F.lit("")), F.lit("\n"))

    return F.concat(
        F.lit("Inputs:\n"), part("GOAL", goal), part("HISTORY", history),
        part("PAGE_STATE", page_state), part("VISIBLE_ELEMENTS", visible), F.lit("\n"),
    )
