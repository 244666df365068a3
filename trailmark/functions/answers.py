"""Answer checks: each returns 1.0 or 0.0 as the score of one clause."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions.text import let, strip

# A token: a word, kept whole across inner / . , or -, or any single other sign.
TOKEN = r"[\p{L}\p{N}_]+(?:[/.,-][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]"
ALTERNATIVES = r" \|OR\| "


def clean_answer(answer: Column) -> Column:
    """Without one pair of equal quotes around it, in lower case."""
    inner = F.when(
        (answer.startswith("'") & answer.endswith("'")) | (answer.startswith('"') & answer.endswith('"')),
        F.when(F.length(answer) < 2, F.lit("")).otherwise(
            F.substring(answer, F.lit(2), F.length(answer) - 2)
        ),
    ).otherwise(answer)
    return F.lower(inner)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def exact_match(reference: Column, answer: Column) -> Column:
    return (clean_answer(answer.cast("string")) == clean_answer(reference)).cast("double")


def must_include(reference: Column, answer: Column) -> Column:
    return included(clean_answer(reference), clean_answer(answer))


def included(ref: Column, given: Column) -> Column:
    """``must_include`` over cleaned texts. Tokens are looked at only where the text holds the reference."""

    def check(one: Column) -> Column:
        as_token = F.exists(tokens(given), lambda w: (w == one) | F.array_contains(F.split(w, "/"), one))
        return (given.contains(one) & ((F.size(tokens(one)) != 1) | as_token)).cast("double")

    return let(ref, check)


def must_exclude(reference: Column, answer: Column) -> Column:
    return excluded(clean_answer(reference), clean_answer(answer))


def excluded(ref: Column, given: Column) -> Column:
    """``must_exclude`` over cleaned texts; tokens are not split at slashes here."""

    def check(one: Column) -> Column:
        as_token = F.array_contains(tokens(given), one)
        return (~(given.contains(one) & ((F.size(tokens(one)) != 1) | as_token))).cast("double")

    return let(ref, check)


def one_of(options: Column, answer: Column) -> Column:
    """``options`` is an array of references, ``answer`` the cleaned answer."""
    return F.exists(options, lambda o: answer.contains(clean_answer(o))).cast("double")


def str_to_int(text: Column) -> Column:
    digits = F.replace(strip(text), F.lit(","), F.lit(""))
    return F.when(digits.rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"),
                  strip(F.replace(digits, F.lit("_"), F.lit(""))).try_cast("bigint"))


def _satisfies_one(value: Column, rule: Column, tol: float) -> Column:
    def number(op: str) -> Column:
        return strip(F.get(F.split(rule, op), F.lit(1))).try_cast("double")

    return (
        F.when(rule.contains("<="), value <= number("<=") + tol)
        .when(rule.contains(">="), value >= number(">=") - tol)
        .when(rule.contains("=="), F.abs(value - number("==")) <= tol)
        .when(rule.contains("<"), value < number("<") + tol)
        .when(rule.contains(">"), value > number(">") - tol)
    )


def satisfies(value: Column, rule: Column, tol: float = 1e-8) -> Column:
    """True when one alternative of ``rule`` holds; strict bounds are tolerant as well."""
    return F.exists(F.split(rule, ALTERNATIVES), lambda one: _satisfies_one(value, one, tol))


def any_alternative(check, clause: Column, answer: Column) -> Column:
    """Best score of ``check`` over the alternatives of one clause."""
    return F.array_max(F.transform(F.split(clause, ALTERNATIVES), lambda one: check(one, answer)))


def fuzzy_verdict(response: Column) -> Column:
    """Score of a stored similarity verdict; null when it says neither."""
    text = F.lower(response)
    return (
        F.when(text.contains("partially correct") | text.contains("incorrect"), F.lit(0.0))
        .when(text.contains("correct"), F.lit(1.0))
    )


def unachievable_verdict(response: Column) -> Column:
    text = F.lower(response)
    return F.when(text.contains("different"), F.lit(0.0)).when(text.contains("same"), F.lit(1.0))


def pairwise_vote(response: Column) -> Column:
    """1 for the first response, -1 for the second, 0 for none."""
    tagged = F.nullif(F.regexp_extract(response, r"(?i)<Answer>\s*Response\s*([12])\s*</Answer>", 1), F.lit(""))
    plain = F.nullif(F.regexp_extract(response, r"(?i)Response\s*([12])", 1), F.lit(""))
    winner = F.coalesce(tagged, plain)
    return F.when(winner == "1", 1).when(winner == "2", -1).otherwise(0)


def parse_judgement(text: Column) -> Column:
    """Typed verdict of a stored judge reply; broken JSON gives ``parse_error`` and the raw text."""
    schema = (
        "is_reasonable BOOLEAN, category STRING, confidence DOUBLE, reason STRING, "
        "flow_analysis STRING, _broken STRING"
    )
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    broken = parsed.isNull() | parsed["_broken"].isNotNull()

    def field(name: str, default) -> Column:
        return F.when(~broken, F.coalesce(parsed[name], F.lit(default))).alias(name)

    return F.struct(
        field("is_reasonable", False), field("category", "unknown"), field("confidence", 0.0),
        field("reason", ""), field("flow_analysis", ""),
        broken.alias("parse_error"), F.when(broken, text).alias("raw"),
    )
