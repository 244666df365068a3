"""Conversations: one row per turn, never one array per conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import actions as a
from trailmark.functions.text import increment_step, segments, token_estimate
from trailmark.plans.lineage import cut, store
from trailmark.plans.lookups import attach
from trailmark.plans.sequences import GroupSizes, Scan, framed, measure, numbered, running, settle

KEY = ["conv_id"]
ORDER = ["turn"]
OMITTED = "[NOTICE] {} messages are omitted."
TRUNCATED = "\n\n** Earlier trajectory has been truncated **\n\n"
PLACEHOLDER = "** Simplified html **"


def prefer_source(rows: DataFrame, key: str, priorities: dict[str, int], position: str) -> DataFrame:
    """One row per key: the source of the highest priority, inside a source the last line.

    Sources with a negative priority keep their first line instead.
    """
    rank = F.lit(None).cast("int")
    for name, value in priorities.items():
        rank = F.when(F.col("source") == name, value).otherwise(rank)
    known = rows.withColumn("_rank", rank).where(F.col("_rank").isNotNull())
    place = F.when(F.col("_rank") < 0, -F.col(position)).otherwise(F.col(position))
    best = F.max_by(F.struct(*rows.columns), F.struct(F.col("_rank"), place))
    return known.groupBy(key).agg(best.alias("_r")).select("_r.*")


def sized(turns: DataFrame, sizes: GroupSizes | None = None) -> GroupSizes:
    """Conversation sizes, measured once per operator; filters only make conversations smaller."""
    return sizes or measure(turns, KEY)


def drop_repeated_actions(turns: DataFrame, sizes: GroupSizes | None = None) -> DataFrame:
    """Agent messages whose action line came before, and the reply after each of them, are dropped.

    A reply is the next message that is not the agent's: it goes when an agent message was dropped since the
    last such message.
    """
    is_agent = F.col("role") == "agent"
    keyed = turns.withColumn("_key", F.when(is_agent, F.xxhash64(a.action_line(F.col("content")))))
    first = (
        keyed.where(F.col("_key").isNotNull())
        .groupBy(*KEY, "_key")
        .agg(F.min("turn").alias("_first"))
    )
    marked = attach(keyed, first, [*KEY, "_key"]).withColumn(
        "_dropped", F.coalesce(is_agent & (F.col("turn") > F.col("_first")), F.lit(False))
    )
    states = running(
        marked, KEY, ORDER,
        {
            "_last_drop": Scan("max", F.when(F.col("_dropped"), F.col("turn")), exclusive=True),
            "_last_reply": Scan("max", F.when(~is_agent, F.col("turn")), exclusive=True),
        },
        sized(turns, sizes),
    )
    orphan = ~is_agent & F.coalesce(F.col("_last_drop") > F.coalesce(F.col("_last_reply"), F.lit(-1)), F.lit(False))
    return states.where(~F.col("_dropped") & ~orphan).select(*turns.columns)


def turn_bounds(turns: DataFrame, sizes: GroupSizes) -> DataFrame:
    """Position of the turn and size of its conversation."""
    totals = turns.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_turns"))
    return attach(numbered(turns, KEY, ORDER, "pos", sizes), totals, KEY)


def keep_recent_messages(turns: DataFrame, budget: int = 3500) -> DataFrame:
    """Message 0, as the user's, and the newest messages whose segments stay below the budget.

    A kept tail never starts with a user message.  The first message says how many were left out.
    """
    sizes = sized(turns)
    placed = turn_bounds(turns, sizes).withColumn("_seg", segments(F.col("content")).cast("long"))
    placed = settle(placed, sizes)
    head = placed.where("pos = 1").select(*KEY, F.col("_seg").alias("_head"))
    tail_sum = running(
        placed.withColumn("_tail", F.when(F.col("pos") > 1, F.col("_seg")).otherwise(0)),
        KEY, ["-turn"], {"_back": Scan("sum", F.col("_tail"))}, sizes,
    )
    known = attach(tail_sum, head, KEY)
    fits = (F.col("pos") > 1) & (F.col("_head") + F.col("_back") < budget)
    kept = known.withColumn("_fits", fits)
    oldest = kept.where("_fits").groupBy(*KEY).agg(
        F.min("pos").alias("_start"), F.min_by("role", "pos").alias("_start_role")
    )
    bounded = attach(kept, oldest, KEY)
    start = F.when(F.col("_start_role") == "user", F.col("_start") + 1).otherwise(F.col("_start"))
    start = F.coalesce(start, F.col("n_turns") + 1)
    omitted = start - 2
    content = F.when(
        (F.col("pos") == 1) & (omitted > 0),
        F.concat(F.col("content"), F.lit("\n\n[NOTICE] "), omitted.cast("string"), F.lit(" messages are omitted.")),
    ).otherwise(F.col("content"))
    role = F.when(F.col("pos") == 1, F.lit("user")).otherwise(F.col("role"))
    return bounded.where((F.col("pos") == 1) | (F.col("pos") >= start)).select(
        *KEY, "turn", role.alias("role"), content.alias("content")
    )


def keep_head_tail(turns: DataFrame, head: int = 5, budget: int = 9776) -> DataFrame:
    """The first ``head`` messages, the last one, and message pairs backwards while the estimate fits.

    Estimates are summed per message.  ``truncated`` marks the first message after a gap.
    """
    sizes = sized(turns)
    placed = turn_bounds(turns, sizes).withColumn("_tok", token_estimate(F.col("content")).cast("long"))
    placed = settle(placed, sizes)
    last = F.col("pos") == F.col("n_turns")
    in_head = F.col("pos") <= head
    pair = F.floor((F.col("n_turns") - 1 - F.col("pos")) / 2)
    fixed = placed.groupBy(*KEY).agg(F.sum(F.when(in_head | last, F.col("_tok"))).alias("_fixed"))
    middle = ~in_head & ~last
    summed = running(
        placed.withColumn("_pair", F.when(middle, pair)),
        KEY, ["-turn"], {"_back": Scan("sum", F.when(F.col("_pair").isNotNull(), F.col("_tok")).otherwise(F.lit(0)))}, sizes,
    )
    pair_total = summed.where("_pair IS NOT NULL").groupBy(*KEY, "_pair").agg(F.max("_back").alias("_reach"))
    known = attach(summed.join(pair_total, [*KEY, "_pair"], "left"), fixed, KEY)
    keep = in_head | last | F.coalesce(F.col("_reach") + F.col("_fixed") <= budget, F.lit(False))
    kept = known.withColumn("_keep", keep)
    gaps = kept.where(~F.col("_keep") & F.col("_pair").isNotNull()).groupBy(*KEY).agg(F.max("pos").alias("_gap"))
    marked = attach(kept.where("_keep"), gaps, KEY)
    return marked.select(
        *KEY, "turn", "role", "content", F.coalesce(F.col("pos") == F.col("_gap") + 1, F.lit(False)).alias("truncated")
    )


def renumber_images(turns: DataFrame, has_image: Column) -> DataFrame:
    """File name of the k-th image message after turn 2, counted from 0."""
    wanted = F.when(has_image & (F.col("turn") > 2) & (F.col("role") != "agent"), 1).otherwise(0)
    counted = running(turns.withColumn("_flag", wanted), KEY, ORDER, {"_k": Scan("sum", F.col("_flag"))}, sized(turns))
    name = F.when(F.col("_flag") == 1, F.concat((F.col("_k") - 1).cast("string"), F.lit(".png")))
    return counted.withColumn("image", name).drop("_flag", "_k")


def conversation_rounds(turns: DataFrame, limit: int = 16384 - 512) -> DataFrame:
    """User/assistant rounds as rows: the first carries the task text, the last the observation.

    ``turns`` alternates states and answers; a round is one answer.  The last user message of a conversation
    is the current observation and is cut so that history and observation fit into ``limit``.
    """
    sizes = sized(turns)
    answers = turns.where("role = 'agent'")
    rounds = numbered(answers, KEY, ORDER, "_n", sizes).withColumn("round", F.col("_n") - 1)
    intent = turns.where("role = 'user'").groupBy(*KEY).agg(
        F.min_by("content", "turn").alias("intent"), F.max_by("content", "turn").alias("observation")
    )
    known = attach(rounds, intent, KEY)
    label = F.concat(F.lit("Round "), F.col("round").cast("string"), F.lit("\n"))
    user = F.when(
        F.col("round") == 0,
        F.concat(F.lit("Task Instruction: "), F.col("intent"), F.lit("\n\n"), label, F.col("intent")),
    ).otherwise(F.concat(label, F.lit(PLACEHOLDER)))
    history = known.select(*KEY, "round", user.alias("user"), F.col("content").alias("assistant"))
    totals = history.groupBy(*KEY).agg(
        F.sum(F.length("user") + F.length("assistant")).alias("_used"), F.max("round").alias("_last")
    )
    current = intent.join(totals, KEY, "left")
    room = F.greatest(F.lit(0), F.lit(limit) - F.coalesce(F.col("_used"), F.lit(0)))
    number = F.coalesce(F.col("_last") + 1, F.lit(0))
    cut = F.substring(F.col("observation"), F.lit(1), room.cast("int"))
    final = current.select(
        *KEY, number.alias("round"),
        F.concat(F.lit("Round "), number.cast("string"), F.lit("\n\n"), cut).alias("user"),
        F.lit(None).cast("string").alias("assistant"),
    )
    return history.unionByName(final)


def pair_failed_with_success(failed: DataFrame, success: DataFrame, key: str) -> DataFrame:
    """Failed runs with ``has_success``: whether a successful run of the same input exists."""
    known = success.select(key).distinct().withColumn("_ok", F.lit(True))
    paired = attach(failed, known, [key])
    return paired.withColumn("has_success", F.coalesce(F.col("_ok"), F.lit(False))).drop("_ok")


def edit_counts(turns: DataFrame, sizes: GroupSizes | None = None) -> DataFrame:
    """Successful edits per conversation: an edit call whose next message confirms it."""
    ahead = framed(
        turns, KEY, ORDER, {"_next": lambda w: F.lead("content").over(w)}, after=1, sizes=sized(turns, sizes)
    )
    done = (
        (F.col("role") == "agent") & F.col("content").contains("edit_rule")
        & F.coalesce(F.col("_next").contains("You have successfully edited the rule."), F.lit(False))
    )
    return ahead.groupBy(*KEY).agg(F.count_if(done).alias("edits"))


def stitch_conversations(failed: DataFrame, success: DataFrame, head: int = 3) -> DataFrame:
    """First ``head`` messages of a failed run followed by the successful run from message ``head`` on.

    Both sides are cleaned of repeated actions first; only inputs whose successful run holds more than one
    successful edit are stitched this way (``rebuild_conversations`` handles the others).
    """
    of_failed, of_success = sized(failed), sized(success)
    clean = settle(drop_repeated_actions(success, of_success), of_success)
    clean_failed = numbered(drop_repeated_actions(failed, of_failed), KEY, ORDER, "_pos", of_failed)
    clean_success = numbered(clean, KEY, ORDER, "_pos", of_success)
    rich = edit_counts(clean, of_success).where("edits > 1").select(*KEY)
    both = rich.join(failed.select(*KEY).distinct(), KEY, "left_semi").withColumn("_ok", F.lit(1))
    first = clean_failed.where(F.col("_pos") <= head).join(both, KEY).withColumn("part", F.lit("failed"))
    rest = attach(clean_success.where(F.col("_pos") > head), both, KEY, "inner").withColumn("part", F.lit("success"))
    return first.unionByName(rest).select(*KEY, "part", F.col("_pos").alias("pos"), "role", "content")


REVERT_THOUGHTS = (  # Fixed values: sentences put before an added revert.
    "I need to revert the previous action.",
    "The previous action did not fix the issue. I need to revert it.",
    "The previous action did not work. I need to revert it.",
    "The previous action did not solve the problem. I need to revert it.",
    "I need to revert the previous action. It did not work.",
    "I need to revert the previous action. It did not solve the problem.",
    "I need to revert the previous action. The previous action did not work.",
)


def revert_sentence(*keys: str) -> Column:
    """A sentence chosen by a hash of the keys, so that a rerun picks the same one."""
    choices = F.array(*[F.lit(text) for text in REVERT_THOUGHTS])
    return F.get(choices, F.pmod(F.xxhash64(*keys), F.lit(len(REVERT_THOUGHTS))).cast("int"))


def stitch_rebuilt(failed: DataFrame, success: DataFrame, head: int = 3, count_edits: int = 2) -> DataFrame:
    """Rebuilt failed runs followed by the successful run from message ``head`` on.

    For inputs whose successful run holds at most one successful edit, and whose failed run ends in an unanswered
    look at a selector of its edits; the other inputs are left out.  ``sub`` orders added messages after their call.
    """
    of_success = sized(success)
    clean = settle(drop_repeated_actions(success, of_success), of_success)
    poor = edit_counts(clean, of_success).where("edits <= 1").select(*KEY)
    rebuilt = rebuild_conversations(failed.join(poor, KEY, "left_semi"), count_edits, flagged_only=True)
    rebuilt = cut(rebuilt.select(*KEY, F.lit("failed").alias("part"), "pos", "sub", "role", "content"))
    rest = numbered(clean, KEY, ORDER, "pos", of_success).where(F.col("pos") > head)
    rest = rest.join(rebuilt.select(*KEY).distinct(), KEY, "left_semi")
    return rebuilt.unionByName(rest.select(*KEY, F.lit("success").alias("part"), "pos", F.lit(0).alias("sub"), "role", "content"))


def rebuild_conversations(turns: DataFrame, count_edits: int = 2, flagged_only: bool = False) -> DataFrame:
    """A failed run cut down to its first edits, each followed by its revert.

    Repeated actions are dropped first.  Messages then form pairs of an agent call and its reply.  Kept are:
    everything before the first agent message, edit calls until ``count_edits`` of them were confirmed by an
    image reply, the revert after such an edit (or an added one), and look-ups that mention the selector of
    one of the first ``count_edits + 1`` edits; of the other calls only the first.  A call without a reply is left
    out.  With ``flagged_only``, only runs whose last message is such a call that mentions a selector are rebuilt.
    """
    sizes = sized(turns)
    clean = settle(numbered(drop_repeated_actions(turns, sizes), KEY, ORDER, "_pos", sizes), sizes)
    is_agent = F.col("role") == "agent"
    nearby = framed(
        clean, KEY, ORDER,
        {
            "_next": lambda w: F.lead("content").over(w),
            "_next_role": lambda w: F.lead("role").over(w),
            "_after": lambda w: F.lead("content", 2).over(w),
            "_prev2": lambda w: F.lag("content", 2).over(w),
            "_prev": lambda w: F.lag("content").over(w),
        },
        before=2, after=2, sizes=sizes,
    )
    is_edit = is_agent & F.col("content").contains("edit_rule")
    confirmed = is_edit & F.coalesce(F.col("_next").contains("You have successfully edited the rule."), F.lit(False))
    flagged = settle(nearby, sizes).withColumn("_edit", is_edit).withColumn("_done", confirmed).withColumn(
        "_selector", F.when(is_edit, a.edit_selector(F.col("content")))
    )
    counted = running(
        flagged, KEY, ORDER,
        {
            "_done_before": Scan("sum", F.col("_done").cast("int"), exclusive=True),
            "_edits_seen": Scan("sum", F.col("_selector").isNotNull().cast("int")),
        },
        sizes,
    )
    counted = settle(counted, sizes)
    picked = counted.where(F.col("_selector").isNotNull() & (F.col("_edits_seen") <= count_edits + 1))
    # At most count_edits + 1 selectors per conversation reach this aggregate.
    selectors = picked.groupBy(*KEY).agg(F.collect_set("_selector").alias("_selectors"))
    known = attach(counted, selectors, KEY)
    names = F.coalesce(F.col("_selectors"), F.expr("cast(array() as array<string>)"))
    looks_up = F.col("content").contains("get_selectors_by_html_elements")
    text = F.when(looks_up, F.coalesce(F.col("_next"), F.lit(""))).otherwise(F.col("content"))
    related = F.exists(names, lambda s: F.instr(text, s) > 0)
    active = F.coalesce(F.col("_done_before"), F.lit(0)) < count_edits
    reverts_done = is_agent & F.col("content").contains("revert_last_edit") & F.coalesce(
        F.col("_prev2").contains("edit_rule") & F.col("_prev").contains("You have successfully edited the rule."),
        F.lit(False),
    )
    other = is_agent & ~is_edit & ~reverts_done & ~related & ~looks_up
    ranked = running(
        known.withColumn("_other", other), KEY, ORDER, {"_others": Scan("sum", F.col("_other").cast("int"))}, sizes
    )
    keep_call = is_agent & active & (is_edit | related | (F.col("_other") & (F.col("_others") <= 1)))
    keep_call = (keep_call & ~reverts_done) | (reverts_done & (F.coalesce(F.col("_done_before"), F.lit(0)) <= count_edits))
    answered = F.col("_next").isNotNull()
    ranked = settle(ranked, sizes)
    if flagged_only:
        open_end = is_agent & ~answered & active & ~is_edit & ~looks_up & related
        ranked = ranked.join(ranked.where(open_end).select(*KEY).distinct(), KEY, "left_semi")
    called = ranked.withColumn("_keep", keep_call & answered)
    replied = running(
        called, KEY, ORDER,
        {"_call_kept": Scan("last", F.when(F.col("role") == "agent", F.col("_keep").cast("int")), exclusive=True)},
        sizes,
    )
    kept = replied.where(F.when(F.col("role") == "agent", F.col("_keep")).otherwise(F.coalesce(F.col("_call_kept"), F.lit(1)) == 1))
    add_revert = F.col("_done") & ~F.coalesce(F.col("_after").contains("revert_last_edit"), F.lit(False)) & active
    thought = F.concat(F.lit("Thought: "), revert_sentence(*KEY, "_pos"), F.lit("\nAction: revert_last_edit()"))
    message = F.struct(F.lit(0).alias("sub"), F.col("_pos").alias("pos"), "role", "content")
    added = F.array(
        F.struct(F.lit(1).alias("sub"), (F.col("_pos") + 1).alias("pos"), F.lit("agent").alias("role"), thought.alias("content")),
        F.struct(F.lit(2).alias("sub"), (F.col("_pos") + 1).alias("pos"), F.lit("user").alias("role"),
                 F.lit("You have successfully reverted the last edit.").alias("content")),
    )
    rows = F.when(add_revert, F.concat(F.array(message), added)).otherwise(F.array(message))
    return kept.select(*KEY, F.explode(rows).alias("_m")).select(*KEY, "_m.*")


def next_step_records(steps: DataFrame, action: Column, thought: Column) -> DataFrame:
    """Each step as the record of the step after it, with a new chosen pair."""
    return steps.withColumn("step_id", increment_step(F.col("step_id"))).withColumn(
        "chosen", F.struct(thought.alias("thought"), action.alias("action"))
    )


def trace_rows(states: DataFrame) -> DataFrame:
    """Trace lines of a trajectory: state text, response, and the intent or a placeholder as prompt."""
    prompt = F.when(F.col("step") == 0, F.col("intent")).otherwise(PLACEHOLDER)
    return states.select(
        F.col("task_id").alias("trace_id"), F.col("step").alias("index"), prompt.alias("prompt"),
        F.col("observation").alias("html"), F.col("raw_prediction").alias("response"), F.col("intent").alias("target"),
    )


def stop_reasons(
    actions: DataFrame, order: list[str], max_steps: int = 30, parse: int = 3, repeat: int = 5, text: str | None = None
) -> DataFrame:
    """First step of every task at which the run should have stopped, with the reason.

    ``actions`` has task_id, step_no, action_type (null when parsing failed) and key.  Reasons: the step
    limit, ``parse`` failures in a row, ``repeat`` equal actions in a row, or a typing action seen ``repeat``
    times in all.  With ``text``, a column of action strings, equal strings in a row count whatever the
    action, and typing has no rule of its own.
    """
    needed = dict.fromkeys(["task_id", "step_no", "action_type", text or "key", *[o.lstrip("-") for o in order]])
    # Parsing is dear and the steps are read several times, so the few columns are stored once.
    rows = store(actions.select(*needed), "steps").withColumn("_old", F.lit(False))
    return first_stops(rows, None, order, max_steps, parse, repeat, text)


def first_stops(
    rows: DataFrame, typed: DataFrame | None, order: list[str], max_steps: int, parse: int, repeat: int, text: str | None = None
) -> DataFrame:
    """``stop_reasons`` of the rows that are not ``_old``.

    Old rows are the last ``max(parse, repeat) - 1`` steps before; ``typed`` (task_id, key, seen) counts the typing
    actions of all steps before.
    """
    key = text or "key"
    near = max(parse, repeat) - 1
    sizes = measure(rows, ["task_id"])
    failed = F.col("action_type").isNull()
    marked = framed(
        rows.withColumn("_failed", failed.cast("int")), ["task_id"], order,
        {
            "_fails": lambda w: F.sum("_failed").over(w.rowsBetween(-(parse - 1), 0)),
            "_same_min": lambda w: F.min(F.coalesce(key, F.lit(""))).over(w.rowsBetween(-(repeat - 1), 0)),
            "_same_max": lambda w: F.max(F.coalesce(key, F.lit(""))).over(w.rowsBetween(-(repeat - 1), 0)),
            "_window": lambda w: F.count(key).over(w.rowsBetween(-(repeat - 1), 0)),
        },
        before=near, sizes=sizes,
    ).where(~F.col("_old"))
    same = (F.col("_same_min") == F.col("_same_max")) & (F.col("_window") == repeat)
    if text is None:
        same = same & ~F.coalesce(F.col("action_type") == "TYPE", F.lit(False))
    reason = (
        F.when(F.col("step_no") >= max_steps, "max_steps")
        .when((F.col("_fails") >= parse) & (F.col("step_no") >= parse), "parse_failures")
        .when(same, "same_action")
    )
    hits = marked.withColumn("reason", reason).where("reason IS NOT NULL").select("task_id", "step_no", "reason")
    if text is None:
        hits = hits.unionByName(_typed_often(rows.where(~F.col("_old")), typed, order, repeat))
    priority = F.array_position(F.array(*[F.lit(x) for x in ("max_steps", "parse_failures", "same_action", "typing")]), F.col("reason"))
    return hits.groupBy("task_id").agg(
        F.min("step_no").alias("step_no"), F.min_by("reason", F.struct("step_no", priority)).alias("reason")
    )


def _typed_often(rows: DataFrame, typed: DataFrame | None, order: list[str], repeat: int) -> DataFrame:
    """First step of every task at which a typing action is seen for the ``repeat``-th time, earlier ones counted."""
    typing = rows.where("action_type = 'TYPE' AND key IS NOT NULL")
    # Only keys that are typed often enough are numbered.
    often = typing.groupBy("task_id", "key").agg(F.count(F.lit(1)).alias("_n"))
    if typed is None:
        often = often.withColumn("seen", F.lit(0))
    else:
        often = often.join(typed, ["task_id", "key"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    often = often.where(F.col("_n") + F.col("seen") >= repeat).select("task_id", "key", "seen")
    counted = numbered(typing.join(often, ["task_id", "key"]), ["task_id", "key"], order, "_at")
    reached = counted.where(F.col("_at") + F.col("seen") >= repeat)
    return reached.groupBy("task_id").agg(F.min("step_no").alias("step_no")).withColumn("reason", F.lit("typing"))


def trajectory_states(turns: DataFrame) -> DataFrame:
    """One row per agent action with the state text before it, numbered from 0, and the task's first text."""
    sizes = sized(turns)
    before = framed(turns, KEY, ORDER, {"observation": lambda w: F.lag("content").over(w)}, before=1, sizes=sizes)
    acted = numbered(before.where("role = 'agent'"), KEY, ORDER, "_n", sizes)
    intent = turns.groupBy(*KEY).agg(F.min_by("content", "turn").alias("intent"))
    known = attach(acted, intent, KEY)
    return known.select(
        F.col("conv_id").alias("task_id"), (F.col("_n") - 1).alias("step"), "observation",
        F.col("content").alias("raw_prediction"), "intent",
    )
