"""Recorded episodes: frames, goals, rewards, chunks and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.geometry import distance
from trailmark.plans.lookups import attach
from trailmark.plans.sequences import GroupSizes, Scan, framed, measure, numbered, running

EPISODE = ["episode_id"]
CLIP = 16
NONE_OFFSET = 15


def min_valid_length(chunk: int, gap: int) -> int:
    """Shortest usable episode: a whole clip, and a chunk or a goal gap after the offset."""
    return max(CLIP, chunk + NONE_OFFSET, gap + NONE_OFFSET)


def valid_episodes(episodes: DataFrame, chunk: int, gap: int) -> DataFrame:
    return episodes.where(F.col("length") >= min_valid_length(chunk, gap))


def dataset_frames(episodes: DataFrame, chunk: int, gap: int) -> DataFrame:
    return valid_episodes(episodes, chunk, gap).groupBy().agg(
        F.count(F.lit(1)).alias("episodes"), F.coalesce(F.sum("length"), F.lit(0)).alias("frames")
    )


def chunk_episodes(episodes: DataFrame, chunk: int, gap: int) -> DataFrame:
    """Chunks of ``chunk`` timesteps from the offset on; the last one is moved back to end at the length."""
    usable = valid_episodes(episodes, chunk, gap)
    pieces = F.ceil((F.col("length") - NONE_OFFSET) / chunk).cast("long")
    flat = spread(usable.select("episode_id", "length").withColumn("_n", pieces), "_n", "_i")
    start = F.least(NONE_OFFSET + F.col("_i") * chunk, F.col("length") - chunk)
    return flat.select("episode_id", start.alias("start"), (start + chunk).alias("end"))


def length_mismatch(frames: DataFrame, actions: DataFrame, embeddings: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episodes whose stored length differs from one of the three component counts."""

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("episode_id").agg(F.count(F.lit(1)).alias(name))

    joined = episodes.select("episode_id", "length")
    for rows, name in ((frames, "frames"), (actions, "actions"), (embeddings, "embeddings")):
        joined = joined.join(counted(rows, name), "episode_id", "left")
    zero = F.lit(0)
    filled = joined.select(
        "episode_id", "length", *[F.coalesce(n, zero).alias(n) for n in ("frames", "actions", "embeddings")]
    )
    same = (F.col("frames") == F.col("actions")) & (F.col("actions") == F.col("embeddings")) & (
        F.col("frames") == F.col("length")
    )
    return filled.where(~same)


def next_goal(steps: DataFrame, goals: DataFrame) -> DataFrame:
    """Each timestep with the first goal ``g`` such that ``t <= g + 1``.

    Goals and steps are laid on one axis and scanned backwards with a running minimum: one shuffle, no
    range join.
    """
    rest = [c for c in steps.columns if c not in ("episode_id", "t")]
    empty = [F.lit(None).cast(steps.schema[c].dataType).alias(c) for c in rest]
    on_axis = steps.select("episode_id", "t", *rest, F.lit(None).cast("long").alias("_g"), F.col("t").cast("long").alias("_at"), F.lit(1).alias("_kind"))
    marks = goals.select(
        "episode_id", F.lit(None).cast(steps.schema["t"].dataType).alias("t"), *empty,
        F.col("goal_t").cast("long").alias("_g"), (F.col("goal_t") + 1).cast("long").alias("_at"), F.lit(0).alias("_kind"),
    )
    axis = on_axis.unionByName(marks)
    found = running(axis, EPISODE, ["-_at", "_kind"], {"goal_t": Scan("min", F.col("_g"))})
    return found.where("_kind = 1").select("episode_id", "t", *rest, "goal_t")


def spread(rows: DataFrame, count: str, name: str, block: int = 65_536) -> DataFrame:
    """Rows repeated ``count`` times with ``name`` from 0 on, expanded in two steps of bounded arrays."""
    blocks = rows.where(F.col(count) > 0).withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / block)))
    )
    inside = F.least(F.lit(block), F.col(count) - F.col("_b") * block)
    return blocks.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), inside.cast("long") - 1))).select(
        *rows.columns, (F.col("_b") * block + F.col("_i")).alias(name)
    )


def hash_fraction(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only: 32 bits of an MD5, which any engine can repeat."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / 2.0**32


def random_goals(episodes: DataFrame, low: int, high: int, seed: int) -> DataFrame:
    """Goal timesteps with gaps drawn from [low, high); the last goal is the last timestep."""
    tries = F.ceil(F.col("length") / low).cast("long")
    drawn = spread(episodes.select("episode_id", "length").withColumn("_n", tries), "_n", "i")
    gap = (low + F.floor(hash_fraction(seed, F.col("episode_id"), F.col("i")) * (high - low))).cast("long")
    summed = running(drawn.withColumn("_gap", gap), EPISODE, ["i"], {"goal_t": Scan("sum", F.col("_gap"))})
    inner = summed.where(F.col("length") - F.col("goal_t") >= low).select("episode_id", "goal_t")
    return inner.unionByName(episodes.select("episode_id", (F.col("length") - 1).cast("long").alias("goal_t")))


def relabel_goals(
    episodes: DataFrame, embeddings: DataFrame, low: int, high: int, p_uncond: float, seed: int
) -> DataFrame:
    """Every timestep with its next goal's embedding; whole episodes are nulled with probability ``p_uncond``."""
    steps = spread(episodes.select("episode_id", "length"), "length", "t").select("episode_id", "t")
    placed = next_goal(steps, random_goals(episodes, low, high, seed))
    vectors = embeddings.select("episode_id", F.col("t").alias("goal_t"), "embedding")
    joined = placed.join(vectors, ["episode_id", "goal_t"], "left")
    nulled = hash_fraction(seed + 1, F.col("episode_id")) < p_uncond
    return joined.withColumn("embedding", F.when(~nulled, F.col("embedding")))


def split_by_frames(episodes: DataFrame, train: int, val: int, order: str) -> DataFrame:
    """Fill train and then val to a frame budget in the order of ``order``; the crossing episode is kept.

    The running total over the whole table is computed on blocks of ``order``, not in one task.
    """
    summed = running(episodes, [], [order, "episode_id"], {"_cum": Scan("sum", F.col("length"))})
    in_train = F.col("_cum") - F.col("length") < train
    used = summed.where(in_train).groupBy().agg(F.max("_cum")).scalar()
    in_val = F.col("_cum") - F.coalesce(used, F.lit(0)) - F.col("length") < val
    part = F.when(in_train, "train").when(in_val, "val")
    return summed.withColumn("part", part).where(F.col("part").isNotNull()).select("episode_id", "length", "part")


def mixture(episodes: DataFrame, shares: dict[str, float], total: int, order: str) -> DataFrame:
    """First frames of every dataset up to ``int(share * total)``; the crossing episode is kept."""
    budget = F.lit(None).cast("long")
    for name, share in shares.items():
        budget = F.when(F.col("dataset") == name, int(share * total)).otherwise(budget)
    summed = running(episodes, ["dataset"], [order, "episode_id"], {"_cum": Scan("sum", F.col("length"))})
    return summed.where((F.col("_cum") - F.col("length") < budget) & (budget > 0)).select("dataset", "episode_id", "length")


def sliding_clips(frames: DataFrame, value: str, size: int = CLIP) -> DataFrame:
    """All windows of ``size`` consecutive frames; the first ``size - 1`` timesteps end none."""
    out = framed(
        frames, EPISODE, ["t"], {"clip": lambda w: F.collect_list(value).over(w.rowsBetween(-(size - 1), 0))},
        before=size - 1,
    )
    return out.where(F.size("clip") == size).select("episode_id", "t", "clip")


def nstep_transitions(frames: DataFrame, n: int, gamma: float) -> DataFrame:
    """Observation ``n - 1`` rows back, the current one, and the discounted sum of the rewards between."""
    out = framed(
        frames, EPISODE, ["t"],
        {
            "obs": lambda w: F.lag("obs_id", n - 1).over(w),
            "_rewards": lambda w: F.collect_list("reward").over(w.rowsBetween(-(n - 1), 0)),
        },
        before=n - 1,
    )
    weighted = F.transform("_rewards", lambda r, i: r * F.pow(F.lit(gamma), i))
    total = F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x)
    return out.where(F.size("_rewards") == n).select(
        "episode_id", "t", "obs", F.col("obs_id").alias("next_obs"), total.alias("n_step_return"),
        (F.col("t") + 1 - n).alias("index"),
    )


def item_name(name: Column) -> Column:
    bare = F.regexp_replace(name, "^minecraft:", "")
    return F.when(bare == "log2", "log").otherwise(bare)


def rewarded_changes(changes: DataFrame, rewards: dict[str, float]) -> DataFrame:
    """Positive changes of rewarded items."""
    reward = F.lit(None).cast("double")
    for name, value in rewards.items():
        reward = F.when(F.col("item") == name, float(value)).otherwise(reward)
    named = changes.withColumn("item", item_name(F.col("item"))).withColumn("reward", reward)
    return named.where(F.col("reward").isNotNull() & (F.col("change") > 0))


def collect_reward(changes: DataFrame, rewards: dict[str, float]) -> DataFrame:
    """Sum of positive change times item reward per episode."""
    hits = rewarded_changes(changes, rewards)
    return hits.groupBy("episode_id").agg(F.sum(F.col("change") * F.col("reward")).alias("reward"))


def reward_once(changes: DataFrame, rewards: dict[str, float]) -> DataFrame:
    """First positive change of every item in an episode."""
    hits = rewarded_changes(changes, rewards)
    return hits.groupBy("episode_id", "item").agg(F.min("t").alias("t"), F.first("reward").alias("reward"))


def touch_reward(touches: DataFrame, blocks: list[tuple[str, float, str]]) -> DataFrame:
    """Reward per timestep for touched blocks whose name contains a type; ``onlyOnce`` fires once per episode."""
    table = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(float(value)).alias("value"), F.lit(how).alias("how"))
        for kind, value, how in blocks
    ])
    pairs = touches.select("episode_id", "t", "ord", "block", F.explode(table).alias("b"))
    hits = pairs.where(F.instr(F.col("block"), F.col("b.kind")) > 0).select("episode_id", "t", "ord", "b.*")
    many = hits.where("how <> 'onlyOnce'").select("episode_id", "t", "value")
    once = hits.where("how = 'onlyOnce'").groupBy("episode_id", "kind").agg(
        F.min_by(F.struct("t", "value"), F.struct("t", "ord")).alias("_f")
    )
    fired = many.unionByName(once.select("episode_id", "_f.t", "_f.value"))
    return fired.groupBy("episode_id", "t").agg(F.sum("value").alias("reward"))


def distance_reward(positions: DataFrame, order: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Previous minus current distance to the target; 0 without a previous one or when it was 0."""
    here = positions.withColumn("_d", distance(*[(F.col(a), F.col(b)) for a, b in pairs]))
    out = framed(here, EPISODE, order, {"_p": lambda w: F.lag("_d").over(w)}, before=1)
    known = F.coalesce(F.col("_p"), F.lit(0.0))
    return out.withColumn("reward", F.when(known == 0, F.lit(0.0)).otherwise(F.col("_p") - F.col("_d"))).drop("_p", "_d")


def milestone_reward(steps: DataFrame, goals: dict[str, float], order: list[str]) -> DataFrame:
    """Per step, the rewards of all goals reached so far: each goal adds its reward once, then it stays."""
    reward = F.lit(0.0)
    for name, value in goals.items():
        reward = F.when(F.col("goal") == name, float(value)).otherwise(reward)
    sizes = measure(steps, EPISODE)
    first = (
        steps.where(F.col("reached") & F.col("goal").isin(*goals))
        .groupBy("episode_id", "goal")
        .agg(F.min(F.struct(*order)).alias("_first"))
    )
    joined = steps.join(first, ["episode_id", "goal"], "left")
    gained = F.when(F.struct(*order) == F.col("_first"), reward).otherwise(F.lit(0.0))
    out = running(joined.withColumn("_gain", gained), EPISODE, order, {"reward": Scan("sum", F.col("_gain"))}, sizes)
    return out.drop("_gain", "_first")


def unstick_attack(events: DataFrame) -> DataFrame:
    """Without button 0 while it is stuck: from a first row that presses only it to the next press of it."""
    first = events.groupBy("episode_id").agg(
        F.min("t").alias("_t0"), F.min_by(F.col("new_buttons") == F.array(F.lit(0)), "t").alias("_stuck")
    )
    known = attach(events, first, EPISODE)
    release = (
        known.where((F.col("t") > F.col("_t0")) & F.array_contains("new_buttons", 0))
        .groupBy("episode_id")
        .agg(F.min("t").alias("_until"))
    )
    timed = attach(known, release, EPISODE)
    stuck = F.col("_stuck") & (F.col("_until").isNull() | (F.col("t") < F.col("_until")))
    buttons = F.when(F.coalesce(stuck, F.lit(False)), F.array_remove("buttons", 0)).otherwise(F.col("buttons"))
    return timed.withColumn("buttons", buttons).select(*events.columns)


def hotbar_change(events: DataFrame) -> DataFrame:
    """Name of the newly selected slot where it differs from the one before (0 at the start)."""
    out = framed(events, EPISODE, ["t"], {"_p": lambda w: F.lag("hotbar", 1, 0).over(w)}, before=1)
    slot = F.concat(F.lit("hotbar."), (F.col("hotbar") + 1).cast("string"))
    return out.withColumn("selected", F.when(F.col("hotbar") != F.col("_p"), slot)).drop("_p")


def stalled(steps: DataFrame, sizes: GroupSizes | None = None) -> DataFrame:
    """Steps (task_id, step_no, reward, action, result) at which a household run counts as stuck, with the rule."""
    sizes = sizes or measure(steps, ["task_id"])
    made = {f"_r{k}": (lambda w, k=k: F.lag("reward", k).over(w)) for k in (1, 8, 9, 10)}

    def same(column: str, size: int):
        def build(w):
            frame = w.rowsBetween(-(size - 1), 0)
            return F.min(column).over(frame) == F.max(column).over(frame)
        return build

    made.update({
        "_reward5": same("reward", 5), "_result3": same("result", 3), "_action4": same("action", 4),
        "_action6": same("action", 6),
    })
    out = framed(steps, ["task_id"], ["step_no"], made, before=10, sizes=sizes)
    first = steps.groupBy("task_id").agg(F.min_by("reward", "step_no").alias("_r0"))
    known = attach(out, first, ["task_id"])
    reward, done = F.col("reward"), F.col("step_no") - 1
    below = (reward <= F.col("_r1")) & (reward <= F.col("_r8")) & (reward <= F.col("_r9")) & (reward <= F.col("_r10"))
    turning = F.col("action").contains("turn")
    rule = (
        F.when((done >= 40) & below, "no_progress")
        .when((done >= 30) & F.col("_reward5") & (reward <= F.col("_r0")), "flat_reward")
        .when((F.col("step_no") >= 4) & F.col("_result3") & F.col("_action4") & ~turning, "same_action")
        .when((F.col("step_no") >= 6) & F.col("_action6") & turning, "same_turn")
    )
    return known.withColumn("rule", rule).where("rule IS NOT NULL").select("task_id", "step_no", "rule")


def every_nth(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """Every n-th row of the whole table, the first one included."""
    return numbered(rows, [], order, "_n").where((F.col("_n") - 1) % n == 0).drop("_n")
