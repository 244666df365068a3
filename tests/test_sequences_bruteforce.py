"""Goal relabelling against a plain loop over the same drawn gaps."""

from pyspark.sql import functions as F

from trailmark.operators import episodes as e


def test_random_goals_and_next_goal(spark):
    episodes = spark.createDataFrame([("a", 100), ("b", 7), ("c", 33)], "episode_id STRING, length BIGINT")
    low, high, seed = 5, 12, 3
    drawn = e.spread(episodes.withColumn("_n", F.lit(60).cast("long")), "_n", "i")
    gap = (low + F.floor(e.hash_fraction(seed, F.col("episode_id"), F.col("i")) * (high - low))).cast("long")
    gaps = {}
    for row in drawn.select("episode_id", "i", gap.alias("g")).collect():
        gaps.setdefault(row.episode_id, {})[row.i] = row.g
    want_goals, want_next = set(), set()
    for name, total in (("a", 100), ("b", 7), ("c", 33)):
        at, goals, i = 0, [], 0
        while at < total - 1:
            at += gaps[name][i]
            i += 1
            if total - at < low:
                at = total - 1
            goals.append(at)
        want_goals |= {(name, g) for g in goals}
        cursor = 0
        for t in range(total):
            want_next.add((name, t, goals[cursor]))
            if t == goals[cursor] + 1:
                cursor += 1
    goals = e.random_goals(episodes, low, high, seed)
    assert {tuple(r) for r in goals.collect()} == want_goals
    steps = e.spread(episodes, "length", "t").select("episode_id", "t")
    got = {tuple(r) for r in e.next_goal(steps, goals).select("episode_id", "t", "goal_t").collect()}
    # At the step after a goal the plain loop still shows that goal; the step is t = g + 1 in both.
    assert got == want_next


def test_chunks_cover_the_episode(spark):
    rows = [(str(n), n) for n in (14, 15, 16, 34, 35, 36, 55, 56)]
    episodes = spark.createDataFrame(rows, "episode_id STRING, length BIGINT")
    chunks = e.chunk_episodes(episodes, 20, 5).collect()
    assert {c.episode_id for c in chunks} == {"35", "36", "55", "56"}
    for name, n in rows:
        mine = [c for c in chunks if c.episode_id == name]
        if mine:
            assert set(range(15, n)) <= {t for c in mine for t in range(c.start, c.end)}
            assert all(c.end - c.start == 20 and c.end <= n for c in mine)
