"""Near-duplicate classes against brute force over all pairs of texts."""

import random
from collections import Counter

from trailmark.llm import neardup
from trailmark.llm.common import ascii_words

WORDS = [a + b for a in "ba be bi bo bu da de di do du".split() for b in "ka ke ki ko ku la le li lo lu".split()]
SCHEMA = "doc_id long, text string, class_id string"


def sentence(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def corpus():
    """Loose families (copies of copies), exact copies, a shared passage, short, empty and null texts."""
    rng, rows = random.Random(3), []
    for family in range(6):
        base = sentence(rng, 60 + 40 * family)
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randrange(1, 7)):
                text[rng.randrange(len(text))] = rng.choice(WORDS)
            rows.append(" ".join(text))
            if rng.random() < 0.3:
                base = text
    passage = sentence(rng, 40)
    rows += [" ".join(sentence(rng, 50) + passage + sentence(rng, 50)) for _ in range(40)]
    rows += [" ".join(sentence(rng, 120)) for _ in range(60)]
    rows += ["one two", "One, two!", "three", "", "", None, "...", "!", "a b c d e", "a b c d e f"]
    rows += rows[:5]
    rng.shuffle(rows)
    return [(i, t, "x") for i, t in enumerate(rows)]


def shingles(text):
    words = ascii_words(text)
    if not words:
        return None
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows, similarity=0.8):
    parent = {i: i for i, _, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingles(t) for i, t, _ in rows}
    texts = {i: t or "" for i, t, _ in rows}
    for i in sets:
        for j in sets:
            if j < i:
                a, b = sets[i], sets[j]
                if a is None or b is None:
                    same = a is b and texts[i] == texts[j]
                else:
                    same = sum((a & b).values()) >= similarity * sum((a | b).values())
                if same:
                    parent[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in parent}


def test_classes_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id: r for r in neardup.near_duplicates(docs, ["doc_id"]).collect()}
    expected = brute(rows)
    assert {i: r.class_id for i, r in found.items()} == expected
    sizes = Counter(expected.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.class_id == i) for i, r in found.items())


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """With blocks of a few members the same classes come out."""
    rows = corpus()
    monkeypatch.setattr(neardup.spanning_links, "__defaults__", (7,))
    found = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()
    assert {r.doc_id: r.class_id for r in found} == brute(rows)


def test_one_row_of_each_class_stays_with_its_columns(spark):
    rows = corpus() + [(None, "one two", "y"), (900, "repeated row here", "y"), (900, "repeated row here", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    kept = [r.doc_id for r in left.collect()]
    assert len(kept) == len(set(kept)) and None not in kept and 900 in kept
    assert {r.text for r in left.filter("text is null or text = ''").collect()} <= {None, ""}


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA), ["doc_id"]).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(5)
    base = sentence(rng, 400)
    other = base[:200] + sentence(rng, 200)
    made = neardup.weighted_elements([[w.encode() for w in t] for t in (base, other)])
    signature = neardup.signatures(*made)
    a, b = shingles(" ".join(base)), shingles(" ".join(other))
    exact = sum((a & b).values()) / sum((a | b).values())
    assert abs((signature[0] == signature[1]).mean() - exact) < 0.12
    assert (signature < 2**63).all()


def test_whole_rows_are_joined_once_by_number(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text if i % 3 else f"{text} tail{i // 30}") for i in range(90)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = neardup.drop_near_duplicates(docs)
    assert [r.doc_id for r in left.collect()] == [0]
    # One join of the whole rows, on their numbers.
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Join LeftAnti, (_row" in plan
