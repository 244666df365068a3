"""Trees against plain recursion: preorder numbers, wrappers, quoting."""

import random

from pyspark.sql import functions as F

from trailmark.operators import boxes as b
from trailmark.operators import trees as tr

NODES = "page_id long, node_id long, parent_id long, ord long, is_text boolean, plain boolean"


def random_tree(rng, page, size):
    """Nodes in any order; the first is the root."""
    ids = rng.sample(range(1_000), size)
    rows = [(page, ids[0], None, 0, False, False)]
    for at in range(1, size):
        parent = rng.choice([r for r in rows if not r[4]])
        rows.append((page, ids[at], parent[1], rng.randrange(10**6), rng.random() < 0.2, rng.random() < 0.8))
    return rows


def children(rows):
    own = {r[1]: [] for r in rows}
    for r in rows:
        if r[2] is not None:
            own[r[2]].append(r)
    return {k: [r[1] for r in sorted(v, key=lambda r: (r[3], r[1]))] for k, v in own.items()}


def walk(kids, node):
    yield node
    for child in kids[node]:
        yield from walk(kids, child)


def pruned(rows, listed):
    """Nodes from last to first in document order: those that go are replaced by their children."""
    facts, kids = {r[1]: r for r in rows}, children(rows)
    parent = {r[1]: r[2] for r in rows}
    root = rows[0][1]
    for node in list(walk(kids, root))[::-1]:
        _, _, _, _, text, plain = facts[node]
        above = parent[node]
        if above is None:
            continue
        keep = (above if text else node) in listed
        bare = plain and not text and not any(facts[c][4] for c in kids[node]) and len(kids[node]) <= 1
        if not keep or bare:
            at = kids[above].index(node)
            kids[above][at : at + 1] = kids[node]
            for child in kids[node]:
                parent[child] = above
    return [(node, parent[node]) for node in walk(kids, root)]


def test_pruning_with_wrappers_and_texts(spark):
    rng, rows, listed = random.Random(4), [], []
    pages = {page: random_tree(rng, page, rng.choice([1, 2, 8, 30, 60])) for page in range(40)}
    kept = {page: {r[1] for r in own if not r[4] and rng.random() < 0.75} for page, own in pages.items()}
    rows = [r for own in pages.values() for r in own]
    listed = [(page, node) for page, own in kept.items() for node in own]
    nodes = spark.createDataFrame(rows, NODES)
    ids = spark.createDataFrame(listed, "page_id long, node_id long")
    found = tr.prune_tree(nodes, ids, text=F.col("is_text"), plain=F.col("plain")).collect()
    for page, own in pages.items():
        got = [(r.node_id, r.new_parent) for r in sorted((r for r in found if r.page_id == page), key=lambda r: r.position)]
        assert got == pruned(own, kept[page])


def test_pruning_finds_the_document_order_once(spark, monkeypatch):
    calls, facts = [], tr.tree_facts
    monkeypatch.setattr(tr, "tree_facts", lambda *given: calls.append(1) or facts(*given))
    rows = random_tree(random.Random(5), 1, 40)
    ids = spark.createDataFrame([(1, r[1]) for r in rows if not r[4]], "page_id long, node_id long")
    found = tr.prune_tree(spark.createDataFrame(rows, NODES), ids, text=F.col("is_text"), plain=F.col("plain")).collect()
    assert [(r.node_id, r.new_parent) for r in sorted(found, key=lambda r: r.position)] == pruned(rows, {r[1] for r in rows if not r[4]})
    assert len(calls) == 1


def test_nearest_staying_nodes_of_chains_and_missing_parents(spark):
    rows = [(1, i, i - 1 if i else None, i == 0) for i in range(300)] + [(2, 5, 77, False), (2, 6, 5, False), (2, 7, 6, True)]
    found = tr.nearest_staying(spark.createDataFrame(rows, "page_id long, node_id long, parent_id long, stays boolean")).collect()
    assert {(r.page_id, r.node_id): r.near for r in found} == {(1, i): 0 for i in range(300)} | {(2, 5): None, (2, 6): None, (2, 7): 7}


def test_preorder_of_random_trees_and_a_long_chain(spark):
    rng = random.Random(9)
    pages = {page: random_tree(rng, page, rng.choice([1, 5, 70])) for page in range(12)}
    chain = [(99, i, i - 1 if i else None, 0, False, False) for i in range(20_000)]
    nodes = spark.createDataFrame([r for own in pages.values() for r in own] + chain, NODES)
    found = tr.preorder(*tr.tree_facts(nodes)).select("page_id", "node_id", "pre", "level").collect()
    for page, own in pages.items():
        order = [r.node_id for r in sorted((r for r in found if r.page_id == page), key=lambda r: r.pre)]
        assert order == list(walk(children(own), own[0][1]))
    assert all(r.pre == r.level == r.node_id for r in found if r.page_id == 99)


def test_cycles_and_missing_parents(spark):
    lost = spark.createDataFrame([(1, 1, None, 0, False, False), (1, 2, 7, 1, False, False), (1, 3, 2, 0, False, False)], NODES)
    found = {r.node_id: (r.level, r.pre) for r in tr.preorder(*tr.tree_facts(lost)).collect()}
    assert found == {1: (0, 0), 2: (0, 1), 3: (1, 2)}
    ring = spark.createDataFrame([(1, 1, 2, 0, False, False), (1, 2, 1, 0, False, False)], NODES)
    try:
        tr.tree_facts(ring)
    except ValueError:
        return
    raise AssertionError("a cycle went unseen")


def test_names_are_quoted_like_literals(spark):
    names = ["", "plain", "it's", 'say "x"', "it's \"x\"", "a\\b", "a\nb\tc\r", "\x00\x07\x7f", "é ü 中 😀", "\xa0​ ", "'", '"', "\\'"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    assert [r.q for r in df.select("i", tr.quoted(F.col("name")).alias("q")).orderBy("i").collect()] == [repr(n) for n in names]


def test_box_lines_hide_repeated_static_texts(spark):
    rows = [
        (1, 1, "DIV", True, None, "Buy "), (1, 2, "SPAN", False, None, "Buy"), (1, 3, "P", False, None, "Info"), (1, 4, "A", True, None, "Info"),
        (1, 5, "P", False, None, "Info"), (1, 6, "IMG", True, "Cat", None), (1, 7, "P", False, None, ".x{"), (1, 8, "B", True, None, ""),
    ]
    df = spark.createDataFrame(rows, "page_id int, id int, element string, interactable boolean, alt string, text_content string")
    df = df.selectExpr("*", "10D AS left", "10D AS top", "30D AS right", "30D AS bottom", "20D AS width", "20D AS height")
    lines = [r.line for r in b.text_lines(df, 0, 0, 100, 100).orderBy("id").collect()]
    assert lines == ["[1] [DIV] [Buy]", "[] [StaticText] [Info]", "[2] [A] [Info]", "[3] [IMG] [Cat]", "[4] [B] []"]
