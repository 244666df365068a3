"""Node tables with parent pointers: preorder numbers, promotion, pruning, neighbourhoods and tournaments.

Every loop doubles the distance it has covered, so the number of rounds is the logarithm of the depth. The first loop
finds for every node its ancestors 1, 2, 4, ... steps up, its level and the size of its subtree (what hangs exactly so
far below is added up by the ancestor it leads to). A node stands behind its parent and the subtrees of its earlier
siblings; the second loop adds these places up along the path to the root, which gives preorder numbers. Rows hold numbers
only, whatever the depth. Each round is stored in the shared folder, so lost executors resume from the last round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from trailmark.functions.geometry import in_viewport, viewport_ratio
from trailmark.plans.lineage import cut, store
from trailmark.plans.lookups import attach
from trailmark.plans.sequences import Scan, measure, numbered, running

NODE = ["page_id", "node_id"]
# Roles whose nodes are left out when they have neither name nor properties.
EMPTY_ROLES = (
    "generic", "img", "list", "strong", "paragraph", "banner", "navigation", "Section", "LabelText",
    "Legend", "listitem",
)
# Properties that are not shown and do not count.
IGNORED_PROPERTIES = ("focusable", "editable", "readonly", "level", "settable", "multiline", "invalid")


def _stored(state: DataFrame) -> tuple[DataFrame, int, int]:
    """The stored rows, how many still have an ancestor to look up, and all; counted while they are written."""
    seen = Observation()
    state = store(state.observe(seen, F.count("up").alias("open"), F.count(F.lit(1)).alias("n")), "nodes")
    return state, seen.get["open"], seen.get["n"]


def _flag(column: Column | None, default: bool) -> Column:
    return F.coalesce(F.lit(default) if column is None else column, F.lit(False))


def _doubled(state: DataFrame, reach: int) -> DataFrame:
    """The facts of ``tree_facts`` over twice as many steps, given those over ``reach`` steps."""
    above = state.select(
        "page_id", F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("level").alias("_level"),
        F.col("sum").alias("_sum"), F.col("nearest").alias("_nearest"), F.lit(True).alias("_there"),
    )
    below = state.where("up IS NOT NULL").groupBy("page_id", F.col("up").alias("node_id")).agg(
        F.sum("size").alias("_size"), F.sum("weight").alias("_weight")
    )
    there = F.col("_there").isNotNull()
    return attach(attach(state, above, ["page_id", "up"]), below, NODE).select(
        *NODE, F.when(there, F.col("_up")).alias("up"), "top", "ord",
        F.when(there, F.concat("ups", F.array("up"))).otherwise(F.col("ups")).alias("ups"),
        F.when(there, F.col("_level") + reach).otherwise(F.col("level")).alias("level"),
        (F.col("size") + F.coalesce("_size", F.lit(0))).alias("size"),
        (F.col("sum") + F.coalesce("_sum", F.lit(0))).alias("sum"), "own",
        (F.col("weight") + F.coalesce("_weight", F.lit(0))).alias("weight"), F.coalesce("nearest", "_nearest").alias("nearest"),
    )


def tree_facts(
    nodes: DataFrame, counted: Column | None = None, marked: Column | None = None, weighed: Column | None = None
) -> tuple[DataFrame, int]:
    """Nodes with ``ups`` (the ancestors 1, 2, 4, ... steps up), ``level`` (0 for roots), ``above`` (ancestors for which
    ``counted`` holds) and ``weight`` (nodes of the subtree, itself included, for which ``weighed`` holds), stored; and the
    length that ``ups`` has at most.

    ``size`` counts the whole subtree. With ``marked`` also ``nearest``: the nearest node for which it holds, from the
    node itself upwards. A parent that is not in the table is none.
    """
    flag, weight = _flag(counted, True).cast("long"), _flag(weighed, True).cast("long")
    up = F.col("parent_id").cast("long")
    state = nodes.select(
        "page_id", F.col("node_id").cast("long").alias("node_id"), up.alias("up"), up.alias("top"), "ord",
        F.expr("cast(array() as array<bigint>)").alias("ups"), F.lit(0).cast("long").alias("level"), F.lit(1).cast("long").alias("size"),
        flag.alias("sum"), flag.alias("own"), weight.alias("weight"), F.when(_flag(marked, False), F.col("node_id").cast("long")).alias("nearest"),
    )
    rounds, open_rows, total = 0, 1, 1
    while open_rows:
        if 1 << rounds > 4 * total:
            raise ValueError("the parent pointers hold a cycle")
        # Two rounds a table: half the tables, and a round's plan is small.
        state, open_rows, total = _stored(_doubled(_doubled(state, 1 << rounds), 2 << rounds))
        rounds += 2
    facts = state.select(
        *NODE, F.when(F.size("ups") > 0, F.col("top")).alias("top"), "ord", "ups", "level", "size", "weight",
        (F.col("sum") - F.col("own")).alias("above"), "nearest",
    )
    return facts, rounds


def preorder(facts: DataFrame, rounds: int) -> DataFrame:
    """``tree_facts`` with ``pre``, the place of every node in document order from 0."""
    before = running(facts, ["page_id", "top"], ["ord", "node_id"], {"_before": Scan("sum", F.col("size"), exclusive=True)})
    own = F.coalesce("_before", F.lit(0)) + F.when(F.col("top").isNotNull(), 1).otherwise(0)
    state = before.select(*NODE, "ups", "level", "weight", "above", "nearest", own.alias("pre"))
    for step in range(rounds):
        far = state.select("page_id", F.col("node_id").alias("_up"), F.col("pre").alias("_pre"))
        placed = attach(state.withColumn("_up", F.get("ups", F.lit(step))), far, ["page_id", "_up"])
        state = placed.withColumn("pre", F.col("pre") + F.coalesce("_pre", F.lit(0))).drop("_up", "_pre")
        if step % 2 and step + 1 < rounds:
            state = store(state, "places")
    return state


def in_order(
    nodes: DataFrame, counted: Column | None = None, marked: Column | None = None, weighed: Column | None = None
) -> DataFrame:
    """The nodes with ``pre``, ``ups``, ``level``, ``above``, ``weight`` and ``nearest``."""
    return nodes.join(preorder(*tree_facts(nodes, counted, marked, weighed)), NODE)


def visible_node(width: float, height: float) -> Column:
    """Kept by the viewport rule: a box that is not empty and at least partly inside."""
    bound = F.col("bound")
    x, y, w, h = (F.get(bound, F.lit(i)) for i in range(4))
    ratio = viewport_ratio(x, y, w, h, width, height)
    return F.coalesce((w != 0) & (h != 0) & in_viewport(ratio), F.lit(False))


def promote_children(nodes: DataFrame, keep: Column) -> DataFrame:
    """Drop nodes that are not kept; their children move up to the nearest kept ancestor, in place.

    Roots always stay.  ``position`` numbers the kept nodes of a page in document order.
    """
    stays = F.coalesce(keep, F.lit(False)) | F.col("parent_id").isNull()
    flagged = nodes.withColumn("_keep", stays)
    placed = in_order(flagged, marked=F.col("_keep"))
    above = placed.select("page_id", F.col("node_id").alias("parent_id"), F.col("nearest").alias("new_parent"))
    # Sizes come from the raw nodes: measuring the derived rows would compute them twice.
    pages = measure(nodes, ["page_id"])
    kept = attach(placed.where("_keep"), above, ["page_id", "parent_id"])
    return numbered(kept, ["page_id"], ["pre"], "position", pages).select(*nodes.columns, "new_parent", "position")


def prune_tree(nodes: DataFrame, kept_ids: DataFrame, text: Column | None = None, plain: Column | None = None) -> DataFrame:
    """Only the listed nodes (and roots), children of removed nodes spliced upwards.

    ``text`` marks text nodes, which stay with their listed parents. ``plain`` marks nodes without attributes: a listed
    one without text children is a wrapper and goes, too, when at most one child is left below it.

    Of the children left below a wrapper, those stay that hold a solid node, one that is listed and no possible wrapper;
    so solid nodes are counted over subtrees, and no wrapper has to wait for those inside it.
    """
    listed = kept_ids.select(*NODE).distinct().withColumn("_listed", F.lit(True))
    marked = nodes.withColumn("_text", _flag(text, False)).withColumn("_plain", _flag(plain, False))
    marked = marked.join(listed, NODE, "left")
    parents = listed.select("page_id", F.col("node_id").alias("parent_id"), F.col("_listed").alias("_with"))
    marked = attach(marked, parents, ["page_id", "parent_id"])
    marked = marked.withColumn("_on", F.coalesce(F.when(F.col("_text"), F.col("_with")).otherwise(F.col("_listed")), F.lit(False)))
    if plain is None:
        return promote_children(marked, F.col("_on")).select(*nodes.columns, "new_parent", "position")
    texts = marked.where("_text").select("page_id", F.col("parent_id").alias("node_id")).distinct().withColumn("_holds", F.lit(True))
    marked = attach(marked, texts, NODE)
    wrapper = F.col("_on") & F.col("_plain") & ~F.col("_text") & F.col("parent_id").isNotNull() & F.col("_holds").isNull()
    marked = store(marked.withColumn("_wrapper", wrapper), "marked")
    solid = (F.col("_on") | F.col("parent_id").isNull()) & ~F.col("_wrapper")
    # The places in document order are found once; what goes next changes the nearest nodes above only.
    kept = F.col("_on") | F.col("parent_id").isNull()
    placed = in_order(marked.withColumn("_kept", kept), marked=F.col("_kept"), weighed=solid)
    placed = store(placed.select(*marked.columns, "_kept", "pre", "weight", "nearest"), "placed")
    above = placed.select("page_id", F.col("node_id").alias("parent_id"), F.col("nearest").alias("new_parent"))
    first = attach(placed.where("_kept").select(*NODE, "parent_id", "weight"), above, ["page_id", "parent_id"])
    left = first.where("weight > 0").groupBy("page_id", F.col("new_parent").alias("node_id")).agg(F.count(F.lit(1)).alias("_left"))
    bare = F.col("_wrapper") & (F.coalesce("_left", F.lit(0)) <= 1)
    stays = (F.col("_on") & ~bare) | F.col("parent_id").isNull()
    staying = attach(placed.select(*NODE, "parent_id", "_on", "_wrapper"), left, NODE)
    near = nearest_staying(staying.groupBy(*NODE).agg(F.min("parent_id").alias("parent_id"), F.max(stays).alias("stays")))
    above = placed.select(*NODE).join(near, NODE)
    above = above.select("page_id", F.col("node_id").alias("parent_id"), F.col("near").alias("new_parent"))
    left_over = placed.select(*nodes.columns, "pre").join(near.where("stays").select(*NODE), NODE, "left_semi")
    left_over = attach(left_over, above, ["page_id", "parent_id"])
    return numbered(left_over, ["page_id"], ["pre"], "position", measure(nodes, ["page_id"])).select(*nodes.columns, "new_parent", "position")


def nearest_staying(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, stays, near) of nodes (page_id, node_id, parent_id, stays) that come once: ``near`` is the nearest
    one that stays, from the node itself upwards."""
    own = F.col("node_id").cast("long")
    state = store(nodes.select(
        "page_id", own.alias("node_id"), "stays", F.when(~F.col("stays"), F.col("parent_id").cast("long")).alias("up"), F.when(F.col("stays"), own).alias("near"),
    ), "nodes")
    rounds, open_rows, total = 0, 1, 1
    while open_rows:
        if 1 << rounds > 4 * total:
            raise ValueError("the parent pointers hold a cycle")
        for _ in range(2):
            far = state.select("page_id", F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("near").alias("_near"))
            going = attach(state.where("up IS NOT NULL").drop("near"), far, ["page_id", "up"])
            going = going.select(*NODE, "stays", F.col("_up").alias("up"), F.col("_near").alias("near"))
            state = state.where("up IS NULL").unionByName(going)
        state, open_rows, total = _stored(state)
        rounds += 2
    return state.select(*NODE, "stays", "near")


def shown_properties() -> Column:
    """Properties with a value that are not among the ignored ones."""
    return F.filter(
        F.coalesce("properties", F.expr("cast(array() as array<struct<name:string,value:string>>)")),
        lambda p: ~p["name"].isin(*IGNORED_PROPERTIES) & p["value"].isNotNull(),
    )


def quoted(text: Column) -> Column:
    """A string in quotes, as the language of the sources shows it: single ones, double ones where only these do not occur
    in the text; backslashes, line ends, tabs and characters that cannot be printed are escaped."""
    mark = F.when(text.contains("'") & ~text.contains('"'), '"').otherwise("'")
    plain = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    plain = F.when(mark == "'", F.replace(plain, F.lit("'"), F.lit("\\'"))).otherwise(plain)
    for raw, short in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(raw), F.lit(short))

    def escaped(char: Column) -> Column:
        code = F.ascii(char)
        digits = F.lower(F.hex(code.cast("long")))
        made = (
            F.when(code < 256, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
            .when(code < 65536, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
            .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
        )
        return F.when(char.rlike(_UNPRINTED), made).otherwise(char)

    chars = F.regexp_extract_all(plain, F.lit("(?s)(.)"), 1)
    plain = F.when(plain.rlike(_UNPRINTED), F.array_join(F.transform(chars, escaped), "")).otherwise(plain)
    return F.concat(mark, plain, mark)


#: Control, format, unassigned and separating characters but the blank.
_UNPRINTED = r"[\p{C}\p{Z}&&[^ ]]"


def node_text() -> Column:
    """``[id] role 'name' prop: value …`` of a node."""
    props = F.array_join(F.transform(shown_properties(), lambda p: F.concat(p["name"], F.lit(": "), p["value"])), " ")
    head = F.concat(F.lit("["), F.col("node_id").cast("string"), F.lit("] "), F.col("role"), F.lit(" "), quoted(F.col("name")))
    return F.when(F.size(shown_properties()) > 0, F.concat(head, F.lit(" "), props)).otherwise(head)


def node_shown() -> Column:
    """Unnamed nodes of empty roles are not shown, unnamed list items never."""
    unnamed = F.trim("name") == ""
    bare = F.size(shown_properties()) == 0
    return ~(unnamed & ((bare & F.col("role").isin(*EMPTY_ROLES)) | (~bare & (F.col("role") == "listitem"))))


def render_tree(nodes: DataFrame) -> DataFrame:
    """Text lines of every page in document order, indented by the shown ancestors, one row per line."""
    placed = in_order(nodes, node_shown())
    pages = measure(nodes, ["page_id"])
    shown = numbered(placed.where(node_shown()), ["page_id"], ["pre"], "position", pages)
    line = F.concat(F.repeat(F.lit("\t"), F.col("above").cast("int")), node_text())
    return shown.select("page_id", "node_id", "position", line.alias("line"))


def _levels(start: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """Nodes reached over 1..rounds edges (page_id, from, to), with the start they were reached from."""
    front = start.select("page_id", F.col("node_id").alias("seed"), F.col("node_id").alias("at"))
    found = None
    for _ in range(rounds):
        front = front.join(edges.withColumnRenamed("from", "at"), ["page_id", "at"]).select(
            "page_id", "seed", F.col("to").alias("at")
        )
        found = front if found is None else found.unionByName(front)
    return found


def _all_ancestors(seeds: DataFrame, facts: DataFrame) -> DataFrame:
    """The seeds with all their ancestors: each round adds the nodes twice as far up, by the stored jumps."""
    found = seeds.select(*NODE).distinct()
    jumps = facts.agg(F.max(F.size("ups"))).first()[0] or 0
    for step in range(jumps):
        far = found.join(facts.where(F.size("ups") > step).select(*NODE, F.col("ups")[step].alias("_up")), NODE)
        found = store(found.unionByName(far.select("page_id", F.col("_up").alias("node_id"))).distinct(), "ancestors")
    return found


def keep_neighbourhood(
    nodes: DataFrame, keep: DataFrame, depth: int, children: int, siblings: int, rounds: int = 1,
    keep_parent: bool = False, text: Column | None = None,
) -> DataFrame:
    """Ids around the kept nodes: ancestors, first descendants in document order, and near siblings.

    All three limits shrink from round to round.  Siblings are met by their exact position, so a parent with
    many children yields no pairs beyond the range. ``text`` marks text nodes: they are descendants, but no siblings and
    have none. With ``keep_parent`` all ancestors of the nodes kept at first stay as well.
    """
    siblings_of = measure(nodes, ["page_id", "parent_id"])
    flagged = nodes.withColumn("_text", _flag(text, False))
    facts, steps = tree_facts(flagged)
    placed = flagged.join(preorder(facts, steps), NODE)
    placed = numbered(placed, ["page_id", "parent_id"], ["ord"], "idx", siblings_of)
    among = running(placed, ["page_id", "parent_id"], ["ord"], {"_nth": Scan("sum", F.when(F.col("_text"), 0).otherwise(1))}, siblings_of)
    paths = store(among.select(*NODE, "parent_id", "pre", "idx", F.when(~F.col("_text"), F.col("_nth")).alias("nth")), "places")
    up = paths.where("parent_id IS NOT NULL").select("page_id", F.col("node_id").alias("from"), F.col("parent_id").alias("to"))
    down = paths.where("parent_id IS NOT NULL").select(
        "page_id", F.col("parent_id").alias("from"), F.col("node_id").alias("to"), "idx"
    )
    asked = known = keep.select(*NODE).distinct().join(paths.select(*NODE), NODE, "left_semi")
    for _ in range(max(1, rounds)):
        ancestors = _levels(known, up, depth + 1).select("page_id", F.col("at").alias("node_id"))
        # A child behind more than ``children`` siblings cannot be among the first descendants, so every level
        # fans out by a bounded number, and the row limit is applied before the shuffle.
        near_children = down.where(F.col("idx") <= children).drop("idx")
        below = _levels(known, near_children, depth + 1).withColumnRenamed("at", "node_id")
        located = below.join(paths.select(*NODE, "pre"), NODE)
        order = Window.partitionBy("page_id", "seed").orderBy("pre")
        first = located.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= children).select(*NODE)
        here = known.join(paths.where("parent_id IS NOT NULL AND nth IS NOT NULL").select(*NODE, "parent_id", "nth"), NODE)
        offsets = F.explode(F.sequence(F.lit(-siblings), F.lit(siblings)))
        near = here.withColumn("_d", offsets).select("page_id", "parent_id", (F.col("nth") + F.col("_d")).alias("nth"))
        beside = near.distinct().join(paths.select(*NODE, "parent_id", "nth"), ["page_id", "parent_id", "nth"]).select(*NODE)
        known = store(known.select(*NODE).unionByName(ancestors).unionByName(first).unionByName(beside).distinct(), "kept")
        children, depth, siblings = int(children * 0.5), int(depth * 0.5), int(siblings * 0.7)
    if keep_parent:
        known = known.unionByName(_all_ancestors(asked, facts)).distinct()
    return known


def comment_descendants(comments: DataFrame) -> DataFrame:
    """Comments of every post with their level below the post and their place in reading order."""
    nodes = comments.select(
        F.col("post_id").alias("page_id"), F.col("comment_id").alias("node_id"), "parent_id", F.col("comment_id").alias("ord")
    )
    placed = preorder(*tree_facts(nodes))
    return placed.select(F.col("page_id").alias("post_id"), F.col("node_id").alias("comment_id"), "level", F.col("pre").alias("place"))


def parent_of_latest(comments: DataFrame) -> DataFrame:
    """Parent comment of the newest reply of every user in a post."""
    replies = comments.where(F.col("parent_id").isNotNull())
    newest = replies.groupBy("post_id", "username").agg(
        F.max_by(F.struct("comment_id", "parent_id"), F.struct("time", "comment_id")).alias("_c")
    )
    latest = newest.select("post_id", "username", F.col("_c.comment_id").alias("latest_id"), F.col("_c.parent_id").alias("parent_id"))
    parents = comments.select(
        "post_id", F.col("comment_id").alias("parent_id"), F.col("username").alias("parent_username"),
        F.col("content").alias("parent_content"),
    )
    return latest.join(parents, ["post_id", "parent_id"])


def pairwise_tournament(candidates: DataFrame, key: str, votes: Callable[[Column, Column], Column]) -> DataFrame:
    """Single elimination per ``key`` over candidates (key, pos from 0, cand, attr); the left one wins ties.

    ``votes`` maps the attributes of the left and the right candidate to 1, 0 or -1.  Neighbours meet, an odd
    last one moves on, and winners keep their order, so the next position is half the last one.  The number
    of rounds comes from the largest position.
    """
    top = candidates.agg(F.max("pos")).first()[0] or 0
    pool = candidates.select(key, F.col("pos").cast("long").alias("pos"), "cand", "attr", F.lit(0).alias("wins"))
    for done in range(int(top).bit_length()):
        slot = F.floor(F.col("pos") / 2)
        player = F.struct("cand", "attr", "wins")
        met = pool.groupBy(key, slot.alias("pos")).agg(
            F.min_by(player, "pos").alias("a"), F.max_by(player, "pos").alias("b"), F.count(F.lit(1)).alias("n")
        )
        first_wins = F.coalesce(votes(F.col("a.attr"), F.col("b.attr")), F.lit(0)) >= 0
        winner = F.when((F.col("n") == 1) | first_wins, F.col("a")).otherwise(F.col("b"))
        gained = F.when(F.col("n") == 2, 1).otherwise(0)
        pool = met.select(key, "pos", winner.alias("w"), gained.alias("g")).select(
            key, "pos", "w.cand", "w.attr", (F.col("w.wins") + F.col("g")).alias("wins")
        )
        if done % 4 == 3:
            pool = cut(pool)
    return pool.select(key, "cand", "wins")
