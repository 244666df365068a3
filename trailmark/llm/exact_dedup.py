"""Exact duplicates by block naming: equal texts, and only those, end with the same integer name.

A text is read as UTF-8 with A-Z lower-cased; null is the empty text. It is cut into blocks of ``BLOCK`` bytes (the last may
be shorter, an empty text is one empty block). Level 0 sorts the blocks: a block's name is the place of the first block equal
to it in the sorted partition that its hash leads to. Every further level does the same with pairs of adjacent names (a name
without a neighbour is paired with -1), so a text of b blocks has one name after ceil(log2 b) levels. Names are compared in
full at each level, never by a hash, so (level, name) is equal exactly for equal texts.

Texts leave the scan once: a task names its blocks by numbers of its own and hands on each distinct block once for every
``HELD_BYTES`` of blocks, so a block that stands in a third of the documents is shuffled a few times a task. All later
tables hold integers. Hot names meet in joins that adaptive execution splits.

Rows keep their columns, so null ids and repeated rows are rows of their own: of equal texts the row with the largest id
stays (nulls are smallest); of rows with the same id any one. A kept column named like a result column is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import map_batches, slices
from trailmark.plans.lineage import store

#: Bytes of a block; bytes and rows after which a task forgets the blocks that it has handed on.
BLOCK, HELD_BYTES, HELD_ROWS = 4_096, 16_000_000, 50_000
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _cut(docs: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """One row per document (``row``, ``_row``, ``text_sha256``, ``places``: keys of its blocks) and one per block (``key``, ``block``); stored."""
    rows = docs.select(F.struct(F.lit(0).alias("_"), *keep).alias("_row"), F.col(text).cast("binary").alias("_text"))
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("_row", rows.schema["_row"].dataType), T.StructField("text_sha256", T.StringType()),
        T.StructField("places", T.ArrayType(T.LongType())), T.StructField("key", T.LongType()), T.StructField("block", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 33
        held: dict[bytes, int] = {}
        n_rows = n_keys = held_bytes = held_rows = 0
        for batch in batches:
            for part in slices(batch, "_text"):
                digests, places, keys, fresh = [], [], [], []
                for body in part.column("_text").to_pylist():
                    body = (body or b"").translate(_FOLD)
                    digests.append(hashlib.sha256(body).hexdigest())
                    own = []
                    for at in range(0, max(len(body), 1), BLOCK):
                        block = body[at : at + BLOCK]
                        key = held.get(block)
                        if key is None:
                            key = held[block] = task + n_keys
                            n_keys += 1
                            held_bytes += len(block)
                            keys.append(key)
                            fresh.append(block)
                        own.append(key)
                    places.append(own)
                n, m = part.num_rows, len(keys)
                numbers = pa.array(range(task + n_rows, task + n_rows + n), pa.int64())
                names = schema.names
                yield pa.RecordBatch.from_arrays([
                    numbers, part.column("_row"), pa.array(digests, pa.string()), pa.array(places, pa.list_(pa.int64())),
                    pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
                ], names=names)
                if m:
                    yield pa.RecordBatch.from_arrays([
                        pa.nulls(m, pa.int64()), pa.nulls(m, part.column("_row").type), pa.nulls(m, pa.string()),
                        pa.nulls(m, pa.list_(pa.int64())), pa.array(keys, pa.int64()), pa.array(fresh, pa.binary()),
                    ], names=names)
                n_rows += n
                held_rows += n
                if held_bytes > HELD_BYTES or held_rows > HELD_ROWS:
                    held, held_bytes, held_rows = {}, 0, 0

    return store(map_batches(rows, run, schema), "blocks")


def name_blocks(blocks: DataFrame) -> DataFrame:
    """(key, name): the sorted place of each key's block; equal blocks share the first one's."""
    placed = blocks.repartition("block").sortWithinPartitions("block").withColumn("_at", F.monotonically_increasing_id())
    return placed.select("key", F.min("_at").over(Window.partitionBy("block")).alias("name"))


def name_pairs(current: DataFrame) -> DataFrame:
    """(row, n, idx, name) of the next level: adjacent names of a row are paired, and the distinct pairs are named in sorted order."""
    even = F.col("idx") % 2 == 0
    pairs = current.groupBy("row", "n", F.shiftright("idx", 1).alias("half")).agg(
        F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right")
    )
    names = pairs.select("left", "right").distinct().sortWithinPartitions("left", "right").withColumn("name", F.monotonically_increasing_id())
    halved = F.shiftright(F.col("n") + 1, 1).alias("n")
    return pairs.join(names, ["left", "right"]).select("row", halved, F.col("half").alias("idx"), "name")


def name_documents(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``row`` (a number), ``_row`` (a struct of columns ``keep``), ``text_sha256``, ``level`` and ``name`` of every row; stored.

    (level, name) is equal exactly for equal texts. ``text_sha256`` is that of the lower-cased text.
    """
    found = _cut(docs, keep, text)
    names = name_blocks(found.where("key IS NOT NULL").select("key", "block"))
    held = found.where("row IS NOT NULL").drop("key", "block")
    placed = held.select("row", F.size("places").alias("n"), F.posexplode("places").alias("idx", "key"))
    current = store(placed.join(names, "key").select("row", "n", "idx", "name"), "names")
    done, level = [current.where("n = 1").select("row", F.lit(0).alias("level"), "name")], 0
    longest = held.agg(F.max(F.size("places"))).first()[0] or 1
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        current = store(name_pairs(current.where("n > 1")), "names")
        done.append(current.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
    identity = done[0]
    for other in done[1:]:
        identity = identity.union(other)
    return store(held.drop("places").join(identity, "row"), "identities")


def exact_groups(docs: DataFrame, keep: Sequence[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Of equal texts the row with the largest ``doc_id`` is kept; its id is everyone's ``keep_id``.
    """
    shown = [c for c in keep if c not in RESULTS]
    named = name_documents(docs, list(dict.fromkeys([*shown, doc_id])), text).withColumn("_id", F.col("_row")[doc_id])
    best = F.max(F.struct("_id", (-F.col("row")).alias("row"))).alias("_best")
    # Stored, so that the join reads two plain shuffles, of which adaptive execution can split a hot name's.
    groups = store(named.groupBy("level", "name").agg(best, F.count(F.lit(1)).alias("group_size")), "groups")
    return named.join(groups, ["level", "name"]).select(
        *[F.col("_row")[c].alias(c) for c in shown],
        F.col("_best._id").alias("keep_id"), "group_size", (F.col("_best.row") == -F.col("row")).alias("kept"), "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    held = docs.select(F.struct(*docs.columns).alias("_all"), F.col(doc_id).alias("_key"), F.col(text).alias("_body"))
    kept = exact_groups(held, ["_all"], "_key", "_body").where("kept")
    return kept.select(*[F.col("_all")[c].alias(c) for c in docs.columns])
