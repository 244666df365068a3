"""Near-duplicate classes by DartMinHash signatures, banded joins and exact verification.

A text is a weighted set: its five-word shingles with how often they occur. Each element owns a region of the plane of
weight and rank; hashed darts fall into the regions, one per unit of area on average, the same darts for every text. A
dart hits one of ``COORDINATES`` coordinates, and each coordinate keeps its dart of lowest rank, so two signatures agree
in a coordinate with the probability of the texts' weighted Jaccard similarity. Only as much rank is thrown as fills the
coordinates, so the cost per text is its length plus k log k.

1. Equal texts (equal words) share a key and count as one member from here on.
2. Bands of the signature are buckets. A bucket's members are joined to its smallest and largest key, never to each
   other; Spark combines the two keys before the shuffle, so a bucket may hold any share of the corpus.
3. Every candidate pair is verified on all shingles; pairs of at least ``SIMILARITY`` are links.
4. Where the members of a bucket still belong to several components, all members outside its commonest component are
   compared with all of other components, in blocks of at most ``BLOCK`` members a task; only links that join components
   are returned. So every pair that shares a bucket is connected or has been verified.
5. Components by alternating large and small stars. Tables between steps are written to the shared folder.

Two texts of similarity s share a band with probability 1 - (1 - s^6)^32: 0.99994 at 0.8. Keys have 64 bits; among n
different texts about n^2 / 2^65 pairs get the same key by chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import ascii_words, map_batches, ship_package, slices
from trailmark.plans.lineage import store

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
#: Members of a bucket that one task compares with as many others.
BLOCK = 512
#: Area of darts that a text's signature needs: k ln k fills all coordinates on average, 4 k more nearly surely.
AREA = COORDINATES * (math.log(COORDINATES) + 4)
_RANK_BITS = 40


def _cells() -> list[tuple[float, float]]:
    """Rank intervals in which darts are counted: doubling up to 4, then 4 wide, up to what one element may need."""
    out, low, high = [], 0.0, 1 / 16
    while low < AREA:
        out.append((low, high))
        low, high = high, high * 2 if high < 4 else high + 4
    return out


CELLS = _cells()
_HIGH = np.array([high for _, high in CELLS])


def _poisson(width: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts in a cell of this width and one unit of weight."""
    p, out = math.exp(-width), []
    for n in range(48):
        out.append(p)
        p *= width / (n + 1)
    return np.cumsum(out)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def weighted_elements(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of weight of all texts: hash, text number and the number of units per text.

    The n-th occurrence of a shingle is a unit of its own, so the Jaccard similarity of two sets of units is the
    weighted similarity of the shingles. A text of fewer words, but not none, is one shingle.
    """
    size = np.array([len(t) for t in texts], np.int64)
    units = np.where(size == 0, 0, np.maximum(size - SHINGLE + 1, 1))
    total = int(size.sum())
    words = np.fromiter((xxhash.xxh3_64_intdigest(w) for t in texts for w in t), np.uint64, total)
    owner = np.repeat(np.arange(len(texts)), units)
    first = np.cumsum(size) - size
    begin = np.repeat(first - (np.cumsum(units) - units), units) + np.arange(int(units.sum()))
    hashes = np.zeros(len(begin), np.uint64)
    for k in range(SHINGLE):
        inside = k < size[owner]
        word = words[np.minimum(begin + k, max(total - 1, 0))]
        hashes = mix(hashes ^ np.where(inside, word, np.uint64(k)), k + 1)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    place = np.arange(len(hashes))
    nth = place - np.maximum.accumulate(np.where(new, place, 0)) if len(hashes) else place
    return np.where(nth > 0, mix(hashes ^ nth.astype(np.uint64), 9), hashes), owner, units


def signatures(hashes: np.ndarray, owner: np.ndarray, units: np.ndarray) -> np.ndarray:
    """DartMinHash signatures: per text and coordinate the lowest rank of its darts.

    A coordinate that no dart hits (about one in ten thousand texts has one) holds a value that matches nothing similar.
    """
    empty = np.uint64(2**63)
    best = np.full(len(units) * COORDINATES, empty)
    need = np.searchsorted(_HIGH, AREA / np.maximum(units, 1))
    level = need[owner]
    for c, (low, high) in enumerate(CELLS):
        if c:
            go = level >= c
            if not go.any():
                break
            hashes, owner, level = hashes[go], owner[go], level[go]
        chance = mix(hashes, 100 + c)
        count = np.searchsorted(_poisson(high - low), (chance >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right")
        hit = np.flatnonzero(count)
        if not len(hit):
            continue
        n = count[hit]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        dart = mix(np.repeat(chance[hit], n) + nth.astype(np.uint64), 7)
        rank = np.uint64(int(low * 2**_RANK_BITS)) + ((dart >> np.uint64(16)).astype(np.float64) * ((high - low) * 2.0 ** (_RANK_BITS - 48))).astype(np.uint64)
        coordinate = (mix(dart, 8) % np.uint64(COORDINATES)).astype(np.int64)
        np.minimum.at(best, np.repeat(owner[hit], n) * COORDINATES + coordinate, rank)
    return best.reshape(len(units), COORDINATES)


def buckets(signature: np.ndarray) -> np.ndarray:
    """One hash per band, which differs between bands."""
    rows = signature.reshape(len(signature), BANDS, ROWS)
    out = np.tile(np.arange(BANDS, dtype=np.uint64), (len(signature), 1))
    for k in range(ROWS):
        out = mix(out ^ rows[:, :, k], 20 + k)
    return out


def text_key(text: str | None, words: list[bytes]) -> int:
    """Equal for texts of equal words; a text without words is equal to itself only, null to the empty text."""
    if words:
        return xxhash.xxh3_64_intdigest(b" ".join(words))
    return xxhash.xxh3_64_intdigest(b"\0" + (text or "").encode("utf-8", "surrogatepass"))


SKETCH = [
    T.StructField("key", T.LongType()), T.StructField("buckets", T.ArrayType(T.LongType())),
    T.StructField("units", T.ArrayType(T.IntegerType())),
]


def sketch(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row with the key of its text, its buckets and its units (32 bits each, distinct)."""
    schema = T.StructType([*(docs.schema[c] for c in keep), *SKETCH])

    def nested(values: np.ndarray, size: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text).to_pylist()
                words = [ascii_words(t) for t in texts]
                hashes, owner, units = weighted_elements(words)
                found = buckets(signatures(hashes, owner, units))[units > 0].view(np.int64).ravel()
                small = (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
                order = np.lexsort((small, owner))
                small, owner = small[order], owner[order]
                new = np.ones(len(small), bool)
                new[1:] = (small[1:] != small[:-1]) | (owner[1:] != owner[:-1])
                size = np.bincount(owner[new], minlength=len(texts))
                key = np.array([text_key(t, w) for t, w in zip(texts, words)], np.uint64).view(np.int64)
                made = [pa.array(key), nested(found, np.where(units > 0, BANDS, 0)), nested(small[new], size)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=schema.names)

    return map_batches(docs.select(*dict.fromkeys([*keep, text])), run, schema)


def verified(pairs: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose texts are similar enough; ``units`` has one row per key."""
    both = pairs.join(units.select(F.col("key").alias("a"), F.col("units").alias("ua")), "a")
    both = both.join(units.select(F.col("key").alias("b"), F.col("units").alias("ub")), "b")
    shared = F.size(F.array_intersect("ua", "ub"))
    return both.filter(shared >= similarity * (F.size("ua") + F.size("ub") - shared)).select("a", "b")


def _similar(left: np.ndarray, right: np.ndarray, units: list[np.ndarray], similarity: float, width: int = 4_096) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row of ``left`` and one of ``right`` that are similar enough; shared units by matrix products."""
    rows = np.repeat(np.arange(len(units)), [len(u) for u in units])
    values, column, often = np.unique(np.concatenate(units), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    order = order[often[column[order]] > 1]
    rows, column = rows[order], np.unique(column[order], return_inverse=True)[1]
    shared = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        begin, end = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(units), width), np.float32)
        part[rows[begin:end], column[begin:end] - low] = 1
        shared += part[left] @ part[right].T
    size = np.array([len(u) for u in units], np.float32)
    union = size[left][:, None] + size[right][None, :] - shared
    return np.nonzero(shared >= similarity * union)


def spanning_links(members: DataFrame, units: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links between members (bucket, key, root) of one bucket with different roots, all such pairs being compared.

    The members outside a bucket's commonest root are dealt into blocks of about ``block``, and so are all; a task compares one
    block with another, so it holds at most two blocks however many members the bucket has, and returns at most as many
    links as it joins components. Members of one root are not compared.
    """
    counts = members.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    whole = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots"))
    whole = whole.filter("roots > 1 AND n > 3").select(
        "bucket", F.col("most.root").alias("main"), F.ceil(F.col("n") / block).cast("int").alias("blocks"),
        F.ceil((F.col("n") - F.col("most.n")) / block).cast("int").alias("opens"),
    )
    rows = members.join(store(whole, "split"), "bucket")
    is_open, place = F.col("root") != F.col("main"), F.xxhash64("key")
    own = F.transform(F.sequence(F.lit(0), F.col("opens") - 1), lambda i: F.struct(
        i.alias("i"), F.pmod(place, F.col("blocks")).cast("int").alias("j"), F.lit(False).alias("asks")))
    asks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.pmod(place, F.col("opens")).cast("int").alias("i"), j.alias("j"), F.lit(True).alias("asks")))
    single = (F.col("blocks") == 1) & (F.col("opens") == 1)
    dealt = F.when(single, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), is_open.alias("asks")))).otherwise(
        F.concat(own, F.when(is_open, asks).otherwise(F.slice(asks, 1, 0)))
    )
    single = single.alias("single")
    rows = rows.select("bucket", "key", "root", single, F.inline(dealt)).join(units, "key")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, root = table.column("key").to_numpy(), table.column("root").to_numpy()
        asks = table.column("asks").to_numpy()
        nested = table.column("units").combine_chunks()
        units = np.split(nested.flatten().to_numpy(), np.cumsum(nested.value_lengths().to_numpy())[:-1])
        left = np.flatnonzero(asks)
        right = np.arange(len(key)) if table.column("single")[0].as_py() else np.flatnonzero(~asks)
        found = [(left[a], right[b]) for a, b in zip(*(x.tolist() for x in _similar(left, right, units, similarity)))] if len(left) and len(right) else []
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        a, b = [], []
        for x, y in found:
            p, q = top(root[x]), top(root[y])
            if p != q:
                parent[max(p, q)] = min(p, q)
                a.append(key[x])
                b.append(key[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    ship_package(members.sparkSession)
    return rows.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(key, root) for every key of a link: the smallest key of its component, by alternating large and small stars."""
    edges = store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.filter("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = store(small.filter("u <> v").distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("key"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct()
    )


def similar_classes(sketches: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, root) of all keys with a similar other text; ``sketches`` must be stored rows, numbered by ``_row``."""
    # Copies go before a shuffle, by the partial aggregate of dropDuplicates.
    rows = sketches.select("key", "buckets").dropDuplicates(["key"]).select("key", F.explode("buckets").alias("bucket"))
    hubs = rows.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high")
    full = store(rows.join(hubs, "bucket").distinct(), "buckets")
    # Units are long: numbers tell which rows are needed, one per key, before any units are shuffled.
    wanted = sketches.groupBy("key").agg(F.min("_row").alias("_row")).join(full.select("key").distinct(), "key", "left_semi")
    units = store(sketches.select("_row", "key", "units").join(store(wanted.select("_row"), "wanted"), "_row", "left_semi").drop("_row"), "units")
    pairs = full.select(F.explode(F.array("low", "high")).alias("a"), F.col("key").alias("b")).filter("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    classes = store(components(verified(pairs, units, similarity)), "classes")
    members = full.select("bucket", "key").join(classes, "key", "left").withColumn("root", F.coalesce("root", "key"))
    members = store(members, "members")
    more = spanning_links(members, units, similarity)
    root = members.select("key", "root").distinct()
    more = more.join(root.toDF("a", "ra"), "a").join(root.toDF("b", "rb"), "b")
    joined = store(components(more.select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "joined")
    old = classes.join(joined.toDF("root", "new"), "root", "left").select("key", F.coalesce("new", "root").alias("root"))
    alone = joined.join(classes.select("key"), "key", "left_anti")
    return store(old.union(alone.select("key", "root")), "classes")


def near_duplicates(docs: DataFrame, keep: list[str], similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row, ``class_id``, ``class_size`` and ``kept``.

    ``class_id`` is the smallest doc_id of the class (null where all are null) and ``class_size`` its number of rows;
    one row of each class is kept, that with the smallest doc_id (null last), the first stored one of repeated rows.
    Texts without words form a class only with exact copies; null counts as empty.
    """
    rows = numbered_sketches(docs, keep, key, text)
    return classified(rows, keep, similarity, key).select(*keep, "class_id", "class_size", "kept")


def numbered_sketches(docs: DataFrame, keep: list[str], key: str, text: str) -> DataFrame:
    """The sketches of all rows, stored with their number ``_row``."""
    rows = sketch(docs.select(*dict.fromkeys([*keep, key, text])), list(dict.fromkeys([*keep, key])), text)
    return store(rows.withColumn("_row", F.monotonically_increasing_id()), "sketches")


def classified(rows: DataFrame, keep: list[str], similarity: float, key: str) -> DataFrame:
    """Columns ``keep`` and ``_row`` of every sketch with its class, the size of it and whether the row is kept."""
    classes = similar_classes(rows, similarity)
    placed = rows.select(*dict.fromkeys([*keep, key]), "_row", "key").join(classes, "key", "left")
    placed = placed.withColumn("_class", F.coalesce("root", "key"))
    order = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("_row").alias("r"))
    first = placed.groupBy("_class").agg(F.min(order).alias("_first"), F.count("*").alias("class_size"))
    out = placed.join(store(first, "first"), "_class")
    return out.select(*keep, "_row", F.col("_first.k").alias("class_id"), "class_size", (F.col("_row") == F.col("_first.r")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """One row of each class, with its own columns; the table is stored once with its sketches.

    Classes are found on numbers alone, and the numbers of the rows that go are taken from the stored table.
    """
    held = docs.select(F.struct("*").alias("_row_data"), F.col("doc_id"), F.col(text).alias("text"))
    rows = numbered_sketches(held, ["_row_data"], "doc_id", "text")
    gone = store(classified(rows, [], similarity, "doc_id").filter("NOT kept").select("_row"), "gone")
    return rows.join(gone, "_row", "left_anti").select("_row_data.*")
