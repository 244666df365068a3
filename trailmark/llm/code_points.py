"""Quality rules with an open language model: modified Kneser-Ney over six unfolded code points, all of the corpus counted.

Code points are read as they stand, so scripts, letters, cases and digits stay apart and the number of n-grams grows with
the corpus. Nothing is pruned. The model is made in one shuffle of compressed arrays:

* a task counts the n-grams of its texts and hands on, for each bucket, its sorted distinct n-grams with their counts as one
  compressed value (some three bytes an n-gram). The bucket follows the code points 3 to 5. So a bucket holds all contexts and
  all suffixes of orders 6, 5 and 4 together: sums over contexts and continuation counts of these orders never leave it;
* a bucket's arrays are merged and stored. Counts of counts, from which the discounts come, are added up by Spark;
* orders 3 to 1 are few and are estimated by joins; each bucket gets the estimates of its trigrams back and computes those of
  its n-grams, stored partitioned and sorted by the n-gram's 64-bit hash.

At this order a text would vouch for itself: the n-grams of garbage follow each other for certain in the garbage. So the
texts are dealt to two halves by their hash, equal texts to the same, and a text is scored by the counts of the other half.
All n-grams of both halves are in the model, so every n-gram of a text finds its estimate.

Texts are scored where they are read. The most frequent ``HOT`` n-grams at most are sent to all tasks as sorted hash arrays; a
text's other n-grams become rows that are joined to the stored model, and their sum comes back to the text's row. Rows are
numbered and stored on the way, so repeated rows and null ids need no key. Base rules and bands are those of ``perplexity``.

Runs of one symbol are cheap at order 6 and do not leave the band, but do in the coarse model of character classes. So a
document must lie in both bands: that of this model, whose value is ``log_perplexity``, and that of the coarse one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm import perplexity
from trailmark.llm.common import give_back, map_batches, ship_package, slices
from trailmark.llm.perplexity import BASE, _in_band, _measure, language_bands
from trailmark.plans.lineage import store

ORDER = 6
#: Stands before and behind a text; a NUL is read as the other noncharacter.
EDGE, NUL = "\uffff", 0xFFFE
#: N-grams that a task holds (it hands its distinct ones on from half of that), and that are sent to all tasks (16 bytes each).
HELD, HOT = 2_000_000, 4_000_000
#: Bytes of text that a task takes at a time; each makes some 100 bytes of arrays.
SLICE = 400_000
#: Buckets for each shuffle partition.
BUCKETS = 4
HALVES = ("a", "b")
MEASURES = [*BASE, T.StructField("_coarse", T.DoubleType())]
_POINT = np.uint64((1 << 21) - 1)
_B21, _B42 = np.uint64(21), np.uint64(42)

#: Distinct n-grams in order with their counts in both halves. ``mid`` has code points 3, 4, 5; ``out`` has 2, 1, 6.
Grams = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of rows of code points."""
    mixed = np.zeros(len(columns[0]), np.uint64)
    for points in columns:
        mixed ^= points
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with their edges, where the n-grams begin, and their hashes; a text has its length + 1."""
    points = np.frombuffer("".join(f"{EDGE * (ORDER - 1)}{t}{EDGE}" for t in texts).encode("utf-32-le"), "<u4")
    points = np.where(points == 0, np.uint32(NUL), points)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    at = np.repeat(np.arange(len(texts)) * (ORDER - 1), size)
    at += np.arange(len(at))
    count = max(len(points) - ORDER + 1, 0)
    return points, at, _mixed([points[k : k + count] for k in range(ORDER)])[at]


def _texts(part: pa.RecordBatch) -> list[str]:
    """Null is empty."""
    return [t or "" for t in part.column("_text").to_pylist()]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin; keys are in order."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _order(mixed: np.ndarray) -> np.ndarray:
    """Places of 64-bit hashes in order of their leading bits, by one sort of values: leading bits and place in one number.

    Where leading bits of different hashes are equal, equal hashes may not be neighbours; ``_together`` joins them later.
    """
    bits = np.uint64((1 << max(len(mixed) - 1, 1).bit_length()) - 1)
    packed = mixed & ~bits
    packed |= np.arange(len(mixed), dtype=np.uint64)
    packed.sort()
    packed &= bits
    return packed.view(np.int64)


def _sums(values: np.ndarray, starts: np.ndarray, kind: type | None = None) -> np.ndarray:
    return np.add.reduceat(values, starts, dtype=kind) if len(starts) else values[:0].astype(kind or values.dtype)


def _joined(points: np.ndarray, at: np.ndarray, *places: int) -> np.ndarray:
    """Three code points of each n-gram that begins ``at`` in one number, 21 bits each."""
    made = points[at + places[0]].astype(np.uint64)
    for place in places[1:]:
        made <<= _B21
        made |= points[at + place]
    return made


def _together(parts: list[Grams]) -> Grams:
    """Sorted distinct n-grams of several parts, their counts added."""
    mid, out, a, b = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((out, mid))
    mid, out = mid[order], out[order]
    first = _starts(mid, out)
    return mid[first], out[first], _sums(a[order], first), _sums(b[order], first)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _packed(grams: Grams) -> bytes:
    """Sorted n-grams as differences, compressed."""
    mid, out, a, b = grams
    fields = [np.diff(x.astype(np.uint32), prepend=np.uint32(0)) for x in (out >> _B42, out >> _B21 & _POINT, out & _POINT)]
    raw = b"".join(map(_planes, [np.diff(mid, prepend=np.uint64(0)), *fields, a.astype(np.uint64), b.astype(np.uint64)]))
    return len(mid).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(value: bytes) -> Grams:
    count = int.from_bytes(value[:8], "little")
    raw, at, columns = pa.decompress(value[8:], count * 36, codec="zstd", asbytes=True), 0, []
    for width in (8, 4, 4, 4, 8, 8):
        plane = np.frombuffer(raw, np.uint8, count * width, at).reshape(width, count)
        columns.append(np.ascontiguousarray(plane.T).view(f"<u{width}").ravel())
        at += count * width
    mid, second, first, last, a, b = columns
    second, first, last = (np.cumsum(x, dtype=np.uint32).astype(np.uint64) for x in (second, first, last))
    return np.cumsum(mid, dtype=np.uint64), second << _B42 | first << _B21 | last, a.astype(np.int64), b.astype(np.int64)


def count_ngrams(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, grams): what the texts ``_text`` of halves ``_half`` hold, added up for each task and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        #: Hashes, and ``Grams``, of the slices read: a list for each column, so that a column goes as soon as it is merged.
        held: list[list[np.ndarray]] = [[], [], [], [], []]

        def merge() -> None:
            keys = np.concatenate(held[0])
            held[0].clear()
            order = _order(keys).astype(np.uint32 if len(keys) < 1 << 32 else np.int64)
            keys = keys[order]
            first = _starts(keys)
            held[0].append(keys[first])
            del keys
            for column in held[1:3]:
                whole = np.concatenate(column)
                column[:] = [whole[order[first]]]
            for column in held[3:]:
                whole = np.concatenate(column)
                column[:] = [_sums(whole[order], first, np.int64)]
            del whole, order, first
            give_back()

        def sent() -> pa.RecordBatch:
            held[0].clear()
            columns = [column.pop() for column in held[1:]]
            number = (_mixed([columns[0]]) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(number, kind="stable")
            number = number[order]
            first, values = _starts(number), []
            for i, j in zip(first, [*first[1:], len(number)]):
                grams = [x[order[i:j]] for x in columns]
                place = np.lexsort((grams[1], grams[0]))
                values.append(_packed(tuple(x[place] for x in grams)))
            return pa.RecordBatch.from_arrays([pa.array(number[first]), pa.array(values, pa.binary())], names=["bucket", "grams"])

        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                texts = _texts(part)
                points, at, mixed = ngrams(texts)
                half = np.repeat(part.column("_half").to_numpy().astype(np.uint8), [len(t) + 1 for t in texts])
                order = _order(mixed)
                mixed = mixed[order]
                first = _starts(mixed)
                both, b = np.diff(first, append=len(mixed)).astype(np.uint32), _sums(half[order], first, np.uint32)
                at = at[order[first]]
                columns = mixed[first], _joined(points, at, 2, 3, 4), _joined(points, at, 1, 0, 5), both - b, b
                del points, at, mixed, half, order, first
                for column, values in zip(held, columns):
                    column.append(values)
                del columns, both, b, values
                if sum(map(len, held[0])) > 0.75 * HELD:
                    merge()
                    if len(held[0][0]) > HELD / 2:
                        yield sent()
        if held[0]:
            merge()
            yield sent()

    return map_batches(rows.select("_text", "_half"), run, "bucket int, grams binary")


class _Levels:
    """Orders 6, 5 and 4 of a bucket: keys, counts in both halves, contexts, and where an n-gram's suffix stands below."""

    def __init__(self, grams: Grams) -> None:
        mid, out, a, b = grams
        second, last = out >> _B42, out & _POINT
        self.counts, self.contexts, self.suffixes = [(a, b)], [_starts(mid, out >> _B21)], []
        mid, rest = self._lower(mid, second << _B21 | last)
        self.contexts.append(_starts(mid, rest >> _B21))
        mid, rest = self._lower(mid, rest & _POINT)
        self.contexts.append(_starts(mid))
        #: Trigrams of the last order's n-grams, and how many of them continue each.
        self.trigrams, where = np.unique((mid & np.uint64((1 << 42) - 1)) << _B21 | rest, return_inverse=True)
        self.suffixes.append(where)
        self.continued = [np.bincount(where[n > 0], minlength=len(self.trigrams)) for n in self.counts[-1]]

    def _lower(self, mid: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((rest, mid))
        first = _starts(mid[order], rest[order])
        where = np.empty(len(mid), np.int64)
        where[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(mid)))
        self.suffixes.append(where)
        self.counts.append(tuple(np.bincount(where[n > 0], minlength=len(first)) for n in self.counts[-1]))
        return mid[order][first], rest[order][first]

    def counts_of_counts(self) -> list[int]:
        """How many n-grams have each count from 1 to 4: by order from 6 down, then half."""
        return [int((n == k).sum()) for both in self.counts for n in both for k in range(1, 5)]

    def estimate(self, half: int, cuts: list[list[list[float]]], trigrams: np.ndarray) -> np.ndarray:
        """Estimates of the order-6 n-grams from one half's counts and its estimates of the trigrams."""
        below = trigrams[self.suffixes[-1]]
        for level in (2, 1, 0):
            n, first = self.counts[level][half], self.contexts[level]
            less = np.array([0.0, *cuts[level][half]])[np.minimum(n, 3)]
            size = np.diff(first, append=len(n))
            total, left = np.repeat(_sums(n, first), size), np.repeat(_sums(less, first), size)
            below = np.where(total > 0, (n - less + left * below) / np.maximum(total, 1), below)
            if level:
                below = below[self.suffixes[level - 1]]
        return below


def _as_text(trigrams: np.ndarray) -> pa.Array:
    points = np.stack([trigrams >> _B42, trigrams >> _B21 & _POINT, trigrams & _POINT], axis=1).astype("<u4")
    return pa.array(np.ascontiguousarray(points).view("<U3").ravel(), pa.string())


def _as_numbers(trigrams: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(trigrams).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(-1, 3)
    return points[:, 0] << _B42 | points[:, 1] << _B21 | points[:, 2]


def merge_buckets(counted: DataFrame) -> DataFrame:
    """Merged buckets (bucket, grams, ``of_counts``) and their trigrams (bucket, gram, a, b), in one table; stored."""
    schema = "bucket int, grams binary, of_counts array<long>, gram string, a long, b long"
    names = ["bucket", "grams", "of_counts", "gram", "a", "b"]

    def settled(bucket: int, parts: list[Grams]) -> Iterator[pa.RecordBatch]:
        grams = _together(parts)
        levels = _Levels(grams)
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([
            pa.array([bucket], pa.int32()), pa.array([_packed(grams)], pa.binary()), pa.array([levels.counts_of_counts()], longs),
            pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
        ], names=names)
        count = len(levels.trigrams)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(count, bucket, np.int32)), pa.nulls(count, pa.binary()), pa.nulls(count, longs),
            _as_text(levels.trigrams), *[pa.array(x.astype(np.int64)) for x in levels.continued],
        ], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size = None, [], 0
        for batch in batches:
            for bucket, value in zip(batch.column("bucket").to_pylist(), batch.column("grams")):
                if bucket != now and parts:
                    yield from settled(now, parts)
                    parts, size = [], 0
                now = bucket
                parts.append(_unpacked(value.as_py()))
                size += len(parts[-1][0])
                if size > HELD:
                    parts = [_together(parts)]
                    size = len(parts[0][0]) // 2
        if parts:
            yield from settled(now, parts)

    placed = counted.repartition("bucket").sortWithinPartitions("bucket")
    return store(map_batches(placed, run, schema), "buckets")


def _cuts(n: list[int]) -> list[float]:
    """What is taken from counts of 1, 2 and 3 or more, given how many have counts 1 to 4; fixed where a class is empty."""
    if min(n) == 0:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in range(1, 4)]


def discounts(counts: DataFrame) -> dict[str, list[float]]:
    """The cuts of each half."""
    row = counts.agg(*[F.count(F.when(F.col(h) == k, 1)).alias(f"{h}{k}") for h in HALVES for k in range(1, 5)]).first()
    return {h: _cuts([row[f"{h}{k}"] for k in range(1, 5)]) for h in HALVES}


def _less(half: str, cut: list[float]) -> Column:
    n = F.col(half)
    return F.when(n >= 3, cut[2]).when(n == 2, cut[1]).when(n == 1, cut[0]).otherwise(0.0)


def low_estimates(trigrams: DataFrame) -> DataFrame:
    """(gram, a, b): estimates of every trigram by the continuation counts of each half; stored."""
    orders = [store(trigrams.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "continuations")]
    for _ in range(2):
        kinds = [F.count(F.when(F.col(h) > 0, 1)).alias(h) for h in HALVES]
        orders.append(store(orders[-1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(*kinds), "continuations"))
    lower, floor = None, 1.0 / (orders[-1].count() + 1)
    for order, counts in enumerate(reversed(orders), 1):
        cut = discounts(counts)
        rows = counts.withColumn("context", F.substring("gram", 1, order - 1))
        sums = [x for h in HALVES for x in (F.sum(h).alias(f"{h}_all"), F.sum(_less(h, cut[h])).alias(f"{h}_left"))]
        rows = rows.join(rows.groupBy("context").agg(*sums), "context")
        if lower is None:
            below = {h: F.lit(floor) for h in HALVES}
        else:
            rows = rows.withColumn("suffix", F.expr("substring(gram, 2)"))
            rows = rows.join(lower.select(F.col("gram").alias("suffix"), *[F.col(h).alias(f"{h}_below") for h in HALVES]), "suffix")
            below = {h: F.col(f"{h}_below") for h in HALVES}
        made = [
            F.when(F.col(f"{h}_all") > 0, (F.col(h) - _less(h, cut[h]) + F.col(f"{h}_left") * below[h]) / F.col(f"{h}_all")).otherwise(below[h]).alias(h)
            for h in HALVES
        ]
        lower = rows.select("gram", *made)
    return store(lower, "trigrams")


def estimates(buckets: DataFrame) -> DataFrame:
    """(hash, n, a, b): how often every n-gram stands, and natural logs of its estimate by each half; stored sorted by hash."""
    values = buckets.where("grams IS NOT NULL").select("bucket", "grams")
    trigrams = buckets.where("gram IS NOT NULL").select("bucket", "gram", "a", "b")
    places = 3 * len(HALVES) * 4
    row = buckets.where("grams IS NOT NULL").agg(*[F.sum(F.col("of_counts")[i]).alias(f"c{i}") for i in range(places)]).first()
    n = [row[f"c{i}"] or 0 for i in range(places)]
    cuts = [[_cuts(n[8 * level + 4 * half :][:4]) for half in range(2)] for level in range(3)]
    low = low_estimates(trigrams)
    own = trigrams.select(F.col("bucket").alias("of"), "gram").join(low, "gram")

    def made(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        order = np.argsort(numbers := _as_numbers(right.column("gram").to_pylist()))
        known, below = numbers[order], [right.column(h).to_numpy()[order] for h in HALVES]
        for value in left.column("grams"):
            mid, rest, a, b = grams = _unpacked(value.as_py())
            levels = _Levels(grams)
            at = np.searchsorted(known, levels.trigrams)
            logs = [np.log(levels.estimate(half, cuts, below[half][at])).astype(np.float32) for half in range(2)]
            points = [rest >> _B21 & _POINT, rest >> _B42, mid >> _B42, mid >> _B21 & _POINT, mid & _POINT, rest & _POINT]
            out.append(pa.table({"hash": _mixed(points).view(np.int64), "n": a + b, "a": logs[0], "b": logs[1]}))
        return pa.concat_tables(out) if out else pa.table({"hash": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "a": pa.array([], pa.float32()), "b": pa.array([], pa.float32())})

    ship_package(buckets.sparkSession)
    logs = values.groupBy("bucket").cogroup(own.groupBy("of")).applyInArrow(made, "hash long, n long, a float, b float")
    return store(logs.repartition("hash").sortWithinPartitions("hash"), "estimates")


def hot_arrays(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order and logs (a, b) of the most frequent n-grams, at most ``HOT``: all whose count reaches some level."""
    level = F.floor(F.log2("n") * 4).cast("int")
    sizes = model.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()
    total, least = 0, 1 << 30
    for row in sizes:
        total += row.n
        if total > HOT:
            break
        least = row.level
    found = model.where(level >= least).select("hash", *HALVES).toArrow()
    order = np.argsort(keys := found.column("hash").to_numpy().view(np.uint64))
    return keys[order], np.stack([found.column(h).to_numpy()[order] for h in HALVES])


def scored(
    batches: Iterator[pa.RecordBatch], keys: np.ndarray, logs: np.ndarray, table: np.ndarray, names: list[str], number: int
) -> Iterator[pa.RecordBatch]:
    """A row for each text, numbered from ``number``, and one for each of its n-grams that is not among ``keys``.

    ``names`` are the kept columns, then those of ``MEASURES`` and the five that ``measured`` adds.
    """
    kept = names[: -len(MEASURES) - 5]

    def of(part: pa.RecordBatch) -> list[pa.RecordBatch]:
        texts = _texts(part)
        size = np.array([len(t) + 1 for t in texts], np.int64)
        ids = np.arange(number, number + len(texts))
        mixed = ngrams(texts)[2]
        half = part.column("_half").to_numpy()
        order = _order(mixed)
        begin = _starts(mixed[order])
        own = mixed[order[begin]]
        where = np.empty(len(mixed), np.int64)
        where[order] = np.repeat(np.arange(len(own)), np.diff(begin, append=len(mixed)))
        at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
        found = np.where(hit, logs[:, at], 0.0) if len(keys) else np.zeros((2, len(own)))
        each, known = found[np.repeat(1 - half, size), where], hit[where]
        first = np.cumsum(size) - size
        rare, doc = mixed[~known], np.repeat(np.arange(len(texts)), size)[~known]
        *base, rough = _measure(texts, table)
        own = [pa.array(-np.add.reduceat(each, first, dtype=np.float64)), rough, pa.array(ids), pa.array(np.bincount(doc, minlength=len(texts)))]
        nothing = [pa.nulls(len(texts), pa.int64())] * 3
        made = [pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *base, *own, *nothing], names=names)]
        if len(rare):
            order = np.lexsort((rare, doc))
            begin = _starts(doc[order], rare[order])
            rare, doc = rare[order][begin], doc[order][begin]
            empty = [pa.nulls(len(rare), t) for t in [*(part.column(c).type for c in kept), *(x.type for x in base), pa.float64(), pa.float64()]]
            times = np.diff(begin, append=len(order))
            rows = [ids[doc], np.zeros(len(rare), np.int64), rare.view(np.int64), times, half[doc]]
            made.append(pa.RecordBatch.from_arrays([*empty, *map(pa.array, rows)], names=names))
        return made

    for batch in batches:
        for part in slices(batch, "_text", SLICE):
            yield from of(part)
            number += part.num_rows


def measured(docs: DataFrame, keep: list[str], text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep`` of every row with the base counts and both mean log-perplexities of its text; stored.

    ``also`` may name ``_text``, the text itself.
    """
    spark = docs.sparkSession
    rows = docs.select(*keep, F.col(text).alias("_text"), F.xxhash64(text).bitwiseAND(F.lit(1)).alias("_half"))
    coarse = spark.sparkContext.broadcast(perplexity.KneserNey(*perplexity.count_ngrams(rows, "_text")).table())
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = estimates(merge_buckets(count_ngrams(rows, buckets)))
    hot = spark.sparkContext.broadcast(hot_arrays(model))
    facts = [*(T.StructField(f.name, f.dataType) for f in (rows.schema[c] for c in [*keep, *also])), *MEASURES]
    extra = [T.StructField(c, T.LongType()) for c in ("_id", "_rare", "_hash", "_times", "_which")]
    schema = T.StructType([*facts, *extra])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scored(batches, *hot.value, coarse.value, schema.names, TaskContext.get().partitionId() << 33)

    made = store(map_batches(rows, score, schema), "measured")
    log = F.when(F.col("_which") == 1, F.col("a")).otherwise(F.col("b"))
    rest = made.where("_hash IS NOT NULL").select("_id", F.col("_hash").alias("hash"), "_times", "_which").join(model, "hash")
    rest = store(rest.groupBy("_id").agg(F.sum(-F.col("_times") * log).alias("_more")), "rare")
    made = made.where("_hash IS NULL").drop("_hash", "_times", "_which")
    whole = made.where("_rare = 0").withColumn("_more", F.lit(0.0)).unionByName(made.where("_rare > 0").join(rest, "_id"))
    shown = [*(f.name for f in facts)]
    return whole.withColumn("log_perplexity", (F.col("log_perplexity") + F.col("_more")) / F.col("n_chars_scored")).select(*shown)


def _judged(rows: DataFrame) -> DataFrame:
    """Measured rows with ``kept``: whether the base rules pass and both perplexities are in their bands of ``_lang``."""
    judged = F.lit(True)
    for name in ("log_perplexity", "_coarse"):
        bands = language_bands(rows.select("_lang", "base_failed", "n_chars_scored", F.col(name).alias("log_perplexity")), "_lang")
        bands = bands.select(*[F.col(c).alias(f"{name}_{c}") for c in bands.columns])
        rows = rows.join(bands, F.col("_lang").eqNullSafe(F.col(f"{name}_band_lang")), "left")
        judged = judged & _in_band(name, f"{name}_middle", f"{name}_deviation")
    return rows.withColumn("kept", judged)


def quality_rules(docs: DataFrame, keep: list[str], lang: str = "lang", text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row, its base counts, log_perplexity and ``kept``; see ``perplexity.quality_rules``."""
    rows = measured(docs.withColumn("_lang", F.col(lang)), [*keep, "_lang"], text)
    return _judged(rows).select(*keep, *[f.name for f in BASE], "kept")


def keep_documents(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    others = [F.col(c) for c in docs.columns if c != text]
    held = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("_row"), F.col(lang).alias("_lang"), F.col(text).alias("_body"))
    kept = _judged(measured(held, ["_row", "_lang"], "_body", ("_text",))).filter("kept")
    return kept.select(*[F.col("_text").alias(text) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])
