"""Periodic runs of words, found by minimizers at every scale of the period.

A run is a stretch of words with smallest period q (words q apart are equal) of at least max(``LEAST``, ``TIMES`` * q) words
that no neighbouring word extends with period q.

Periods below ``SHORT`` are scanned directly: words q apart are compared over the whole text. For a scale W (``SHORT`` and its
doublings) and periods from W to 2W - 1, each place has the hash of its 2W words, and a place is a minimizer if its hash is the
least of some W consecutive places. A run of period q holds 2q + 1 such places or more, whose hashes are equal only q apart, as
2W words tell the phases of a primitive period apart. So a minimizer of its first q places and the place q further are
consecutive equal minimizers. Such a pair is a seed: it is extended to both sides over the words themselves, so the hash never
decides. Stretches that are found by several periods are runs of the smallest.

Texts are dealt with by slices of 1.5 MB (one text may be longer), joined by words that occur nowhere else; no run crosses
them. Memory is some 100 bytes a word of a slice. No shuffle.

A null or blank text has no words. A kept column named like a result column is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import per_text

LEAST, TIMES = 6, 4
#: Periods below are scanned directly; the first scale.
SHORT = 8
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
RESULTS = ("n", "runs", "strongest", "collapsed")
_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over the whole word."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _windows(values: np.ndarray, width: int, best: np.ufunc, worst: int) -> np.ndarray:
    """``best`` over each ``width`` consecutive values: from block borders backwards and forwards, joined."""
    padded = np.full(-(-len(values) // width) * width, worst, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return best(back[:count], ahead[width - 1 : width - 1 + count])


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the least of some ``width`` consecutive places."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    low = _windows(hashes, width, np.minimum, np.iinfo(np.uint64).max)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(hashes == _windows(np.concatenate([edge, low, edge]), width, np.maximum, 0))


def lag_stretches(ids: np.ndarray, period: int, least: int) -> list[tuple[int, int, int]]:
    """All stretches of a period of ``least`` words or more, by comparing words that far apart."""
    if len(ids) < least:
        return []
    same = np.zeros(len(ids) - period + 2, np.int8)
    same[1:-1] = ids[period:] == ids[:-period]
    change = np.diff(same)
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    long = end - begin + period >= least
    return [(b, e - b + period, period) for b, e in zip(begin[long].tolist(), end[long].tolist())]


def _agree(ids: np.ndarray, at: int, period: int, step: int) -> int:
    """How many words from ``at`` on, in direction ``step``, equal the word ``period`` further on; looks ahead twice as far each time."""
    total, size = 0, 64
    while True:
        if step > 0:
            first = at + total
            last = min(first + size, len(ids) - period)
            differ = np.flatnonzero(ids[first:last] != ids[first + period : last + period])
        else:
            last = at - total + 1
            first = max(last - size, 0)
            differ = np.flatnonzero((ids[first:last] != ids[first + period : last + period])[::-1])
        if len(differ):
            return total + int(differ[0])
        if last <= first:
            return total
        total += last - first
        size *= 2


def seeds(hashes: np.ndarray, scale: int) -> list[tuple[int, int]]:
    """(period, place) of consecutive equal minimizers whose distance is a period of the scale, in order."""
    places = minimizers(hashes, scale)
    own = hashes[places]
    order = np.argsort(own, kind="stable")
    places, own = places[order], own[order]
    far = np.diff(places)
    pick = np.flatnonzero((own[1:] == own[:-1]) & (far >= scale) & (far < 2 * scale))
    return sorted(zip(far[pick].tolist(), places[pick].tolist()))


def find_runs(ids: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period; ``longest`` bounds a run's length."""
    found = [x for q in range(1, SHORT) for x in lag_stretches(ids, q, max(LEAST, TIMES * q))]
    scale, hashes, width = SHORT, _mixed(ids.astype(np.uint64)), 1
    while TIMES * scale <= longest:
        while width < 2 * scale:
            hashes = _mixed(hashes[:-width] * np.uint64(3) + hashes[width:])
            width *= 2
        end, last = 0, 0
        for period, at in seeds(hashes, scale):
            if period == last and at < end:
                continue
            before, after = _agree(ids, at - 1, period, -1), _agree(ids, at, period, 1)
            last, end = period, at + after
            length = before + after + period
            if length >= max(LEAST, TIMES * period):
                found.append((at - before, length, period))
        scale *= 2
    smallest: dict[tuple[int, int], int] = {}
    for start, length, period in found:
        smallest[start, length] = min(period, smallest.get((start, length), period))
    return sorted(((s, n, q) for (s, n), q in smallest.items()), key=lambda r: (r[0], r[2]))


def _stronger(a: dict, b: dict) -> dict:
    """The run of the greater exponent, exactly; ties: the smaller start, then period."""
    left, right = a["length"] * b["period"], b["length"] * a["period"]
    if left != right:
        return a if left > right else b
    return min(a, b, key=lambda r: (r["start"], r["period"]))


def _work() -> Callable[[list[bytes | None]], list[pa.Array]]:
    def work(texts: list[bytes | None]) -> list[pa.Array]:
        split = [(t or b"").split() for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        offsets = np.cumsum(sizes + 1) - sizes - 1
        known: dict[bytes, int] = {}
        for words in split:
            known.update(dict.fromkeys(words))
        known = dict(zip(known, range(len(known))))
        ids = np.empty(int((sizes + 1).sum()), np.int64)
        for number, (words, at) in enumerate(zip(split, offsets.tolist())):
            ids[at : at + len(words)] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            ids[at + len(words)] = len(known) + number
        runs: list[list[dict]] = [[] for _ in texts]
        gone: dict[int, np.ndarray] = {}
        for start, length, period in find_runs(ids, int(sizes.max())):
            doc = int(np.searchsorted(offsets, start, side="right")) - 1
            begin = start - int(offsets[doc])
            runs[doc].append({"start": begin, "length": length, "period": period})
            gone.setdefault(doc, np.zeros(len(split[doc]), bool))[begin + period : begin + length] = True
        strongest, collapsed = [], []
        for doc, (words, own) in enumerate(zip(split, runs)):
            top = own[0] if own else None
            for other in own[1:]:
                top = _stronger(top, other)
            strongest.append(top)
            collapsed.append(b" ".join([w for w, g in zip(words, gone[doc].tolist()) if not g] if own else words))
        return [pa.array(sizes), pa.array(runs, pa.list_(_RUN)), pa.array(strongest, _RUN), pa.array(collapsed, pa.binary())]

    return work


def periodic_runs(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row with ``n`` (words), ``runs``, ``strongest`` and ``collapsed``.

    Words are maximal stretches without the characters 20 and 09 to 0D. ``runs`` has start, length and period of every run, by
    start and period; ``strongest`` is that of the greatest length / period (ties: least start, then period) or null.
    ``collapsed`` is the text without the words that some run holds behind its first period, joined by blanks.
    """
    shown = [c for c in keep if c not in RESULTS]
    held = docs.select(F.struct(F.lit(0).alias("_"), *shown).alias("_row"), F.col(text).cast("binary").alias("_text"))
    fields = [
        T.StructField("n", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("strongest", RUN),
        T.StructField("collapsed", T.BinaryType()),
    ]
    found = per_text(held, ["_row"], fields, _work, "_text")
    return found.select(*[F.col("_row")[c].alias(c) for c in shown], "n", "runs", "strongest", F.col("collapsed").cast("string").alias("collapsed"))
