"""Benchmark decontamination by a prefix-filtered set join with exact windows.

An item's windows are its runs of ``window`` words (one window where it is shorter). Containment of a whole window is
asked for, so by the prefix principle one token of each window, its rarest, must occur in a document that contains it;
rarity is counted over all documents. A document position joins the windows whose prefix token it carries; the window
must then fit between the document's ends around that position (length and positional bounds), and all its words are
compared. No shuffle: documents meet an index of the benchmark that is broadcast in blocks of bounded size; a benchmark
above one block is passed in several blocks, so size costs time and never windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import ascii_words, map_batches, slices
from trailmark.plans.lineage import store

#: Windows in one broadcast block; a window has at most ``window`` words, so a block stays below some 20 MB.
BLOCK_WINDOWS = 50_000
FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def item_windows(words: list[bytes], window: int) -> Iterator[tuple[bytes, ...]]:
    if words:
        yield from (tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1)))


def blocks(benchmark: DataFrame, window: int, item: str, text: str) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    """Distinct windows with their items, at most ``BLOCK_WINDOWS`` windows at a time; a long item takes several blocks."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    block: dict[tuple[bytes, ...], set[str]] = {}
    for row in rows.toLocalIterator():
        for w in item_windows(ascii_words(row.t), window):
            block.setdefault(w, set()).add("" if row.i is None else row.i)
            if len(block) >= BLOCK_WINDOWS:
                yield block
                block = {}
    if block:
        yield block


def corpus_counts(docs: DataFrame, vocabulary: set[bytes], text: str) -> dict[bytes, int]:
    """How often each word of one block's vocabulary occurs in all documents; counted per task, then added up."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found = shared.value, Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                found.update(filter(words.__contains__, ascii_words(value)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"]
        )

    counts = map_batches(docs.select(text), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counts.collect()}


class WindowIndex:
    """Windows of one block, joined by their rarest word."""

    def __init__(self, block: dict[tuple[bytes, ...], set[str]], counts: dict[bytes, int], window: int) -> None:
        vocabulary = sorted({w for words in block for w in words})
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.items = sorted({i for items in block.values() for i in items})
        number = {i: k for k, i in enumerate(self.items)}
        self.words = np.full((len(block), window), -2, np.int32)
        self.length, self.place = np.zeros(len(block), np.int32), np.zeros(len(block), np.int32)
        prefix = np.zeros(len(block), np.int64)
        self.owners = []
        for k, (words, items) in enumerate(block.items()):
            self.words[k, : len(words)] = [self.ids[w] for w in words]
            self.length[k] = len(words)
            self.place[k] = min(range(len(words)), key=lambda p: (counts.get(words[p], 0), words[p], p))
            prefix[k] = self.words[k, self.place[k]]
            self.owners.append(np.array(sorted(number[i] for i in items), np.int64))
        self.order = np.argsort(prefix, kind="stable")
        self.per_word = np.bincount(prefix, minlength=len(vocabulary))
        self.first = np.cumsum(self.per_word) - self.per_word

    def search(self, texts: list[list[bytes]], chunk: int = 200_000) -> list[tuple[list[tuple[int, int]], set[int]]]:
        """For each text its hit spans (from, to) and item numbers."""
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for t in texts for w in t), np.int32, int(sizes.sum()))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[int]] = [set() for _ in texts]
        at = np.flatnonzero(ids >= 0)
        many = self.per_word[ids[at]]
        at, many = at[many > 0], many[many > 0]
        cuts = np.flatnonzero(np.diff(np.cumsum(many) // chunk)) + 1
        for pos, n in zip(np.split(at, cuts), np.split(many, cuts)):
            if not len(pos):
                continue
            where = np.repeat(pos, n)
            rank = np.arange(len(where)) - np.repeat(np.cumsum(n) - n, n)
            win = self.order[np.repeat(self.first[ids[pos]], n) + rank]
            begin = where - self.place[win]
            text = np.searchsorted(ends, where, side="right")
            fits = (begin >= ends[text] - sizes[text]) & (begin + self.length[win] <= ends[text])
            begin, win, text = begin[fits], win[fits], text[fits]
            for k in range(self.words.shape[1]):
                inside = k < self.length[win]
                same = ~inside | (ids[np.minimum(begin + k, len(ids) - 1)] == self.words[win, k])
                begin, win, text = begin[same], win[same], text[same]
            for p, w, t in zip((begin - (ends[text] - sizes[text])).tolist(), win.tolist(), text.tolist()):
                spans[t].append((p, p + int(self.length[w])))
                items[t].update(self.owners[w].tolist())
        return list(zip(spans, items))


def _flat(spans: list[tuple[int, int]]) -> list[int]:
    """Joined spans as from, to, from, to, ..."""
    out: list[int] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [begin, end]
    return out


def find_passages(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: list[str] | None = None, text: str = "text",
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Columns ``keep`` (all if none are named) of every row, and ``found``: n_words, hits (from, to, ...), items.

    ``hits`` counts words from 0 and joins spans that touch; ``items`` is sorted as strings. A text that is null or has
    no word gives 0 words and no hits. An item without words has no window; items with equal ids are one item, a null
    id reads as the empty string. An empty benchmark finds nothing. Repeated rows are each searched; a column of the
    documents named ``found`` is replaced.
    """
    columns = [c for c in (keep if keep is not None else docs.columns) if c != "found"]
    need = list(dict.fromkeys([*columns, text]))
    field, context = T.StructField("found", T.StructType(FOUND)), docs.sparkSession.sparkContext
    out, before = docs.select(*need), None
    for block in blocks(benchmark, window, item, item_text):
        if before is not None:
            out = store(_search(out, before, field, need, text), "passages")
        before = context.broadcast(WindowIndex(block, corpus_counts(docs, {w for ws in block for w in ws}, text), window))
    return _search(out, before, field, columns, text)


def _search(docs: DataFrame, shared, field: T.StructField, keep: list[str], text: str) -> DataFrame:
    """Search one block and join what it finds to what earlier blocks have found."""
    schema = T.StructType([*(docs.schema[c] for c in keep), field])
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
    later = field.name in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value if shared is not None else None
        for batch in batches:
            for part in slices(batch, text):
                words = [ascii_words(t) for t in part.column(text).to_pylist()]
                new = index.search(words) if index is not None else [([], set())] * len(words)
                old = part.column(field.name).to_pylist() if later else [None] * len(words)
                made: list[list] = [[], [], []]
                for ws, (spans, items), was in zip(words, new, old):
                    names = {index.items[i] for i in items}
                    if was is not None:
                        spans = spans + list(zip(was["hits"][::2], was["hits"][1::2]))
                        names.update(was["items"])
                    made[0].append(len(ws))
                    made[1].append(_flat(spans))
                    made[2].append(sorted(names))
                nested = pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(made, kinds)], names=[f.name for f in FOUND])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), nested], names=schema.names)

    return map_batches(docs, run, schema)


def contamination(found: DataFrame) -> DataFrame:
    """The columns of ``found`` rows as counts: n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = F.aggregate(
        F.transform("found.hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return found.withColumns({
        "n_words": F.col("found.n_words"), "n_hit": hits, "n_items": F.size("found.items").cast("long"),
        "items_sha256": F.sha2(F.concat_ws(",", "found.items"), 256), "contaminated": hits > 0,
    }).drop("found")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any benchmark passage, with their own columns."""
    return find_passages(docs, benchmark, window, text=text).filter(F.size("found.hits") == 0).select(*docs.columns)
