"""Quality rules: counts of a text and the perplexity of a modified Kneser-Ney model with bands per language.

The model reads characters folded to 40 classes and looks at four in a row, so it has at most 40^4 n-grams however large
the corpus is: every document is counted, nothing is pruned, and the arrays sent to the workers stay below some 40 MB.
Spark counts the n-grams (per task first, then by key); the estimates are kept as arrays sorted by the n-gram's hash,
its number in base 40, with which no two n-grams collide.

A document is kept when its base counts pass and its mean log-perplexity lies in the band of its language: the median
over the language's passing documents, plus or minus ``MARGIN`` and ``WIDTH`` robust deviations. The mean of a short
text scatters more, so deviations are those of one character, divided by the square root of the text's length. Medians
come from counts of bins, so they are exact for the bins and repeatable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import map_batches, slices
from trailmark.plans.lineage import store

CLASSES, ORDER, EDGE = 40, 4, 39
#: Robust deviations from the median that are still in the band, and the smallest deviation of a character that is used.
WIDTH, LEAST_DEVIATION = 5.0, 0.5
#: Nats that are allowed besides, for passages of another kind.
MARGIN = 0.03
#: Base rules: at least so many words; at most so many of a hundred words in repeated windows of so many words.
LEAST_WORDS, MOST_REPEATED, REPEAT_WINDOW = 20, 30, 8
#: The white space and the symbols that the base counts name.
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Bins of log-perplexity, and of its distance from the median for one character, to the nat.
BIN, DISTANCE_BIN = 1_000, 100

BASE = [
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("n_chars_scored", T.LongType()), T.StructField("log_perplexity", T.DoubleType()),
]


def _class_of(point: int) -> int:
    """The class of a code point below U+0250."""
    char = chr(point)
    if char.isspace():
        return 0
    if char.isascii() and char.isalpha():
        return ord(char.lower()) - 96
    if char.isdigit() and char.isascii():
        return 27
    if char.isalpha():
        return 28 + point % 6
    if char in ".,;:!?'\"-()":
        return 36
    return 37 if char in SYMBOLS else 38


_NEAR = np.array([_class_of(p) for p in range(0x250)], np.int32)


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram numbers of all texts in a row, where each text's part begins, and where a number is no n-gram.

    A text is read with three edge marks before it and one behind it; null is empty. Its part has its length plus four
    places, of which the first three are no n-grams.
    """
    texts = [t or "" for t in texts]
    points = np.frombuffer("".join(f"\0\0\0{t}\0" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    classes = np.where(points < 0x3000, 34, 35).astype(np.int32)
    near = points < 0x250
    classes[near] = _NEAR[points[near]]
    size = np.array([len(t) + ORDER for t in texts], np.int64)
    first = np.cumsum(size) - size
    edges = (first[:, None] + np.arange(ORDER - 1)).ravel()
    classes[edges] = EDGE
    classes[first + size - 1] = EDGE
    number = classes.copy()
    for back in range(1, ORDER):
        number[back:] += classes[:-back] * np.int32(CLASSES**back)
    return number, first, edges


def count_ngrams(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-gram numbers of all documents and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**ORDER, np.int64)
        for batch in batches:
            for part in slices(batch, text):
                number, _, edges = ngrams(part.column(text).to_pylist())
                number[edges] = -1
                total += np.bincount(number[number >= 0], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["ngram", "n"])

    counts = map_batches(docs.select(text), run, "ngram int, n long").groupBy("ngram").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    number, n = found.column("ngram").to_numpy().astype(np.int64), found.column("n").to_numpy()
    order = np.argsort(number)
    return number[order], n[order]


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken from counts of 1, 2 and 3 or more (modified Kneser-Ney); fixed fractions where a class is empty."""
    n = [float((counts == k).sum()) for k in range(1, 5)]
    if min(n) == 0:
        return np.array([0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    made = [k - (k + 1) * y * n[k] / n[k - 1] for k in range(1, 4)]
    return np.clip(made, 0.05, [0.95, 1.95, 2.95])


class KneserNey:
    """Interpolated modified Kneser-Ney estimates as sorted arrays, one pair of arrays for each order."""

    def __init__(self, ngrams4: np.ndarray, counts: np.ndarray) -> None:
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        keys, n = ngrams4, counts
        for order in range(ORDER, 0, -1):
            self.orders.append(self._order(keys, n))
            if order > 1:
                keys, n = np.unique(keys % CLASSES ** (order - 1), return_counts=True)
        self.orders.reverse()

    @staticmethod
    def _order(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys with their discounted share; contexts with the share left for the lower order."""
        less = discounts(n)[np.minimum(n, 3) - 1] if len(n) else np.zeros(0)
        contexts, where = np.unique(keys // CLASSES, return_inverse=True)
        total = np.bincount(where, weights=n, minlength=len(contexts))
        left = np.bincount(where, weights=less, minlength=len(contexts)) / total if len(n) else total
        share = (n - less) / total[where] if len(n) else np.zeros(0)
        return keys.astype(np.int32), share.astype(np.float32), contexts.astype(np.int32), left.astype(np.float32)

    def table(self) -> np.ndarray:
        """Natural log of the estimate of every possible n-gram, by its number."""
        estimate = lower = np.full(CLASSES, 1 / CLASSES, np.float32)
        for order, (keys, share, contexts, left) in enumerate(self.orders):
            weight = np.ones(CLASSES**order, np.float32)
            weight[contexts] = left
            estimate = np.repeat(weight, CLASSES)
            estimate *= lower
            estimate[keys] += share
            lower = np.tile(estimate, CLASSES) if order + 1 < ORDER else estimate
        return np.log(estimate, out=estimate)


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows that occur twice or more in the list."""
    n = len(words) - window + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        part = hashes[k : k + n]
        mixed = (mixed ^ (part >> np.uint64(29)) ^ part) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window:] -= twice
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; null has nothing and fails."""
    if not text:
        return 0, 0, 0, 0, 0, True
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeated = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, failed


def _measure(texts: list[str | None], table: np.ndarray) -> list[pa.Array]:
    number, first, edges = ngrams(texts)
    logs = table[number]
    logs[edges] = 0
    scored = np.array([len(t or "") + 1 for t in texts], np.int64)
    made = list(zip(*map(base_counts, texts)))
    out = [pa.array(x, pa.int64()) for x in made[:5]]
    return [*out, pa.array(made[5], pa.bool_()), pa.array(scored), pa.array(-np.add.reduceat(logs, first, dtype=np.float64) / scored)]


def measured(docs: DataFrame, model: KneserNey, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row with the base counts and the mean log-perplexity of its text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in keep), *BASE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.table()
        for batch in batches:
            for part in slices(batch, text):
                made = _measure(part.column(text).to_pylist(), table)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=schema.names)

    return map_batches(docs.select(*dict.fromkeys([*keep, text])), run, schema)


def language_bands(rows: DataFrame, lang: str) -> DataFrame:
    """(band_lang, middle, deviation) from the rows that pass the base rules; a row per language, stored."""
    passed = rows.filter(~F.col("base_failed")).select(F.col(lang).alias("band_lang"), "log_perplexity", "n_chars_scored")
    bins = passed.groupBy("band_lang", F.round(F.col("log_perplexity") * BIN).alias("bin")).agg(F.count("*").alias("n"))
    middle = bins.groupBy("band_lang").agg((F.percentile("bin", F.lit(0.5), F.col("n")) / BIN).alias("middle"))
    middle = store(middle, "middle")
    away = passed.join(middle.withColumnRenamed("band_lang", "_l"), F.col("band_lang").eqNullSafe(F.col("_l")))
    distance = F.abs(F.col("log_perplexity") - F.col("middle")) * F.sqrt("n_chars_scored")
    away = away.groupBy("band_lang", "middle", F.round(distance * DISTANCE_BIN).alias("bin")).agg(F.count("*").alias("n"))
    spread = away.groupBy("band_lang", "middle").agg((F.percentile("bin", F.lit(0.5), F.col("n")) / DISTANCE_BIN).alias("mad"))
    return store(spread.select("band_lang", "middle", F.greatest(F.col("mad") * 1.4826, F.lit(LEAST_DEVIATION)).alias("deviation")), "bands")


def _in_band(value: str = "log_perplexity", middle: str = "middle", deviation: str = "deviation") -> Column:
    allowance = F.col(deviation) * WIDTH / F.sqrt("n_chars_scored") + MARGIN
    return ~F.col("base_failed") & F.coalesce(F.abs(F.col(value) - F.col(middle)) <= allowance, F.lit(True))


def quality_rules(docs: DataFrame, keep: list[str], lang: str = "lang", text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row, its base counts, log_perplexity and ``kept``.

    Repeated rows and null ids keep their rows; documents of null language have a band of their own. A null or empty
    text has no words and fails the base rules. A language of one document has that document as its median.
    """
    model = KneserNey(*count_ngrams(docs, text))
    rows = docs.select(*dict.fromkeys([*keep, lang, text])).withColumn("_lang", F.col(lang))
    rows = store(measured(rows, model, [*keep, "_lang"], text), "measured")
    bands = language_bands(rows, "_lang")
    joined = rows.join(bands, F.col("_lang").eqNullSafe(F.col("band_lang")), "left")
    return joined.select(*keep, *[f.name for f in BASE], _in_band().alias("kept"))


def keep_documents(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    model = KneserNey(*count_ngrams(docs, text))
    narrow = docs.select(F.col(lang).alias("_lang"), F.col(text).alias("text"))
    bands = language_bands(store(measured(narrow, model, ["_lang"]), "measured"), "_lang")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    facts = T.StructType([T.StructField("_middle", T.DoubleType()), T.StructField("_deviation", T.DoubleType())])
    held = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    held = held.join(bands, F.col("_lang").eqNullSafe(F.col("band_lang")), "left")
    held = held.select("_row", "_text", F.col("middle").alias(facts[0].name), F.col("deviation").alias(facts[1].name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.table()
        for batch in batches:
            for part in slices(batch, "_text"):
                made = _measure(part.column("_text").to_pylist(), table)
                failed = made[5].to_numpy(zero_copy_only=False)
                deviation = part.column("_deviation").fill_null(np.inf).to_numpy(zero_copy_only=False)
                allowed = deviation * WIDTH / np.sqrt(made[6].to_numpy()) + MARGIN
                away = np.abs(made[7].to_numpy() - part.column("_middle").fill_null(0.0).to_numpy(zero_copy_only=False))
                yield part.select(["_row"]).filter(pa.array(~failed & (away <= allowed)))

    return map_batches(held, run, T.StructType([held.schema["_row"]])).select("_row.*")
