"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its hashed words (each with the same weight, together of length 1) and one bin of every
statistic. The score is sigmoid(w0 + sum w_i x_i + pairs), where the pairwise part, sum over i < j of <v_i, v_j> x_i x_j,
is computed in linear time as half of (sum v_i x_i)^2 - sum (v_i x_i)^2 in each of the ``RANK`` dimensions.

Features are extracted by Spark; the model is fitted by AdaGrad on a bounded sample (``SAMPLE`` labelled documents), so
it has the same size for every corpus: (``WORDS`` + bins) x (``RANK`` + 1) numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import map_batches, per_text, slices
from trailmark.llm.text_features import (
    BLANK, DIGIT, LINE, SYMBOL, UPPER, byte_classes, labelled_sample, letter_words, reduced,
)

#: Labelled documents that the model is fitted on, in expectation.
SAMPLE = 8_000
WORDS, RANK, BINS = 4_096, 6, 12
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.08, 1e-4
#: Upper ends of the bins of shares; the last bin is open. Lengths use powers of two instead.
_SHARES = np.array([0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.7])
STATISTICS = ("upper", "digits", "symbols", "lines", "distinct_words", "same_as_last", "repeated_lines", "word_length", "n_words", "n_chars")
WIDTH = WORDS + BINS * len(STATISTICS)


def statistics(text: str | None, words: list[bytes], n_chars: int) -> list[int]:
    """The bin of each statistic; shares of nothing are 0. ``n_chars`` is the metadata's length."""
    classes = byte_classes(text)
    size, n = max(1, int(classes.sum())), max(1, len(words))
    lines = [x for x in (text or "").split("\n") if x]
    shares = [
        classes[UPPER] / size, classes[DIGIT] / size, classes[SYMBOL] / size,
        classes[LINE] / max(1, int(classes[LINE] + classes[BLANK])), len(set(words)) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, 1 - len(set(lines)) / max(1, len(lines)),
        sum(map(len, words)) / n / 20,
    ]
    lengths = [min(BINS - 1, len(words).bit_length()), min(BINS - 1, max(0, n_chars).bit_length() // 2)]
    return np.searchsorted(_SHARES, shares, side="left").tolist() + lengths


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one document; a null length is the text's own."""
    words = letter_words(text)
    hashed = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % WORDS
    hashed = np.flatnonzero(np.bincount(hashed, minlength=WORDS)) if len(words) else np.zeros(0, np.int64)
    bins = statistics(text, words, len(text or "") if n_chars is None else n_chars)
    index = np.concatenate([hashed, WORDS + BINS * np.arange(len(bins)) + bins]).astype(np.int32)
    value = np.ones(len(index), np.float32)
    value[: len(hashed)] = 1 / max(1.0, len(hashed)) ** 0.5
    return index, value


class FactorizationMachine:
    """Weights and factors; ``scores`` is linear in the number of features."""

    def __init__(self, width: int = WIDTH, rank: int = RANK, seed: int = 7) -> None:
        self.bias, self.weights = 0.0, np.zeros(width)
        self.factors = np.random.default_rng(seed).normal(0, 0.05, (width, rank))

    def _parts(self, index: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        spread = self.factors[index] * value[:, None]
        sums = reduced(spread, sizes)
        pairs = 0.5 * (sums**2 - reduced(spread**2, sizes)).sum(axis=1)
        return self.bias + reduced(self.weights[index] * value, sizes) + pairs, spread, sums

    def scores(self, index: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._parts(index, value, sizes)[0], -30, 30)))

    def fit(self, index: np.ndarray, value: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> FactorizationMachine:
        """AdaGrad on the log loss; features of row r are those after the sizes of the rows before it."""
        if len(y) == 0:
            return self
        rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.bias = float(np.log(rate / (1 - rate)))
        begin, random = np.cumsum(sizes) - sizes, np.random.default_rng(11)
        seen_w, seen_v = np.full(self.weights.shape, 1e-2), np.full(self.factors.shape, 1e-2)
        for _ in range(EPOCHS):
            order = random.permutation(len(y))
            for k in range(0, len(order), BATCH):
                rows = order[k : k + BATCH]
                n = sizes[rows]
                at = np.repeat(begin[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                i, x = index[at], value[at]
                raw, spread, sums = self._parts(i, x, n)
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) / len(rows)
                each = np.repeat(error, n)
                self.bias -= RATE * float(error.sum())
                used, where = np.unique(i, return_inverse=True)
                step_w = np.bincount(where, weights=each * x, minlength=len(used)) + DECAY * self.weights[used]
                grad = (each * x)[:, None] * (np.repeat(sums, n, axis=0) - spread)
                step_v = np.stack([np.bincount(where, weights=g, minlength=len(used)) for g in grad.T], axis=1) + DECAY * self.factors[used]
                seen_w[used] += step_w**2
                seen_v[used] += step_v**2
                self.weights[used] -= RATE * step_w / np.sqrt(seen_w[used])
                self.factors[used] -= RATE * step_v / np.sqrt(seen_v[used])
        return self


def _gather(texts: list[str | None], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    made = [features(t, n) for t, n in zip(texts, n_chars)]
    sizes = np.array([len(i) for i, _ in made], np.int64)
    return np.concatenate([i for i, _ in made]), np.concatenate([v for _, v in made]), sizes


def _measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns that are read; a table without n_chars has null there."""
    length = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.select(*keep, F.col(text).alias("text"), length.cast("long").alias("n_chars"))


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, most: int = SAMPLE) -> FactorizationMachine:
    """Fit on a sample of the labelled rows for which ``may_learn`` (over doc_id) holds; without labels, score 0.5.

    The sampled documents' features, not their texts, come to the driver: at most some 300 numbers a document.
    """
    sample = labelled_sample(_measured(docs), labels, "quality", may_learn, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                index, value, sizes = _gather(part.column("text").to_pylist(), part.column("n_chars").to_pylist())
                starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                nested = [pa.ListArray.from_arrays(starts, pa.array(x)) for x in (index, value)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), *nested], names=["doc_id", "y", "i", "x"])

    rows = map_batches(sample, run, "doc_id long, y int, i array<int>, x array<float>").toArrow()
    if rows.num_rows == 0:
        return FactorizationMachine()
    rows = rows.sort_by("doc_id").combine_chunks()
    i, x = rows.column("i").combine_chunks(), rows.column("x").combine_chunks()
    sizes = np.array(i.value_lengths().to_numpy(), np.int64)
    y = rows.column("y").to_numpy().astype(np.float64)
    return FactorizationMachine().fit(i.flatten().to_numpy(), x.flatten().to_numpy(), sizes, y)


def score_quality(docs: DataFrame, model: FactorizationMachine, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row and ``score``, the chance of label 1; null and empty texts are scored by length."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scores = shared.value.scores

        def work(texts: list[str | None], n_chars: list[int | None]) -> list[pa.Array]:
            return [pa.array(scores(*_gather(texts, n_chars)))]

        return work

    fields = [T.StructField("score", T.DoubleType())]
    return per_text(_measured(docs, tuple(keep), text), keep, fields, make, also=["n_chars"])
