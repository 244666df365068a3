"""Features of a text that the quality and toxicity models share: words, byte classes, repetition."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of ASCII characters that are no letters become blanks; letters must be lowered before.
_WORDS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
UPPER, LOWER, DIGIT, BLANK, LINE, STOP, SYMBOL, OTHER = range(8)


def _byte_class(b: int) -> int:
    char = chr(b)
    if b >= 128 or "a" <= char <= "z":
        return LOWER
    if "A" <= char <= "Z":
        return UPPER
    if char.isdigit():
        return DIGIT
    if char == "\n":
        return LINE
    if char in " \t\r":
        return BLANK
    if char in ".,;:'\"-()":
        return STOP
    return SYMBOL if char in "#*$%&|<>!?@_~^=+" else OTHER


_CLASSES = np.array([_byte_class(b) for b in range(256)], np.uint8)


def letter_words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def byte_classes(text: str | None) -> np.ndarray:
    """How many bytes of each class the text has."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return np.bincount(_CLASSES[raw], minlength=8)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, most: int) -> DataFrame:
    """Rows of ``docs`` with ``y``: about ``most`` documents at most that carry a label and may be learnt from.

    They are chosen by a hash of the doc_id. Rows of ``labels`` with the same doc_id count once, by their largest value;
    null labels and labels of documents that are not there are left out.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & may_learn)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    share = min(1.0, most / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.join(known, "doc_id")


def reduced(values: np.ndarray, sizes: Sequence[int] | np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; an empty run gives zeros."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]
