"""Language identification, word first: known words score by their log frequency in each language, unseen words by the
longest character n-grams that are known.

Words and n-grams are counted by Spark over a bounded sample of labelled documents (``SAMPLE`` of each language, chosen
by a hash of the row). All of them make the model, so what is broadcast is bounded by the sample, whatever the corpus.
Every document is scored, whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import filter_texts, map_batches, per_text, remainder, slices

#: Labelled documents of each language that the model is learnt from, in expectation.
SAMPLE = 4_000
LONGEST = 4
UNKNOWN = "und"
#: A text counts as at most so many words when its score is made a probability.
EVIDENCE = 12.0
#: Documents whose score is below this are rejected by the filter.
LEAST_SCORE = 0.5

_LETTER = re.compile(r"[^\W\d_]")
#: Bytes of ASCII characters that are no letters become blanks.
_TABLE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def letter_words(text: str | None) -> list[bytes]:
    """Runs of letters and non-ASCII characters, lower case, as UTF-8; none for a text without a letter."""
    if not text or not _LETTER.search(text):
        return []
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


def grams(word: bytes, n: int) -> list[str]:
    """The word's character n-grams, with a mark at both ends for n above 1."""
    chars = word.decode("utf-8", "replace")
    if n == 1:
        return list(chars)
    chars = f"^{chars}$"
    return [chars[i : i + n] for i in range(len(chars) - n + 1)]


def _sample(docs: DataFrame, per_language: int) -> DataFrame:
    """A hash-chosen share of the rows of each language, so that each gives about ``per_language`` rows at most."""
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    large = {k: int(per_language / n * 1_000_000) for k, n in sizes.items() if n > per_language}
    if not large:
        return docs
    share = F.coalesce(F.create_map(*[F.lit(x) for kv in large.items() for x in kv])[F.col("lang")], F.lit(1_000_000))
    return docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share)


class WordFirst:
    """Log frequencies of words and n-grams per language."""

    def __init__(self, langs: list[str], counts: dict[int, dict[str | bytes, np.ndarray]], totals: np.ndarray) -> None:
        """``counts[0]`` holds words, ``counts[n]`` n-grams; ``totals`` the sum of each kind (rows) and language."""
        self.langs, self.tables = langs, []
        for kind in range(LONGEST + 1):
            found = counts.get(kind, {})
            rows = {token: i for i, token in enumerate(found)}
            n = np.array(list(found.values()), np.float64).reshape(len(found), len(langs))
            smooth = 0.5
            self.tables.append((rows, np.log((n + smooth) / (totals[kind] + smooth * (len(found) + 1))).astype(np.float32)))
        self.limit = max(10_000, 2_000_000 // max(1, len(langs)))

    def start(self) -> WordFirst:
        """Make room for unseen words; called once per task."""
        self.seen: dict[bytes, int] = {}
        self.vectors = np.zeros((self.limit, len(self.langs)), np.float32)
        return self

    def unseen(self, word: bytes) -> np.ndarray:
        """Mean over the known n-grams of the longest length that has any; zeros where no character is known."""
        for n in range(LONGEST, 0, -1):
            rows, logs = self.tables[n]
            known = [rows[g] for g in grams(word, n) if g in rows]
            if known:
                return logs[known].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ties go to the language that sorts first."""
        words = [letter_words(t) for t in texts]
        size = np.array([len(w) for w in words], np.int64)
        if not self.langs or not size.sum():
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        flat = [w for ws in words for w in ws]
        rows, logs = self.tables[0]
        index = np.fromiter(map(rows.get, flat, repeat(-1)), np.int64, len(flat))
        base = len(logs)
        for p in np.flatnonzero(index < 0).tolist():
            word = flat[p]
            at = self.seen.get(word)
            if at is None:
                at = len(self.seen)
                if at == len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                self.vectors[at] = self.unseen(word)
                self.seen[word] = at
            index[p] = base + at
        owner = np.repeat(np.arange(len(texts)), size)
        every = np.concatenate([logs, self.vectors[: len(self.seen)]])
        mean = np.stack(
            [np.bincount(owner, weights=every[index, k], minlength=len(texts)) for k in range(len(self.langs))], axis=1
        ) / np.maximum(size, 1)[:, None]
        if len(self.seen) > self.limit:
            self.start()
        lift = (mean - mean.max(axis=1, keepdims=True)) * np.minimum(size, EVIDENCE)[:, None]
        best = mean.argmax(axis=1)
        score = 1 / np.exp(lift).sum(axis=1)
        return (
            [self.langs[b] if n else UNKNOWN for b, n in zip(best.tolist(), size.tolist())],
            np.where(size > 0, score, 0.0),
        )


def learn(docs: DataFrame, per_language: int = SAMPLE) -> WordFirst:
    """Learn from rows (doc_id, text, lang) with a language; the caller chooses which rows may be learnt from."""
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull())
    sample = _sample(labelled, per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            """The words counted so far and, from each distinct one, its n-grams."""
            out: Counter = Counter()
            for (lang, word), n in found.items():
                out[lang, 0, word] = n
                for k in range(1, LONGEST + 1):
                    for gram in grams(word, k):
                        out[lang, k, gram.encode("utf-8", "replace")] += n
            lang, kind, token = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(kind, pa.int32()), pa.array(token, pa.binary()), pa.array(list(out.values()), pa.int64())],
                names=["lang", "kind", "token", "n"],
            )

        for batch in batches:
            for part in slices(batch, "text"):
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    found.update((lang, word) for word in letter_words(text))
                if len(found) > 300_000:
                    yield rows()
                    found.clear()
        yield rows()

    counts = map_batches(sample, run, "lang string, kind int, token binary, n long")
    counts = counts.groupBy("lang", "kind", "token").agg(F.sum("n").alias("n"))
    langs = sorted(r.lang for r in labelled.select("lang").distinct().collect())
    found = counts.toArrow()
    totals = np.zeros((LONGEST + 1, len(langs)))
    tables: dict[int, dict] = {}
    where = {x: i for i, x in enumerate(langs)}
    columns = (found.column(c).to_pylist() for c in ("lang", "kind", "token", "n"))
    for lang, kind, token, n in zip(*columns):
        token = token if kind == 0 else token.decode("utf-8", "replace")
        tables.setdefault(kind, {}).setdefault(token, np.zeros(len(langs)))[where[lang]] += n
        totals[kind, where[lang]] += n
    totals = np.maximum(totals, 1)
    return WordFirst(langs, tables, totals)


def predict_languages(docs: DataFrame, model: WordFirst, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row, ``lang_pred`` and ``score``; ``und`` and 0 for a text without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = shared.value.start().predict

        def work(texts: list[str | None]) -> list[pa.Array]:
            lang, score = predict(texts)
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return per_text(docs, keep, fields, make, text)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows a model may be learnt from: those whose key's remainder is not 2 (of 4)."""
    return docs.filter(F.coalesce(remainder("doc_id", 4) != 2, F.lit(False)))


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is found with a score of at least ``least``, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(learnable(docs)))

    def make():
        predict = shared.value.start().predict

        def work(texts: list[str | None]) -> np.ndarray:
            lang, score = predict(texts)
            return (np.array(lang, object) != UNKNOWN) & (score >= least)

        return work

    return filter_texts(docs, make, text)
