"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Labelled documents (a bounded sample, ``SAMPLE``) are dealt by a hash into three parts: from the first the lexicon is
learnt, words and word beginnings that stand in toxic documents far more often than in others; on the second the trees
are fitted; on the third their probabilities are calibrated. Features are densities of the learnt and of a fixed lexicon
(as written, and after undoing look-alike characters), how near they stand to a second-person word, capitals,
punctuation and obfuscation rates. Trees and calibration are Spark ML's; scoring stays on the executors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import map_batches, per_text
from trailmark.llm.text_features import UPPER, byte_classes, labelled_sample, letter_words
from trailmark.plans.lineage import store

#: Labelled documents that lexicon, trees and calibration are fitted on together, in expectation.
SAMPLE = 15_000
#: In how many toxic documents a word or beginning must stand to enter the learnt lexicon.
LEAST_DOCUMENTS = 5
#: How many times likelier in a toxic document an entry of the lexicon must be.
LEAST_RATIO = 4.0
#: Lengths, in characters, of the word beginnings that are tried.
BEGINNINGS = (4, 5, 6)
INSULTS = frozenset(b"idiot moron stupid loser pathetic worthless trash scum disgusting clown dumb filthy hate kill".split())
SECOND_PERSON = frozenset(b"you your yours yourself tu te toi vous votre vos du dich dir dein ihr euch usted ustedes tus".split())
NEAR = 6
_LOOKS = str.maketrans("0134578@$!|", "oieastbasil")
_HIDDEN = re.compile(r"[a-zA-Z][*@$!#%0134578.\-_]+[a-zA-Z]")
_SPACED_OUT = re.compile(r"\b(?:[a-zA-Z][ .\-_]){3,}[a-zA-Z]\b")
_KEEP_LETTERS = re.compile(r"[^a-z\s]+")

FEATURES = (
    "fixed", "learnt", "begun", "unmasked", "near_second_person", "second_person", "weight", "capitals",
    "exclamations", "punctuation", "obfuscated", "any_word", "begun_count", "begun_distinct", "begun_most", "words",
)


def beginnings(word: bytes) -> list[bytes]:
    chars = word.decode("utf-8", "replace")
    return [chars[:n].encode("utf-8", "replace") for n in BEGINNINGS if len(chars) >= n]


class Lexicon:
    """Learnt words and beginnings with their log ratios."""

    def __init__(self, words: dict[bytes, float], begin: dict[bytes, float]) -> None:
        self.words, self.begin, self.known = words, begin, {}

    def weigh(self, word: bytes) -> tuple[bool, bytes, float]:
        """Whether the word is learnt, its heaviest learnt beginning (or none), and its weight; cached."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            begun = max(((self.begin[b], b) for b in beginnings(word) if b in self.begin), default=(0.0, b""))
            found = word in self.words, begun[1], max(self.words.get(word, 0.0), begun[0])
            self.known[word] = found
        return found

    def features(self, text: str | None) -> list[float]:
        """The dense features of one text, rates per word; zeros for a null or empty text."""
        words = letter_words(text)
        if not words:
            return [0.0] * len(FEATURES)
        n = len(words)
        weighed = list(map(self.weigh, words))
        bad = [w in INSULTS for w in words]
        fixed, learnt, weight = sum(bad), sum(x[0] for x in weighed), sum(x[2] for x in weighed)
        begun = Counter(x[1] for x in weighed if x[1])
        people = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = 0
        if people and (fixed or weight):
            hits = np.array([i for i, x in enumerate(weighed) if x[2] or bad[i]])
            at = np.searchsorted(people, hits)
            around = np.array([-(10**9), *people, 10**9])
            near = int(((hits - around[at] <= NEAR) | (around[at + 1] - hits <= NEAR)).sum())
        hidden, spaced, unmasked = _HIDDEN.findall(text), _SPACED_OUT.findall(text), 0
        if hidden or spaced:
            plain = _SPACED_OUT.sub(lambda m: re.sub(r"[^a-zA-Z]", "", m[0]), text).lower().translate(_LOOKS)
            again = Counter(_KEEP_LETTERS.sub("", plain).encode().split())
            unmasked = max(0, sum(c for w, c in again.items() if w in INSULTS or w in self.words) - fixed)
        classes = byte_classes(text)
        size, marks = max(1, int(classes.sum())), text.count("!")
        return [
            fixed / n, learnt / n, sum(begun.values()) / n, unmasked / n, near / n, len(people) / n, weight / n,
            float(classes[UPPER]) / size, marks / n, (text.count("?") + marks + text.count(".")) / n,
            (len(hidden) + len(spaced)) / n, float(fixed + learnt + unmasked > 0),
            float(sum(begun.values())), float(len(begun)), max(begun.values(), default=0) / n, float(n),
        ]


def _part(number: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) == number


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """The words and beginnings of toxic documents of (text, y); counts are summed by Spark, all that are telling come back.

    The sample bounds them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                words = set(letter_words(text))
                into = toxic if y else clean
                into.update((0, w) for w in words)
                into.update((1, b) for b in {b for w in words for b in beginnings(w)})
                into[2, b""] += 1
        keys = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.int32()), pa.array([t for _, t in keys], pa.binary()),
             pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())],
            names=["kind", "token", "toxic", "clean"],
        )

    counts = map_batches(sample.select("text", "y"), run, "kind int, token binary, toxic long, clean long")
    counts = store(counts.groupBy("kind", "token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "lexicon")
    total = counts.filter("kind = 2").first()
    if total is None or not total.toxic:
        return Lexicon({}, {})
    ratio = (F.col("toxic") / float(total.toxic)) / ((F.col("clean") + 0.5) / float(total.clean + 1))
    best = counts.filter((F.col("kind") < 2) & (F.col("toxic") >= LEAST_DOCUMENTS)).withColumn("ratio", ratio)
    best = best.filter(F.col("ratio") >= LEAST_RATIO)
    found: list[dict[bytes, float]] = [{}, {}]
    for r in best.collect():
        found[r.kind][bytes(r.token)] = float(np.log(r.ratio))
    return Lexicon(*found)


def with_features(docs: DataFrame, lexicon: Lexicon, keep: list[str], text: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        features = shared.value.features

        def work(texts: list[str | None]) -> list[pa.Array]:
            return [pa.array([features(t) for t in texts], pa.list_(pa.float64()))]

        return work

    return per_text(docs, keep, [T.StructField("features", T.ArrayType(T.DoubleType()))], make, text)


class ToxicityModel:
    """Lexicon, trees and calibration; without both labels to learn from it scores every text with the base rate."""

    def __init__(self, lexicon: Lexicon, trees=None, calibration=None, rate: float = 0.0) -> None:
        self.lexicon, self.trees, self.calibration, self.rate = lexicon, trees, calibration, rate

    def score(self, docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
        """Columns ``keep`` of every row and ``score``, the calibrated chance of a toxic text."""
        if self.trees is None:
            return docs.select(*keep, F.lit(float(self.rate)).alias("score"))
        rows = with_features(docs, self.lexicon, keep, text)
        rows = _raw(self.trees, rows, keep)
        return self.calibration.transform(rows).select(*keep, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))).alias("score"))


def _raw(trees, rows: DataFrame, keep: list[str]) -> DataFrame:
    made = trees.transform(rows.withColumn("vector", array_to_vector("features")))
    return made.select(*keep, F.element_at(vector_to_array("probability"), 2).alias("raw"))


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, most: int = SAMPLE) -> ToxicityModel:
    """Fit on a sample of the labelled rows for which ``may_learn`` (over doc_id) holds."""
    sample = store(labelled_sample(docs.select("doc_id", "text"), labels, "toxic", may_learn, most), "sample")
    lexicon = learn_lexicon(sample.filter(_part(0)))
    rows = store(with_features(sample.filter(~_part(0)), lexicon, ["doc_id", "y"]), "features").coalesce(4)
    trained, tested = rows.filter(_part(1)), rows.filter(_part(2))
    seen = {r.y: r.n for r in trained.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(seen.values())
    if len(seen) < 2 or tested.isEmpty():
        return ToxicityModel(lexicon, rate=sum(y * n for y, n in seen.items()) / total if total else 0.0)
    ready = trained.select(array_to_vector("features").alias("vector"), F.col("y").cast("double").alias("y"))
    trees = GBTClassifier(
        featuresCol="vector", labelCol="y", maxIter=12, maxDepth=3, stepSize=0.3, maxBins=32, minInstancesPerNode=4,
        seed=5, cacheNodeIds=False,
    ).fit(ready)
    raw = _raw(trees, tested.select("y", "features"), ["y"]).select(F.col("y").cast("double").alias("y"), "raw")
    calibration = IsotonicRegression(featuresCol="raw", labelCol="y", predictionCol="score").fit(raw)
    return ToxicityModel(lexicon, trees, calibration)
