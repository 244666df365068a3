"""The open language model against brute force: scripts keep their letters, the model grows, texts do not vouch for themselves."""

import ctypes
import math
import random
import resource
import tracemalloc
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailmark.llm import code_points, common

SCHEMA = "doc_id long, text string, lang string, kept string"


def corpus():
    rng, rows = random.Random(5), []
    words = {
        "ru": "и в не на что он как это все она так его но да ты к у же вы за бы по только мне было вот от меня".split(),
        "el": "και το να του η της με που την από για είναι στο ένα δεν τα ο οι στην θα τις αυτό μας πως".split(),
    }
    for i in range(160):
        lang = ("ru", "el")[i % 2]
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(30, 90))), lang, "x"))
    letters = {"ru": "".join(map(chr, range(0x430, 0x450))), "el": "".join(map(chr, range(0x3B1, 0x3CA)))}
    for i in range(6):
        lang = ("ru", "el")[i % 2]
        rows.append((1000 + i, " ".join("".join(rng.choice(letters[lang]) for _ in range(4)) for _ in range(50)), lang, "x"))
    return rows + [(2000, None, "ru", "x"), (2001, "", "el", "x"), (None, "a\0b 日本語 😀 " * 9, None, "x"), rows[0], (3, "one\0", "ru", "x")]


def brute(texts, halves):
    """Mean log-perplexity of each text by dictionaries over the other half."""
    order, edge = code_points.ORDER, code_points.EDGE
    padded = [edge * (order - 1) + (t or "").replace("\0", "\ufffe") + edge for t in texts]
    grams = [[p[i : i + order] for i in range(len(p) - order + 1)] for p in padded]
    floor = 1 / (len({g[-1] for own in grams for g in own}) + 1)
    models = []
    for half in (0, 1):
        counts = {order: Counter(g for own, h in zip(grams, halves) if h == half for g in own)}
        for n in range(order - 1, 0, -1):
            counts[n] = Counter(g[1:] for g in counts[n + 1])
        cuts, total, left = {}, {}, {}
        for n in range(1, order + 1):
            often = Counter(counts[n].values())
            cuts[n] = [0.5, 0.75, 0.9]
            if min(often[k] for k in (1, 2, 3, 4)):
                y = often[1] / (often[1] + 2 * often[2])
                cuts[n] = [min(max(k - (k + 1) * y * often[k + 1] / often[k], 0.05), k - 0.05) for k in (1, 2, 3)]
            total[n], left[n] = Counter(), defaultdict(float)
            for g, c in counts[n].items():
                total[n][g[:-1]] += c
                left[n][g[:-1]] += cuts[n][min(c, 3) - 1]
        models.append((counts, cuts, total, left))

    def estimate(model, g):
        if not g:
            return floor
        counts, cuts, total, left = (x[len(g)] for x in model)
        below, c, context = estimate(model, g[1:]), counts[g], g[:-1]
        if not total[context]:
            return below
        return ((c - cuts[min(c, 3) - 1] if c else 0) + left[context] * below) / total[context]

    return [-sum(math.log(estimate(models[1 - h], g)) for g in own) / len(own) for own, h in zip(grams, halves)]


@pytest.mark.parametrize("hot", [0, 700, code_points.HOT])
def test_open_model_equals_brute_force_and_rejects_garbage_of_any_script(spark, monkeypatch, hot):
    monkeypatch.setattr(code_points, "HOT", hot)
    monkeypatch.setattr(code_points, "HELD", 500)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    halves = [r.h for r in docs.select(F.xxhash64("text").bitwiseAND(F.lit(1)).alias("h")).collect()]
    made = code_points.quality_rules(docs, ["doc_id", "text", "lang"]).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in made) == sorted((str(r[0]), str(r[1])) for r in rows)
    want = {r[1]: p for r, p in zip(rows, brute([r[1] for r in rows], halves))}
    assert all(abs(r.log_perplexity - want[r.text]) < 1e-4 for r in made)
    real = [r.kept for r in made if r.doc_id is not None and r.doc_id < 1000 and len(r.text) > 10]
    assert sum(real) > 0.9 * len(real)
    assert not any(r.kept for r in made if 1000 <= (r.doc_id or 0) < 2000)
    kept = code_points.keep_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str((r.doc_id, r.text)) for r in made if r.kept)


def test_the_model_grows_with_the_alphabet(spark):
    docs = spark.range(300).select(F.concat(F.expr("char(19968)"), F.col("id").cast("string"), F.lit(" words")).alias("_text"), (F.col("id") % 2).alias("_half"))
    model = code_points.estimates(code_points.merge_buckets(code_points.count_ngrams(docs, 5)))
    padded = [code_points.EDGE * 5 + r._text + code_points.EDGE for r in docs.collect()]
    assert model.count() == len({p[i : i + 6] for p in padded for i in range(len(p) - 5)}) == model.select("hash").distinct().count()
    assert model.agg(F.sum("n")).first()[0] == sum(len(p) - 5 for p in padded)


def test_packing_is_lossless():
    rng = np.random.default_rng(3)
    points = rng.integers(1, 0x10FFFF, (500, 6)).astype(np.uint64)
    mid, out = points[:, 2] << 42 | points[:, 3] << 21 | points[:, 4], points[:, 1] << 42 | points[:, 0] << 21 | points[:, 5]
    grams = code_points._together([(mid, out, rng.integers(0, 2**40, 500), rng.integers(0, 9, 500))])
    for x, y in zip(grams, code_points._unpacked(code_points._packed(grams))):
        assert (x == y).all()
    assert [len(x) for x in code_points._unpacked(code_points._packed(tuple(g[:0] for g in grams)))] == [0] * 4


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert code_points.quality_rules(empty, ["doc_id"]).isEmpty() and code_points.keep_documents(empty).isEmpty()


class _Rows:
    """Stands for a table whose task function is taken out and called here."""

    def __init__(self, session):
        self.sparkSession = session

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_counting_holds_little_besides_the_ngrams(spark, monkeypatch):
    monkeypatch.setattr(code_points, "HELD", 200_000)
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 10_000))) for _ in range(60)]
    task = code_points.count_ngrams(_Rows(spark), 8)
    batches = (pa.RecordBatch.from_pydict({"_text": [t], "_half": [i % 2]}) for i, t in enumerate(texts))
    tracemalloc.start()
    try:
        total = sum(int(n[2].sum() + n[3].sum()) for made in task(batches) for n in map(code_points._unpacked, made.column("grams").to_pylist()))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total == 60 * 10_001
    assert most < 110 * code_points.HELD


def test_workers_give_memory_back(spark):
    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("the C library cannot")

    def held():
        return int(Path("/proc/self/statm").read_text().split()[1]) * resource.getpagesize() / 1e6

    pins = []

    def run(batches):
        blocks = [np.ones(4_000) for _ in range(6_000)]
        pins.append(np.ones(4_000))
        yield held()
        del blocks

    before = held()
    [during] = common.map_batches(_Rows(spark), run, "")(iter([]))
    assert held() - before < (during - before) / 2


def test_scoring_holds_little_besides_the_model():
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 10_000))) for _ in range(100)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "_text": texts, "_half": [i % 2 for i in range(100)]})
    keys = np.unique(code_points.ngrams(texts[:50])[2])
    logs, table = np.full((2, len(keys)), -1.0, np.float32), np.zeros(40**4, np.float32)
    names = ["doc_id", *(f.name for f in code_points.MEASURES), "_id", "_rare", "_hash", "_times", "_which"]
    rows, rare = 0, 0
    tracemalloc.start()
    try:
        for made in code_points.scored(iter([batch]), keys, logs, table, names, 7 << 33):
            ids = made.column("_id").to_numpy()
            if made.column("_hash").null_count:
                assert ids.tolist() == [(7 << 33) + n for n in made.column("doc_id").to_pylist()]
                rows, rare = rows + made.num_rows, rare + sum(made.column("_rare").to_pylist())
            else:
                rare -= sum(made.column("_times").to_pylist())
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 100 and rare == 0
    assert most < 30e6


def test_tasks_that_do_not_encode_let_encoders_go(spark, monkeypatch):
    held = {"one": object()}
    monkeypatch.setattr(common, "_ENCODERS", held)
    list(common.map_batches(_Rows(spark), lambda batches: batches, "", encodes=True)(iter([])))
    assert held
    list(common.map_batches(_Rows(spark), lambda batches: batches, "")(iter([])))
    assert not held
