"""Periodic runs against a search over all periods and places."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from tests.conftest import FOLDER
from trailmark.llm import periodic_runs, queries


def naive(words):
    """All runs, by trying every period at every place."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                part = words[i : i + length]
                if not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.add((i, length, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def facts(words):
    runs = naive(words)
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    sha = [
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest(),
    ]
    return (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, *sha)


def periodic_words(rng):
    words = []
    while len(words) < rng.randint(0, 400):
        unit = [rng.choice("abc" if rng.random() < 0.4 else "abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 60]))]
        words += (unit * 7)[: rng.randint(1, 7 * len(unit))]
        words += [rng.choice("abcdefgh") for _ in range(rng.choice([0, 0, 3, 20]))]
    return words


def test_runs_of_made_texts(monkeypatch):
    rng = random.Random(3)
    for short in (2, 8):
        monkeypatch.setattr(periodic_runs, "SHORT", short)
        for _ in range(250):
            words = periodic_words(rng)
            ids = np.array([ord(w) for w in words], np.int64)
            assert periodic_runs.find_runs(ids, len(ids)) == naive(words), words


def test_texts_share_a_slice(spark):
    rng = random.Random(8)
    texts = [None, "", " \n", "a", "x " * 30, "a b " * 3, "ä b " * 9, "a\x1cb " * 8] + [" ".join(periodic_words(rng)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in periodic_runs.periodic_runs(df, ["doc_id"]).collect()}
    for number, text in enumerate(texts):
        words = re.findall("[^\x20\x09-\x0D]+", text or "")
        assert [tuple(x) for x in found[number].runs] == naive(words)
        assert found[number].n == len(words)


def test_long_run_and_large_period(spark):
    rng = random.Random(4)
    unit = [str(rng.randrange(10**6)) for _ in range(3_001)]
    texts = ["w " * 200_000, " ".join(["s"] + unit * 4 + unit[:7]), " ".join(unit * 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.periodic_runs(df, ["doc_id"]).collect()}
    assert found == {0: [(0, 200_000, 1)], 1: [(1, 4 * 3_001 + 7, 3_001)], 2: []}


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.periodic_runs(empty, ["doc_id"]).count() == 0
    df = spark.createDataFrame([(1, "a a a a a a", 5, "r", 2)], "doc_id long, text string, n int, _text string, runs int")
    row = periodic_runs.periodic_runs(df, df.columns).first().asDict(recursive=True)
    assert row == {
        "doc_id": 1, "text": "a a a a a a", "_text": "r", "n": 6, "runs": [{"start": 0, "length": 6, "period": 1}],
        "strongest": {"start": 0, "length": 6, "period": 1}, "collapsed": "a",
    }


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r)[1:] for r in queries.queries()["op13_periodic_runs"](spark, FOLDER).collect()}
    assert len(found) == len(docs)
    for r in docs:
        words = re.findall("[^\x20\x09-\x0D]+", r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n < 800:
            assert found[r.doc_id] == facts(words)
