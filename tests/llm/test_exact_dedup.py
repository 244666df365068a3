"""Exact duplicates by block naming against plain grouping."""

from __future__ import annotations

import hashlib
import random

import pytest

from tests.conftest import FOLDER
from trailmark.llm import exact_dedup, queries

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault((text or "").translate(FOLD), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            out.append((i, top, len(ids), i == top and first, digest))
            first = first and i != top
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_equal_to_grouping(spark, monkeypatch, block):
    monkeypatch.setattr(exact_dedup, "BLOCK", block)
    rng = random.Random(block)
    texts = [None, "", "a", "A", "Ä", "ä", "aaa", "aaaa", "aaaaaa", "\x00", "abcabc", "ABCabcab"]
    texts += ["".join(rng.choice("aAbß") for _ in range(rng.randint(0, 9))) for _ in range(150)]
    texts += ["x" * 20_000, "x" * 20_001, "X" * 20_000, "x" * 8_192, "x" * 4_096] if block > 1 else []
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(3, "A"), (3, "A")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(exact_dedup.exact_groups(df, ["doc_id"])) == expected(rows)


def test_blocks_are_forgotten_within_a_task(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HELD_ROWS", 3)
    monkeypatch.setattr("trailmark.llm.common.SLICE_ROWS", 2)
    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert found(exact_dedup.exact_groups(df, ["doc_id"])) == expected(rows)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(empty, ["doc_id"]).count() == 0
    rows = [(1, "a", 7, "k", 1, 2, 3), (2, "A", 8, None, 4, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, name int, block string, row int, kept int, level int")
    out = exact_dedup.exact_groups(df, df.columns).orderBy("doc_id").collect()
    assert [(r.doc_id, r.name, r.block, r.row, r.level, r.kept, r.keep_id) for r in out] == [(1, 7, "k", 1, 3, False, 2), (2, 8, None, 4, 6, True, 2)]
    assert [tuple(r) for r in exact_dedup.drop_exact_duplicates(df).collect()] == [rows[1]]


def test_names_differ_where_texts_do(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK", 2)
    rows = [(i, t) for i, t in enumerate(["aabb", "bbaa", "aab", "aa", "aabbaabb", "aabbaab", "aabbaabb"])]
    named = exact_dedup.name_documents(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    names = {r._row.doc_id: (r.level, r.name) for r in named.collect()}
    assert len(set(names.values())) == 6 and names[4] == names[6] and names[4][0] == 2


def test_query_reads_whole_tables(spark):
    assert found(queries.queries()["op11_exact_dedup"](spark, FOLDER)) == expected(
        [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    )
