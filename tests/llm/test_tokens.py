"""Cached encoding, packing and token files against the plain tokenizer."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trailmark.llm import packing, token_files
from trailmark.llm.common import BARE, SPACED, ChunkEncoder, uneven
from trailmark.plans.lineage import new_folder

FILES = {"byte_bpe_50k.json": SPACED, "word_bpe_49k.json": BARE}
ODD = [
    "", " ", "\n", "a  b\n\n c \t d\x1c!\x1d x", "\u3000é́ a\u2003b <|endoftext|> it's  'S I'LL\r\n", "x \n y", "ΣΑΣ Σ",
    "word, word. word\nWord,\nword.", "12345 a1b2!!..,,", "ﬁne İstanbul ß ª º µ", "日本語 テキスト", "a\x00b \x85 c", "tail ", " head", "end\n",
]
SCHEMA = "doc_id long, text string, length string"


def plain(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_cached_ids_equal_the_tokenizer(name):
    encoder, ids = ChunkEncoder(public_tokenizers.path(name), FILES[name]), plain(name)
    encoder.MOST = 30
    alphabet = st.sampled_from("ab Zé.,'!1\n\t\u00a0\u2028\x1f́Σσ#")

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet, max_size=40))
    def same(text):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids(text)

    same()
    for text in ODD * 2:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids(text), text
    assert encoder.encode(None) == b""


def documents(spark):
    rows = [(i, "some words of text, again and again. " * (i * 7 % 50), "x") for i in range(40)]
    rows += [(100, "long " * 5000, "x"), (None, "null key", "x"), (3, "same key", "x"), (3, "same key", "x")]
    rows += [(200 + i, t, "x") for i, t in enumerate(ODD)] + [(300, None, "x")]
    return spark.createDataFrame(rows, SCHEMA), [(r[0], r[1]) for r in rows]


def test_packing(spark):
    docs, rows = documents(spark)
    ids = plain("byte_bpe_50k.json")
    size = 256
    made = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=size, chunk=17, open_limit=9).collect()
    want = []
    for key, text in rows:
        tokens, at = ids(text) + [2], 0
        for k, n in enumerate(packing.cut_lengths(len(tokens), size)):
            raw = np.array(tokens[at : at + n], "<u4").tobytes()
            want.append((key, k, at, n, zlib.crc32(raw)))
            at += n
    order = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r[:5]) for r in made), key=order) == sorted(want, key=order)
    bins = {}
    for r in made:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= size
    total = sum(w[3] for w in want)
    assert len(bins) <= -(-total // size) + 2


def test_packing_an_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_items_that_do_not_fit_each_other_stop_the_rounds(spark):
    pieces = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "600L AS length", "0L AS ids_crc32").repartition(6)
    made = packing.pack_pieces(pieces, chunk=200, open_limit=100)
    assert made.select("sequence_id").distinct().count() == 3000 == made.count()


def test_token_files_round_trip(spark):
    docs, rows = documents(spark)
    ids = plain("word_bpe_49k.json")
    made = token_files.encode_and_read(docs, public_tokenizers.path("word_bpe_49k.json")).orderBy("start").collect()
    encoded = [(k, ids(t) + [2]) for k, t in rows]
    got_keys = [r.doc_id for r in made]
    assert got_keys == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    at = 0
    for r in made:
        assert r.start == at
        at += r.n_tokens
    want = sorted((str(k), len(t), zlib.crc32(np.array(t, "<u4").tobytes())) for k, t in encoded)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in made) == want


def test_keyed_access(spark):
    docs, rows = documents(spark)
    folder = new_folder(spark, "ids")
    manifest = token_files.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), folder)
    ids, found = plain("word_bpe_49k.json"), {}
    for shard in manifest.collect():
        reader = token_files.ShardReader(shard.uri)
        keys = np.array([k for k, _ in rows if k is not None] + [10**9, -5])
        start, count = reader.find(keys, np.zeros(len(keys), bool), np.zeros(len(keys), np.int64))
        assert start[-1] == start[-2] == -1
        for k, s, n in zip(keys.tolist(), start.tolist(), count.tolist()):
            if s >= 0:
                found[k] = np.frombuffer(reader.ids(s, n), "<u4").tolist()
        reader.close()
    del found[3]  # a repeated key gives its first copy
    assert found == {k: ids(t) + [2] for k, t in rows if k not in (None, 3)}


def test_perfect_hash_is_minimal_and_perfect():
    hashes = token_files.mix(np.arange(50_000).astype(np.uint64), 5)
    slots = token_files.PerfectHash.build(hashes).slots(hashes)
    assert sorted(slots.tolist()) == list(range(50_000))


def test_token_files_of_an_empty_table(spark):
    assert token_files.encode_and_read(spark.createDataFrame([], SCHEMA), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_uneven_white_space_equals_the_pattern():
    rare = "\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    pattern = re.compile(f"[{rare}]|[ \n][ \n]|^[ \n]| $")
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n\r\t\u3000\u2028\x1c\x85.") for _ in range(rng.randrange(8))) for _ in range(4_000)]
    texts += [f"a{chr(c)}b" for c in range(0x3100)] + [f"a b{end}" for end in ("", " ", "\n", " \n", "\n ")]
    for text in filter(None, texts):
        assert uneven(text) == bool(pattern.search(text)), repr(text)
