"""Literals of added tokens give the ids that the untouched tokenizer gives, in the encoder and in the queries' tables."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trailmark.llm import queries
from trailmark.llm.common import BARE, SPACED, ChunkEncoder

FILES = {"byte_bpe_50k.json": SPACED, "word_bpe_49k.json": BARE}
TEXTS = [
    "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y\n", "<|startoftext|>Some Words <|endoftext|>",
    "a <|ENDOFTEXT|> b", "<|endoftext| > and <|end\noftext|>", "Σ<|endoftext|>ΣΑΣ　x", "no literal at all", "",
]


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_untouched_tokenizer(name):
    path = public_tokenizers.path(name)
    encoder, plain = ChunkEncoder(path, FILES[name], specials=True), Tokenizer.from_file(path)
    for text in TEXTS * 2:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("query,name", [("op4_best_fit_packing", "byte_bpe_50k.json"), ("op6_token_files", "word_bpe_49k.json")])
def test_queries_give_special_ids(spark, tmp_path, query, name):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    want = {i: zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.ids_crc32 for r in queries.QUERIES[query](spark, str(tmp_path)).collect()} == want
