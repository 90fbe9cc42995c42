"""Strings of added tokens in texts: ids as the library gives them with its settings untouched."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkspur.llm import packing, token_store
from larkspur.llm.tokens import Encoder
from tests.llm.test_tokens import crc

BPE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["a <|endoftext|> b", "plain text", "<|endoftext|>", "<|endoftext|><|endoftext|>it's", "<|endoftext|", "ᲀ<|endoftext|> z", "<|startoftext|>x <|endoftext|>", ""]


def untouched(path, texts):
    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_one_id(name):
    path = public_tokenizers.path(name)
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(path).encode(TEXTS)] == untouched(path, TEXTS)


def test_store_and_packing_hold_added_tokens(spark):
    assert untouched(BPE, TEXTS[:1]) == [[64, 220, 50256, 275]]
    docs = spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string")
    want = {i: (len(x) + 1, crc([*x, 0])) for i, x in enumerate(untouched(BPE, TEXTS))}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_store.round_trip(docs, BPE).collect()} == want
    assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packing.pack(docs, BPE).collect()} == want
