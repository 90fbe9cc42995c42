"""Token ids: the encoder, the store and packing."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import packing, token_store
from larkspur.llm import queries as Q
from larkspur.llm.tokens import Encoder
from tests.llm import reference as R

BPE = public_tokenizers.path("byte_bpe_50k.json")
CODER = Encoder(BPE)
SCHEMA = "doc_id long, text string"
ODD = [(9, None), (3, ""), (4, "\n \n\t x  y　z\x85a\x1cb \x1f c"), (5, "it's 'tis they'll 12 12á ½Ⅷ٠ naïve ЖЖ 漢字 \U0001f600ᲀ\U0001e900"), (5, "it's"), (6, "<|endoftext|> a"), (7, "z" * 60_000), (8, "a b " * 30_000), (-1, "q")]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_encoder_equals_library(texts):
    whole = CODER.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in CODER.encode(texts)] == [e.ids for e in whole]


def test_encoder_equals_library_on_documents(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert [np.frombuffer(x, "<u4").tolist() + [0] for x in CODER.encode(texts)] == R.ids_of(texts, BPE)


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_are_used_whole(name):
    coder = Encoder(public_tokenizers.path(name))
    assert not coder.by_pretoken
    assert coder.encode(["Hello  World"]) == [np.array(coder.tokenizer.encode("Hello  World", add_special_tokens=False).ids, "<u4").tobytes()]


def test_perfect_hash_is_minimal_and_rejects_strangers():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 50_000).astype(np.uint64))
    raw = token_store.ShardIndex.dump(h, np.arange(len(h)), np.arange(len(h)) * 2)
    index = token_store.ShardIndex(raw)
    slots = index.find(h)
    assert sorted(slots) == [*range(len(h))] and (index.first[slots] == np.arange(len(h))).all()
    assert (index.find(rng.integers(0, 1 << 63, 10_000).astype(np.uint64)) >= 0).sum() <= 2
    assert len(token_store.ShardIndex(token_store.ShardIndex.dump(h[:0], h[:0], h[:0])).first) == 0


def stored(df):
    return sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in df.collect())


def expected(docs):
    docs = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out, start = [], 0
    for (doc, _), ids in zip(docs, R.ids_of([t for _, t in docs], BPE), strict=True):
        out.append((start, doc, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_store_round_trip(spark, sf, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert stored(Q.op7_token_store(spark, sf)) == expected(docs)
    odd = spark.createDataFrame([*ODD, (None, "none")], SCHEMA).selectExpr("*", "1 AS shard", "2 AS keys")
    for bound in (5, 4 << 20):
        assert stored(token_store.round_trip(odd, BPE, shard_ids=bound)) == expected([*ODD, (None, "none")])
    path = token_store.write(odd, str(tmp_path / "store"), BPE, shard_ids=50)
    got = {r.doc_id: r.ids for r in token_store.fetch(spark, path, [3, 4, 77, 8]).collect()}
    want = dict(zip((3, 4, 8), R.ids_of([dict(ODD)[k] for k in (3, 4, 8)], BPE), strict=True))
    assert got == want
    every = [*ODD, (None, "none")]
    for wanted in ([5, None, 9], [*range(-1000, 1000), None], [None], []):
        got = sorted(((r.doc_id, tuple(r.ids)) for r in token_store.fetch(spark, path, wanted).collect()), key=str)
        assert got == sorted(((d, tuple(x)) for (d, _), x in zip(every, R.ids_of([t for _, t in every], BPE), strict=True) if d in wanted), key=str)
    assert token_store.round_trip(odd.limit(0), BPE).count() == 0
    named = spark.createDataFrame([("\0", "a"), (None, "b"), ("n", "c"), ("kn", "d"), ("n", "e")], "doc_id string, text string")
    path = token_store.write(named, str(tmp_path / "named"), BPE)
    assert sorted(str(r.doc_id) for r in token_store.fetch(spark, path, ["\0", None, "n", "x"]).collect()) == ["\0", "None", "n", "n"]


def test_equal_hashes_end():
    with pytest.raises(ValueError):
        token_store.PerfectHash.build(np.array([7, 7], np.uint64))
    with pytest.raises(ValueError):
        token_store.ShardIndex.of_keys(["a", "a"], np.zeros(2, np.int64), np.zeros(2), np.zeros(2))


def test_rows_of_one_key_are_spread(spark):
    docs = [(None if i % 3 else 7, f"text {i * 7919 % 1000} of one key") for i in range(1000)]
    stored = token_store.shards(spark.createDataFrame(docs, SCHEMA).repartition(3), BPE)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert stored.where("first_key IS NULL").count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(x[2:] for x in stored_rows(docs, spark)) == sorted(x[2:] for x in expected(docs))


def stored_rows(docs, spark):
    return stored(token_store.round_trip(spark.createDataFrame(docs, SCHEMA), BPE))


def test_store_adds_up_bases_of_very_many_shards(spark):
    assert stored(token_store.round_trip(spark.createDataFrame(ODD, SCHEMA), BPE, shard_ids=5)) == expected(ODD)


def check_packing(pieces, docs, size=1024):
    ids = defaultdict(list)
    for (doc, _), x in zip(docs, R.ids_of([t for _, t in docs], BPE), strict=True):
        ids[doc].append(x)
    seqs, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        seqs[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= size
    for doc, versions in ids.items():
        if len(versions) == 1:
            at = 0
            for p in sorted(by_doc[doc], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(versions[0]) and p.ids_crc32 == crc(versions[0][at : at + p.length])
                at += p.length
            assert at == len(versions[0]) and len(by_doc[doc]) == -(-at // size)  # cut only where it is longer than a window
    total = sum(len(x) for v in ids.values() for x in v)
    assert sum(p.length for p in pieces) == total
    filled = sorted(sum(p.length for p in s) for s in seqs.values())
    assert len(filled) < 2 or filled[0] + filled[1] > size  # no two sequences that one would hold
    assert len(seqs) * size <= 1.03 * total + 2 * size


def test_packing(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_packing(Q.op9_packing(spark, sf).collect(), docs)
    odd = spark.createDataFrame([*ODD, (None, "none")], SCHEMA).selectExpr("*", "1 AS task", "2 AS g").repartition(5)
    for fan_in in (2, 256):
        check_packing(packing.pack(odd, BPE, fan_in=fan_in).collect(), [*ODD, (None, "none")])
    assert packing.pack(odd.limit(0), BPE).count() == 0


def test_packer_prefers_best_fit():
    p = packing.Packer(10, 2, 0)
    for doc, n in (("a", 4), ("b", 8), ("c", 2)):
        p.add(doc, 0, bytes(4 * n), n)
    assert [(r[0], r[5], r[6]) for r in p.done] == [("b", 1, 0), ("c", 1, 8)]
    p = packing.Packer(10, 2, 0)
    for doc, n in (("a", 4), ("b", 9), ("c", 7), ("d", 25)):
        p.add(doc, 0, bytes(4 * n), n)
    # none fits c: the fullest (b) goes out as it is; d's multiples stand alone, its rest goes to a
    assert [(r[0], r[1], r[2]) for r in p.done] == [("b", 0, 9), ("d", 0, 10), ("d", 10, 10)]
    assert sorted((r[0], r[2], r[6]) for r in p.rest(0)) == [("a", 4, 0), ("c", 7, 0), ("d", 5, 4)]
    p = packing.Packer(10, 2, 0)
    rng = random.Random(2)
    for _ in range(500):
        n = rng.randint(1, 35)
        p.add("d", 0, bytes(4 * n), n)
        assert len(p.pieces) <= 2
