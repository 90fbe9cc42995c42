"""The pipeline's near-duplicate stage goes through SimHash fingerprints, and keys join only what those leave apart."""

import random

import numpy as np

import corpus_pipeline as P
from larkspur.llm import similar, simhash
from tests.llm.test_similar import SCHEMA, corpus, grams, kept


def couples():
    """Texts and one copy of each, with 1 to 20 other words among 200."""
    rng = random.Random(12)
    docs = []
    for i in range(80):
        text = [f"w{rng.randrange(5000)}" for _ in range(200)]
        new = text[:]
        for j in rng.sample(range(200), 1 + i // 4):
            new[j] = f"x{rng.randrange(5000)}"
        docs += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(new))]
    return docs


def test_stage_links_by_fingerprints(spark, monkeypatch):
    """Without keys, what is left are the couples within the bits and at the bound."""
    monkeypatch.setattr(similar, "_by_keys", lambda found, *_: found)
    docs = couples()
    prints = simhash.majority(*similar.shingle_sets([t.encode() for _, t in docs]))
    bits = np.bitwise_count(prints[::2] ^ prints[1::2])
    sets = [grams(t) for _, t in docs]
    alike = np.array([10 * len(a & b) >= 8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)])
    gone = {2 * i + 1 for i in np.flatnonzero(alike & (bits <= similar.DISTANCE)).tolist()}
    assert gone and (alike & (bits > similar.DISTANCE)).any() and (~alike & (bits <= similar.DISTANCE)).any()
    got = {r.doc_id for r in P.near_dedup(spark, spark.createDataFrame(docs, SCHEMA), "").collect()}
    assert got == {d for d, _ in docs} - gone


def test_links_are_whole_at_any_distance(spark):
    docs = corpus() + [(1000 + d, t) for d, t in couples()]
    frame = spark.createDataFrame(docs, SCHEMA)
    want = kept(docs)
    for distance in (0, 8):
        assert {r.doc_id for r in similar.representatives(frame, distance=distance).collect()} == want
