"""Near-duplicates at a similarity of 0.8: against all pairs, and in the pipeline's stage."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline as P
from larkspur.llm import similar

SCHEMA = "doc_id long, text string"


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(docs):
    """The least id of each component by brute force."""
    sets = {d: grams(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d for d in sets if find(d) == d}


def corpus():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    docs = [(0, ""), (1, " \n"), (2, "a b"), (3, "A  b"), (4, "a c")]
    for base in range(12):
        text = [word() for _ in range(200)]
        for changed in (0, 1, 2, 3, 4, 5, 6, 9):
            new = text[:]
            for i in rng.sample(range(200), changed):
                new[i] = word()
            docs.append((len(docs), " ".join(new)))
    dense = [word() for _ in range(150)]
    for _ in range(40):  # pairs below and above the bound in the same buckets
        new = dense[:]
        for i in rng.sample(range(150), 2):
            new[i] = word()
        docs.append((len(docs), " ".join(new)))
    rng.shuffle(docs)
    return docs


def test_every_pair_at_the_bound_links(spark):
    docs = corpus()
    got = similar.representatives(spark.createDataFrame(docs, SCHEMA)).collect()
    assert Counter(r.doc_id for r in got) == Counter(kept(docs))


@pytest.mark.parametrize("piece,cells", [(2000, 1 << 23), (7, 64)])
def test_dense_group_in_pieces(spark, monkeypatch, piece, cells):
    """A hub with copies that are near it but mostly not near each other, and their own near copies."""
    monkeypatch.setattr(similar, "PIECE", piece)
    monkeypatch.setattr(similar, "CELLS", cells)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(70):
        new = base[:]
        for j in rng.sample(range(120), rng.randint(0, 5)):
            new[j] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(new)))
    got = similar.representatives(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r.doc_id for r in got} == kept(docs) and 1 < len(got) < 70


def test_join_apart_links_what_all_pairs_link():
    rng = np.random.default_rng(3)
    for n in (2, 30, 120):
        sets = [np.unique(rng.integers(0, 40, rng.integers(8, 40))) for _ in range(n)]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        roots = rng.integers(0, n, n)
        label = {int(r): int(r) for r in roots}

        def find(x, label=label):
            while label[x] != x:
                x = label[x]
            return x

        want = {int(r): int(r) for r in roots}

        def root(x, want=want):
            while want[x] != x:
                x = want[x]
            return x

        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 10 * both >= 6 * (len(sets[i]) + len(sets[j]) - both):
                    want[root(int(roots[i]))] = root(int(roots[j]))
        for a, b in similar.join_apart(np.arange(n), roots, bounds, np.concatenate(sets), Fraction("0.6")):
            label[find(int(roots[a]))] = find(int(roots[b]))
        assert all((find(x) == find(y)) == (root(x) == root(y)) for x in want for y in want)


def test_stage_removes_near_copies_beyond_four_bits(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, SCHEMA)
    assert {r.doc_id for r in P.near_dedup(spark, frame, "").collect()} == kept(docs)


def test_stage_keeps_rows_with_null_ids_and_copies(spark):
    docs = [(None, "x y z"), (None, "q r s"), (7, "X y z"), (7, "X y z"), (8, None)]
    got = P.near_dedup(spark, spark.createDataFrame(docs, SCHEMA), "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == [(7, "X y z"), (8, None), (None, "q r s")]
    assert P.near_dedup(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
