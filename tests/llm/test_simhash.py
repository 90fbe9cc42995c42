import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import components, simhash
from larkspur.llm import queries as Q
from tests.llm import reference as R

SCHEMA = "doc_id long, text string"


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = R.op6(docs)
    assert len({x[2] for x in want}) < len(docs)
    assert got(Q.op6_simhash_near_dedup(spark, sf)) == sorted(want, key=str)


def test_odd_rows(spark):
    near = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    rows = [(5, None), (3, ""), (None, " \n"), (7, "one two"), (8, "ONE\ttwo"), (9, near), (4, near), (4, near), (11, near.upper() + "\n"), (12, "x" * 90_000), (13, "word " * 30_000), (None, "alone é here")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS fp", "'q' AS root", "2 AS component_id")
    assert got(simhash.cluster(df)) == sorted(R.op6(rows), key=str)
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "7", "4", "12", "13", "None"])
    assert simhash.cluster(df.limit(0)).count() == 0


def brute(prints, distance):
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    return {p: root(p) for p in prints}


def same_partition(a, b):
    return len({(a[p], b[p]) for p in a}) == len(set(a.values())) == len(set(b.values()))


def cloud(seed, n=260):
    rng = random.Random(seed)
    center = rng.getrandbits(64)
    out = {rng.getrandbits(64) for _ in range(n)}
    for _ in range(n):
        p = center
        for _ in range(rng.randint(0, 5)):
            p ^= 1 << rng.randrange(64)
        out.add(p)
    return out


@pytest.mark.parametrize("few,homes,members", [(32, 4096, 8192), (2, 4096, 8192), (1, 3, 5)])
def test_links_join_what_brute_force_joins(spark, monkeypatch, few, homes, members):
    for name, value in (("FEW_HOMES", few), ("HOMES", homes), ("MEMBERS", members)):
        monkeypatch.setattr(simhash, name, value)
    prints = cloud(few)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    found = [(r.a, r.b) for r in simhash.links(frame, 4).collect()]
    unsigned = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in found]
    assert all((a ^ b).bit_count() <= 4 for a, b in unsigned)
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in unsigned:
        parent[root(a)] = root(b)
    assert same_partition({p: root(p) for p in prints}, brute(prints, 4))


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 10**9), st.integers(0, 6), st.integers(0, 2**32))
def test_plan_keeps_the_pigeonhole(n, distance, seed):
    rng = np.random.default_rng(seed)
    p = rng.random(64)
    both = (np.outer(p, p) * n).astype(np.int64)
    np.fill_diagonal(both, (p * n).astype(np.int64))
    parts, radii = simhash.plan(n, both, distance)
    assert sorted(b for x in parts for b in x) == [*range(64)]
    assert sum(radii) == distance - len(parts) + 1 and min(radii) >= -1


@pytest.mark.parametrize("split", [0, 5_000_000])
def test_components(spark, monkeypatch, split):
    monkeypatch.setattr(components, "SPLIT", split)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(200)] + [(500, 600 + i) for i in range(50)] + [(7, 7)]
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    parent = {n: n for e in edges for n in e if e[0] != e[1]}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert roots == {n: root(n) for n in parent}
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_representatives_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3, 4), (2, "a b c d e f", 5, 6, 7, 8), (3, "z", 9, 9, 9, 9), (3, "z", 9, 9, 9, 9)], "doc_id long, text string, _first int, of int, _copies int, of_text int")
    got = simhash.representatives(docs)
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == [(1, "a b c d e f", 1, 2, 3, 4), (3, "z", 9, 9, 9, 9)]
