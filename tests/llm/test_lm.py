import math

import pytest

from larkspur.llm import lm
from larkspur.llm import queries as Q
from tests.llm import reference as R

SCHEMA = "doc_id long, text string"
COLS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def same(df, want):
    got = sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=str)
    want = sorted(want, key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for a, b in zip(got, want, strict=True):
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


def test_matches_brute_force_and_beats_unigrams(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = R.op5(docs)
    same(Q.op5_lm_scoring(spark, sf), want)
    held = [x for x in want if x[1]]
    assert held and sum(x[6] for x in held) > sum(x[5] for x in held)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_orders_blocks_and_odd_rows(spark, order):
    rows = [(i, f"The cat{i % 3} sat on the mat{i % 5} and the cat{i % 7} ran " * (i % 4)) for i in range(40)]
    rows += [(100, None), (101, ""), (None, " \n the"), (None, "the Cat1"), (3, "same id"), (102, "x" * 70_000), (103, "a b " * 20_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS block", "2 AS counts")
    same(lm.score(df, order=order, block_bytes=20_000), R.op5(rows, order=order))
    assert lm.score(df.limit(0)).count() == 0

