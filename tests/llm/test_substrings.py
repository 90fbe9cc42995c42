import numpy as np
import pytest

from larkspur.llm import queries as Q
from larkspur.llm import substrings
from tests.llm import reference as R

SCHEMA = "doc_id long, text string"


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_levels_double():
    assert substrings.levels(13) == [4, 7, 13] and substrings.levels(50) == [4, 7, 13, 25, 50] and substrings.levels(2) == [2]
    for window in range(1, 200):
        got = substrings.levels(window)
        assert got[-1] == window and got[0] <= 4 and all(a < b <= 2 * a for a, b in zip(got, got[1:], strict=False))


def test_every_level_runs_in_the_registered_query(spark, sf):
    plan = Q.op2_substring_dedup(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == len(substrings.levels(substrings.WINDOW))  # two extensions and the result


def test_levels_keep_only_what_repeats():
    texts = [b"a b c d e f g h i j k l m n o p", b"a b c d e f g x y z", b"q a b c d r s t u v w"]
    w = substrings._hashes(texts)
    doc = w.doc.astype("int64")

    def repeated(length, at):
        h, _ = substrings._windows(w, length)
        return {int(i) for i in at if len({int(doc[j]) for j in at if h[j] == h[i]}) > 1}

    four = repeated(4, substrings._windows(w, 4)[1])
    assert len(four) == 9  # a-d in three texts, three more windows in two
    seven = repeated(7, [i for i in substrings._windows(w, 7)[1] if i in four and i + 3 in four])
    assert len(seven) == 2 and not [i for i in substrings._windows(w, 13)[1] if i in seven and i + 6 in seven]


def test_letters_of_a_block_are_bounded(spark):
    from larkspur.llm import blocks as B

    for n in (1, 10, 100):
        keys = np.sort(np.random.default_rng(n).integers(0, 1 << 63, 5000 * n).astype(np.uint64) << np.uint64(1))
        assert B.outbox(0, min(n, 64), keys).num_rows == min(n, 64)
    docs = spark.createDataFrame([(i, "w" * 100) for i in range(100)], SCHEMA)
    assert B.sizes(docs, 512)[1] == 1 and B.sizes(docs, 1 << 10)[1] <= 2 and B.sizes(docs, 1 << 30)[1] <= 1 << 21


def test_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = R.op2(docs)
    assert sum(x[2] for x in want)
    assert got(Q.op2_substring_dedup(spark, sf)) == want


@pytest.mark.parametrize("window", [2, 13, 40])
def test_many_blocks_and_odd_rows(spark, window):
    base = [f"w{i * i % 97}" for i in range(400)]
    rows = [(i, " ".join(base[i * 7 % 300 : i * 7 % 300 + 60 + i])) for i in range(20, 45)]
    rows += [(1, None), (2, ""), (3, "\n\t "), (None, " ".join(base[:80])), (None, " ".join(base[:80])), (50, " ".join(base[:80])), (50, " ".join(base[:80]))]
    rows += [(60 + i, "hot passage of text that stands in very many rows indeed and goes on for some words " * 3) for i in range(30)]
    rows += [(200, "word " * 20_000), (201, "x" * 100_000), (202, " ".join(base[:14])), (203, "é\x85à\x1cb c " * 20)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS block", "'k' AS keys")
    assert got(substrings.remove_repeats(df, window, block_bytes=3000)) == R.op2(rows, window)
    assert got(substrings.remove_repeats(df, window, with_text=True)) == R.op2(rows, window)


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
