"""What a query does as its tables grow, looked at in plans and on small cases."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import paths
from larkspur.functions import predicates as P
from larkspur.operators import clustering, ingest, lexical, neighbors
from larkspur.operators import schema as S
from larkspur.plans import collection_queries, derived_queries, graph_queries, search_queries, stream_queries
from larkspur.plans import tables as T
from larkspur.sources import markdown
from larkspur.sources.vault import Store
from larkspur.streaming import watch


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_values_are_taken_out_of_metadata_once(spark):
    files = spark.createDataFrame([("a.md", '{"r":["[[b]]",1],"n":2}')], "path string, metadata string")
    wanted = [P.In("r", ("[[b]]", "[[c]]", 7)), P.Range("n", 1, 3)]
    df = files.select(P.conjunction(F.col("metadata"), wanted).alias("ok"))
    assert df.head()[0] is True
    assert optimized(df).count("parseJson") == 2  # one for each filter
    assert len(optimized(files.select(S.infer_type(F.col("metadata")).alias("t")))) < 10_000
    assert len(optimized(files.select(paths.relation_candidates(F.col("path"), F.col("metadata")).alias("c")))) < 10_000


def test_equal_values_are_typed_once(spark):
    files = spark.createDataFrame([(f"{i}.md", '{"a":"x"}') for i in range(50)], "path string, metadata string")
    df = S.infer(files)
    assert [tuple(r) for r in df.collect()] == [("a", "String", 50, ["x"])]
    assert re.search(r"Aggregate \[name#\d+, value#\d+\]", optimized(df))


def test_narrow_tables_are_dealt_to_all_cores(spark, sf):
    cores = spark.sparkContext.defaultParallelism
    for df in (collection_queries._notes(spark, sf), search_queries.filter_relation_aware(spark, sf), graph_queries.star_files(spark, sf), derived_queries._accounts(spark, sf)):
        sizes = [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert len(sizes) >= 4 * cores and max(sizes) < sum(sizes) / 4


def test_plain_front_matter_needs_no_yaml_parser(monkeypatch):
    import yaml

    block = 'title: "a: b"\nsize: 3\nprice: 1.50\nday: 2024-01-01\nlink: \'[[x|y]]\'\non: true\nnone: ~'
    lines = block.split("\n")[:-1]
    slow = [markdown.front_matter_json(line + "\nz: [1]") for line in lines]  # a list is left to the parser
    monkeypatch.setattr(yaml, "compose", lambda *a: pytest.fail("parsed"))
    assert [markdown.front_matter_json(line)[:-1] + ',"z":[1]}' for line in lines] == slow
    assert markdown._plain_lines(block) is None and markdown._plain_lines("a: b: c") is None and markdown._plain_lines("a: 'it''s'") is None


def test_distinct_users_are_found_before_they_are_sketched(spark, sf):
    plan = stream_queries.distinct_error(spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert not re.search(r"keys=\[event_type#\d+, user_id#\d+\w*\], functions=\[\w*approx_count_distinct", plan)


@pytest.mark.parametrize("copies", [False, True])
def test_best_neighbours_of_blocks(copies):
    rng = np.random.default_rng(3)
    rows = np.round(rng.normal(size=(300, 5)), 0 if copies else 9)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)
    best = neighbors.Best([*range(300)], rows, 7, True)
    held = []
    for at in range(0, 300, 50):
        best.see([*range(at, at + 50)], rows[at : at + 50])
        held.append(len(best.rows()[0]))
    assert held == [7 * 300] * 6  # whatever the number of blocks
    score = np.round(rows @ rows.T, 12)
    want = {(i, j) for i in range(300) for j in sorted((j for j in range(300) if j != i), key=lambda j: (-score[i, j], j))[:7]}
    who, ids, _ = best.rows()
    assert {*zip(who, ids, strict=True)} == want


def test_terms_are_gathered_without_a_shuffle(spark):
    docs = spark.createDataFrame([("1", "p", "b a B", "b"), ("2", "q", None, ""), ("3", "r", "running runs", "x")], "chunk_id string, path string, content string, headings string")
    df = lexical.terms(docs)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.chunk_id, r.field, r.term, r.stem, r.tf, r.length, tuple(r["at"])) for r in df.collect()} == {
        ("1", "c", "a", "a", 1, 3, (1,)), ("1", "c", "b", "b", 2, 3, (0, 2)), ("1", "c", "", "", 0, 3, (3,)), ("1", "h", "b", "b", 1, 1, (0,)), ("1", "h", "", "", 0, 1, (1,)), ("2", "c", "", "", 0, 0, (0,)), ("2", "h", "", "", 0, 0, (0,)),
        ("3", "c", "running", "run", 1, 2, (0,)), ("3", "c", "runs", "run", 1, 2, (1,)), ("3", "c", "", "", 0, 2, (2,)), ("3", "h", "x", "x", 1, 1, (0,)), ("3", "h", "", "", 0, 1, (1,)),
    }


def test_an_index_is_cut_by_the_size_of_its_texts(spark, sf):
    docs = T.documents(spark, sf)
    assert T.pieces(docs, "doc_id", 10_000).rdd.getNumPartitions() > docs.rdd.getNumPartitions()


def test_many_small_communities_merge_in_time():
    n = 6000
    edges = [(0, i, 1.0 + i % 3) for i in range(1, n)]
    began = time.perf_counter()
    assert set(clustering._merge_small([*range(n)], edges, 2)) == {0} or len(set(clustering._merge_small([*range(n)], edges, 2))) < n // 2
    assert time.perf_counter() - began < 10


def test_links_of_a_graph_are_no_objects():
    rng = random.Random(0)
    edges = [(rng.randrange(500), rng.randrange(500), rng.random()) for _ in range(4000)]
    a, b, w = clustering._columns(edges)
    g = clustering.Graph(500, np.r_[a, b], np.r_[b, a], np.r_[w, w])
    assert g.target.nbytes + g.source.nbytes + g.w.nbytes <= 16 * 8000
    assert clustering.leiden([*range(500)], edges) == clustering.leiden_of(500, a, b, w)


def test_what_is_not_stored_touches_no_bucket(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    event = lambda *rows: spark.createDataFrame([*rows], watch.EVENT)
    at = __import__("datetime").datetime(2024, 1, 1)
    watch.apply(store, event(("a.md", "created", at, "one two", None), ("b.md", "created", at, "three", None)))
    watch.apply(store, event(("a.md", "deleted", at, None, None)))
    before = store.manifest()
    done = watch.apply(store, event(("a.md", "deleted", at, None, None), ("b.md", "modified", at, "three", None)))
    assert {(r.path, r.action) for r in done.collect()} == {("a.md", "removed")}
    assert store.manifest() == before
    assert [r.path for r in store.read("files").collect()] == ["b.md"]


def test_a_large_bucket_is_written_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("larkspur.sources.vault.PART_DOCUMENTS", 4)
    store = Store(spark, str(tmp_path / "store"), buckets=2)
    rows = spark.createDataFrame([(f"{i}.md", i) for i in range(40)], "path string, v int")
    store.replace({"t": rows}, {"t": rows}, {"t": "path"})
    files = spark.read.parquet(*(f"{store.path}/{f}" for f in store.manifest()[1]["t"]["buckets"].values())).inputFiles()
    assert len(files) > 2
    store.replace({"t": rows.where("v < 3").withColumn("v", F.lit(-1))}, {"t": rows.where("v < 5")}, {"t": "path"})
    assert sorted(r.v for r in store.read("t").collect()) == [-1, -1, -1, *range(5, 40)]
    assert ingest.IN_PLACE
