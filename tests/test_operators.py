"""Search, graph, clusters, shards: properties, edge cases and the shape of plans."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions import paths
from larkspur.operators import clustering, collection, graph, lexical, neighbors, search, shards
from larkspur.operators.search import Index, Query
from larkspur.plans import tables as T

slow = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_lexical_query_parser():
    q = lexical.parse('cat +dog -bird "big red fox" "x" (')
    assert q == lexical.Query(("cat", "x"), ("dog",), ("bird",), (("big", "red", "fox"),))
    assert q.scored == ["cat", "x", "dog", "big", "red", "fox"]


def test_headings_weigh_more(spark):
    df = spark.createDataFrame([("a", "body cat words here", "intro words"), ("b", "intro words body here", "cat"), ("c", "nothing at all", "none")], "chunk_id string, content string, headings string")
    got = {r.chunk_id: r.bm25 for r in lexical.score(df, "cat", headings="headings").collect()}
    assert got.keys() == {"a", "b"} and got["b"] > got["a"]
    assert lexical.score(df, "").count() == 0 and lexical.score(df, "-cat").count() == 0


STEMS = (
    "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file "
    "happy:happi sky:sky relational:relat conditional:condit rational:ration digitizer:digit vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope sensibiliti:sensibl triplicate:triplic formative:form "
    "electrical:electr goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust irritant:irrit replacement:replac adoption:adopt communism:commun activate:activ homologous:homolog effective:effect "
    "bowdlerize:bowdler probate:probat rate:rate cease:ceas controlling:control roll:roll be:be été:été a1b:a1b"
).split()


def test_stems(spark):
    from larkspur.functions.stem import stem

    assert [f"{w}:{stem(w)}" for w in (x.split(":")[0] for x in STEMS)] == STEMS
    df = spark.createDataFrame([("a", "He was running"), ("b", "runs"), ("c", "walk")], "chunk_id string, content string")
    assert {r.chunk_id for r in lexical.score(df, "run", stemmed=True).collect()} == {"a", "b"} and lexical.score(df, "run").count() == 0


@slow
@given(st.permutations([*range(6)]), st.permutations([*range(6)]))
def test_rrf_does_not_depend_on_row_order(spark, p, q):
    lists = [[(i, r + 1) for r, i in enumerate(x)] for x in (p, q)]
    frames = [spark.createDataFrame(x, "id int, rank int") for x in lists]
    back = [spark.createDataFrame(x[::-1], "id int, rank int") for x in lists[::-1]]
    a, b = ({r.id: round(r.score, 12) for r in search.fuse(f, "id").collect()} for f in (frames, back))
    assert a == b and max(a.values()) <= 1


def test_leading_both_lists_scores_one(spark):
    one = spark.createDataFrame([("x", 1)], "id string, rank int")
    assert search.fuse([one, one], "id").head().score == pytest.approx(1.0)


def test_decay(spark):
    df = spark.createDataFrame([("docs/a.md", 0), ("docs/old/b.md", 0), ("x.md", 86400 * 90)], "path string, m long")
    late = search.decays(F.col("path"), ("docs",), ("docs/old",))
    got = {r.path: (r.on, round(r.s, 6)) for r in df.select("path", late.alias("on"), search.decayed(F.lit(1.0), F.col("m"), 86400 * 90).alias("s")).collect()}
    assert got == {"docs/a.md": (True, 0.5), "docs/old/b.md": (False, 0.5), "x.md": (False, 1.0)}


def small_index(spark):
    chunks = spark.createDataFrame([(f"{p}.md#0", f"{p}.md", f"word {p}", 0) for p in "abcdef"], "chunk_id string, path string, content string, n int")
    vec = spark.createDataFrame([(f"{p}.md#0", [1.0, i / 10]) for i, p in enumerate("abcdef")], "chunk_id string, vector array<float>")
    files = spark.createDataFrame([(f"{p}.md", '{"k":1}' if p != "a" else None, 10, 10) for p in "abcdef"], "path string, metadata string, modified_at long, indexed_at long")
    links = spark.createDataFrame([("a.md", "b.md"), ("b.md", "c.md"), ("c.md", "a.md"), ("c.md", "d.md"), ("d.md", "e.md"), ("e.md", "zz.md")], "source string, target string")
    return Index(chunks, vec, files, links)


def test_search_modes_and_filters(spark):
    ix = small_index(spark)
    ids = lambda q: [r.path for r in search.search(ix, q).collect()]
    assert ids(Query(mode="semantic", vector=(1.0, 0.0), limit=2)) == ["a.md", "b.md"]
    from larkspur.functions.predicates import Equals

    assert ids(Query(mode="semantic", vector=(1.0, 0.0), limit=2, filters=(Equals("k", 1),))) == ["b.md", "c.md"]
    assert ids(Query(text="d", vector=(1.0, 0.0), limit=1)) and ids(Query(text=" ", vector=(1.0, 0.0))) == [] and ids(Query(text="a", mode="lexical", limit=0)) == []
    found = search.search(ix, Query(mode="semantic", vector=(1.0, 0.0), limit=1))
    more = search.expand(found, ix, (1.0, 0.0), depth=2).collect()
    assert [(r.path, r.hop, r.linked_from) for r in more] == [("b.md", 1, "a.md"), ("c.md", 1, "a.md"), ("d.md", 2, "a.md")]
    assert len({r.path for r in more}) == len(more)


def test_bfs_and_neighborhood(spark):
    links = small_index(spark).links
    hops = {r.path: r.hop for r in graph.bfs(links, ["a.md"], 9).collect()}
    assert hops == {"b.md": 1, "c.md": 1, "d.md": 2, "e.md": 3}
    trails = {r.trail for r in graph.neighborhood(links, "a.md", 3).collect()}
    assert trails == {"a.md>b.md", "a.md>b.md>c.md", "a.md>b.md>c.md>d.md"}
    files = spark.createDataFrame([(x,) for x in ("a.md", "b.md", "e.md", "lone.md")], "path string")
    assert [r.path for r in graph.orphans(files, links).collect()] == ["lone.md"]
    assert {r.target for r in graph.broken(links, files).collect()} == {"c.md", "d.md", "zz.md"}


@slow
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=15))
def test_bfs_hops_against_a_model(spark, edges):
    near = {0: 0}
    for hop in (1, 2, 3):
        for a, b in [*edges, *((b, a) for a, b in edges)]:
            if near.get(a) == hop - 1 and b not in near:
                near[b] = hop
    got = {int(r.path): r.hop for r in graph.bfs(spark.createDataFrame([(str(a), str(b)) for a, b in edges], "source string, target string"), ["0"], 3).collect()}
    assert got == {k: v for k, v in near.items() if v}


@slow
@given(st.lists(st.lists(st.sampled_from(["a", "b", "docs", "docs-old", "x.md"]), min_size=1, max_size=4), min_size=1, max_size=8), st.lists(st.sampled_from(["a", "docs", "b"]), max_size=3))
def test_scope_against_a_model(spark, found, scope):
    rows = [("/".join(p),) for p in found]
    s = "/".join(scope)
    want = sorted(p for (p,) in rows if not scope or p.split("/")[: len(scope)] == scope)
    df = spark.createDataFrame(rows, "path string")
    assert sorted(r.path for r in df.where(paths.in_scope(F.col("path"), "./" + s + "/")).collect()) == want


def test_neighbors_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(f"n{i:03}", [rng.gauss(0, 1) for _ in range(5)]) for i in range(120)] + [("zero", [0.0] * 5)]
    df = spark.createDataFrame(rows, "id string, vector array<double>")

    def cos(a, b):
        n = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0, 9)

    want = {(a, b) for a, va in rows for _, b in sorted((-cos(va, vb), b) for b, vb in rows if b != a)[:4]}
    got = {(r.query, r.id) for r in neighbors.nearest(df, df, 4, skip_self=True, block=17).collect()}
    assert got - {x for x in got if x[0] == "zero"} == want - {x for x in want if x[0] == "zero"} and len(got) == len(want)


def test_leiden_finds_planted_groups_and_repeats():
    rng = random.Random(7)
    edges = []
    for g in range(4):
        for i in range(12):
            for j in range(i):
                if rng.random() < 0.6:
                    edges.append((g * 12 + i, g * 12 + j, 1.0))
    edges += [(rng.randrange(48), rng.randrange(48), 0.3) for _ in range(20)]
    edges = [(a, b, w) for a, b, w in edges if a != b]
    of = clustering.leiden([*range(48)], edges)
    assert of == clustering.leiden([*range(48)], edges)
    assert all(len({of[g * 12 + i] for i in range(12)}) == 1 for g in range(4)) and len(set(of)) == 4
    assert clustering.modularity(of, edges) > clustering.modularity([*range(48)], edges)
    assert len(clustering.leiden([0, 1], [])) == 2


def test_communities_cover_every_node_once(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("path"), F.col("embedding").alias("vector"))
    got = clustering.communities(v).collect()
    assert sorted(r.path for r in got) == sorted(r.path for r in v.collect())
    sizes = {}
    for r in got:
        sizes[r.cluster_id] = sizes.get(r.cluster_id, 0) + 1
    assert sorted(sizes) == [*range(len(sizes))] and [sizes[i] for i in sorted(sizes)] == sorted(sizes.values(), reverse=True)


def test_identities_last(spark):
    frame = lambda d: spark.createDataFrame([(p, c) for c, ps in d.items() for p in ps], "path string, cluster_id int")
    old, new = frame({5: "abcd", 7: "efgh", 9: "ij"}), frame({0: "abcx", 1: "efyz", 2: "klm"})
    assert clustering.identities(old, new, 10) == {0: (5, True), 1: (7, False), 2: (10, False)}


def test_fold_small_and_running_centroid(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.9, 0.2]), ("d", [-1.0, 0.0])], "path string, vector array<double>")
    m = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 2)], "path string, cluster_id int")
    assert {r.path: r.cluster_id for r in clustering.fold_small(m, v).collect()} == {"a": 0, "b": 0, "c": 0, "d": 2}
    old = spark.createDataFrame([(0, [1.0, 0.0], 3), (1, [5.0, 5.0], 1)], "cluster_id int, centroid array<double>, n long")
    got = {r.cluster_id: (r.centroid, r.n) for r in clustering.running_centroid(old, spark.createDataFrame([(0, [0.0, 4.0])], "cluster_id int, vector array<double>")).collect()}
    assert got == {0: ([0.75, 1.0], 4), 1: ([5.0, 5.0], 1)}


def test_shards():
    s = shards.Shards()
    s.add("Docs", "docs/")
    s.add("API", "docs/api")
    s.add("Deep", "./docs/api/v1", "deep")
    assert [x.id for x in s.list()] == ["docs", "api", "deep"] and s.parent("deep") == "api" and s.parent("docs") is None
    s.retarget("api", "docs-api")
    assert s.parent("deep") == "docs"
    for bad in ("/x", "../x", "", "a//b", "docs"):
        with pytest.raises(ValueError):
            s.add("n", bad)
    s.set_topic("deep", "t", "d", ("a",), 0.4)
    s.remove("deep")
    assert "deep" not in s.topics and [x.id for x in s.list()] == ["docs", "api"]


def test_collection_fixture(spark):
    rows = [
        ("blog/launch.md", '{"title":"Launch Announcement","status":"published","date":"2024-06-01","tags":["news"]}'), ("blog/intro.md", '{"title":"Intro Post","status":"draft","date":"2024-01-15"}'), ("blog/no-title.md", '{"status":"published","date":"2024-03-10"}'),
        ("blog/no-date.md", '{"title":"No Date","status":"draft"}'), ("blog/plain.md", None), ("blog/2024/recap.md", '{"title":"Year Recap","status":"published","date":"2024-12-31"}'), ("blog-old/x.md", '{"date":"2020-01-01"}'), ("docs/guide.md", '{"title":"Guide","version":1.0}'),
    ]
    files = spark.createDataFrame(rows, "path string, metadata string")

    def page(**kw):
        q = collection.Query(path="blog", **kw)
        return [r.path.removeprefix("blog/") for r in collection.page(collection.rows(files, q), q).collect()]

    assert page(sort="date") == ["intro.md", "no-title.md", "launch.md", "no-date.md", "plain.md"]
    assert page(sort="date", descending=True) == ["launch.md", "no-title.md", "intro.md", "no-date.md", "plain.md"]
    assert page(recursive=True) == ["2024/recap.md", "intro.md", "launch.md", "no-date.md", "no-title.md", "plain.md"]
    assert page(sort="title", limit=2, offset=1) == ["launch.md", "no-date.md"] and page(limit=0) == []
    from larkspur.functions.predicates import parse

    assert page(recursive=True, sort="date", filters=(parse("status=published"),)) == ["no-title.md", "launch.md", "2024/recap.md"]
    from larkspur.operators import schema

    cols = {r.name: (r.in_schema, r.present) for r in collection.columns(collection.rows(files, collection.Query(path="blog")), schema.infer(files, "docs")).collect()}
    assert cols == {"date": (False, 3), "status": (False, 4), "tags": (False, 1), "title": (True, 3), "version": (True, 0)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scoped = docs.withColumnRenamed("source", "path").where(paths.in_scope(F.col("path"), "src1"))
    assert "StringStartsWith" in plan(scoped) and "PushedFilters: [" in plan(scoped)
    top = search.top_k(search.semantic(T.vectors(spark, sf), T.vector(spark, sf)), "score", "chunk_id", 5)
    assert "TakeOrderedAndProject" in plan(top)
    ids = T.vectors(spark, sf).select(F.col("chunk_id").alias("id"), "vector")
    near = plan(neighbors.nearest(ids, ids, 5, skip_self=True))
    assert "WindowGroupLimit" in near and "Cartesian" not in near and "NestedLoop" not in near
    assert "Cartesian" not in plan(graph.orphans(T.documents(spark, sf), T.links(spark, sf)))
    assert "text" not in plan(docs.select("doc_id").where("n_chars > 5")).split("ReadSchema")[-1]


def test_neighbours_in_waves(spark, monkeypatch):
    """Many waves of small blocks give what one gives."""
    import numpy as np

    from larkspur.operators import neighbors

    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "id int, vector array<double>")
    whole = sorted(tuple(r) for r in neighbors.nearest(rows, rows, 3, skip_self=True).collect())
    monkeypatch.setattr(neighbors, "WAVE_BYTES", 2 * 7 * 4 * 8)
    got = sorted(tuple(r) for r in neighbors.nearest(rows, rows, 3, skip_self=True, block=7).collect())
    assert len(whole) == 180 and [x[:2] for x in got] == [x[:2] for x in whole] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, whole, strict=True))
