"""Search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur import scratch
from larkspur.functions import predicates as P
from larkspur.operators import lexical, search
from larkspur.plans import tables as T
from larkspur.plans.registry import query

WORDS = "the idiot clown token"
_LEX = T.bm25(WORDS.split())
_Q = "q AS (SELECT v FROM vecs WHERE vec_id = 0)"
_SEM = f"sem AS (SELECT vec_id, {T.cosine('vecs.v', 'q.v')} AS score FROM vecs, q)"


def r6(c: str):
    return F.round(c, 6).alias(c)



@query(f"WITH {T.VECS}, {_Q}, {_SEM} SELECT vec_id AS chunk_id, round(score, 6) AS score FROM sem ORDER BY score DESC, vec_id LIMIT 20")
def semantic_topk(spark, d):
    return search.top_k(search.semantic(T.vectors(spark, d), T.vector(spark, d)), "score", "chunk_id", 20).select("chunk_id", r6("score"))


@query(f"WITH {T.VECS}, {_Q}, {_SEM} SELECT vec_id AS chunk_id, round(1 - score, 6) AS distance FROM sem ORDER BY 1 - score, vec_id LIMIT 20")
def semantic_by_distance(spark, d):
    return search.by_distance(T.vectors(spark, d), T.vector(spark, d), 20).select("chunk_id", r6("distance"))


@query(f"WITH {T.VECS}, m AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round({T.cosine('a.v', 'b.v')}, 12) AS score FROM vecs a, vecs b WHERE a.vec_id % 20 = 0) SELECT query_id, chunk_id, round(score, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10")
def semantic_topk_batch(spark, d):
    v = T.vectors(spark, d)
    queries = v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return search.search_batch(v, queries, 10).select("query_id", "chunk_id", r6("score"))


@query(f"WITH {_LEX} SELECT doc_id AS chunk_id, round(bm25, 6) AS bm25, round(bm25 / (bm25 + 1.5), 6) AS score FROM lex ORDER BY lex.bm25 DESC, doc_id LIMIT 25")
def lexical_bm25_topk(spark, d):
    docs = T.documents(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    top = search.top_k(lexical.score(docs, WORDS), "bm25", "chunk_id", 25)
    return top.select("chunk_id", F.round("bm25", 6).alias("bm25"), F.round(lexical.saturated(F.col("bm25")), 6).alias("score"))


@query(f"WITH {_LEX} SELECT doc_id AS chunk_id, round(bm25, 6) AS bm25, round(bm25 / (bm25 + 1.5), 6) AS score FROM lex ORDER BY lex.bm25 DESC, doc_id LIMIT 25")
def lexical_index_topk(spark, d):
    """The same from the stored index of terms."""
    top = search.top_k(lexical.score_terms(_stored_terms(spark, d), WORDS), "bm25", "chunk_id", 25)
    return top.select("chunk_id", F.round("bm25", 6).alias("bm25"), F.round(lexical.saturated(F.col("bm25")), 6).alias("score"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents)
SELECT doc_id AS chunk_id FROM t WHERE list_contains(t, 'the') AND NOT list_contains(t, 'scum') AND contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')""")
def lexical_index_syntax(spark, d):
    return lexical.score_terms(_stored_terms(spark, d), '+the -scum "of the"').select("chunk_id")


@query("SELECT doc_id AS chunk_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY ALL")
def lexical_terms_table(spark, d):
    return _terms(spark, d).where("field = 'c' AND term != ''").select("chunk_id", "term", "tf")


def _terms(spark, d):
    docs = T.documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "path", F.col("text").alias("content"))
    return lexical.terms(docs, plain=False)


def _stored_terms(spark, d):
    """The index as a store holds it: written in pieces of some thousand documents, each sorted by term in memory."""
    at = scratch.fresh(spark, "terms")
    docs = T.pieces(T.documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "path", F.col("text").alias("content")), "chunk_id")
    lexical.terms(docs, plain=False).sortWithinPartitions("term", "chunk_id").write.option("compression", "zstd").parquet(at)
    return spark.read.parquet(at)


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents)
SELECT doc_id AS chunk_id FROM t WHERE list_contains(t, 'the') AND NOT list_contains(t, 'scum') AND contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')""")
def lexical_query_syntax(spark, d):
    docs = T.documents(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return lexical.score(docs, '+the -scum "of the"').select("chunk_id")


_FUSED = f"""{T.VECS}, {_Q}, {_SEM}, {_LEX},
ra AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM sem QUALIFY r <= 50), rb AS (SELECT doc_id AS id, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS r FROM lex QUALIFY r <= 50),
fused AS (SELECT id, sum(1.0 / (60 + r)) / (2.0 / 61) AS score FROM (SELECT * FROM ra UNION ALL SELECT * FROM rb) GROUP BY id), {T.FILES}"""


def _hybrid(spark, d, **kw):
    return search.search(T.index(spark, d), search.Query(text=WORDS, vector=tuple(T.vector(spark, d)), **kw))


@query(f"WITH {_FUSED} SELECT doc_id AS chunk_id, path, round(score, 6) AS score FROM fused JOIN files ON id = doc_id ORDER BY fused.score DESC, doc_id LIMIT 10")
def hybrid_rrf(spark, d):
    return _hybrid(spark, d).select("chunk_id", "path", r6("score"))


@query(f"WITH {_FUSED} SELECT doc_id AS chunk_id, path, round(score, 6) AS score FROM fused JOIN files ON id = doc_id WHERE path LIKE 'en/%' ORDER BY fused.score DESC, doc_id LIMIT 10")
def hybrid_scoped_widening(spark, d):
    return _hybrid(spark, d, scope="en").select("chunk_id", "path", r6("score"))


@query(f"WITH {T.VECS}, {_Q}, {_SEM}, {T.FILES} SELECT doc_id AS chunk_id, round(score, 6) AS score FROM sem JOIN files ON vec_id = doc_id WHERE score >= 0.2 ORDER BY sem.score DESC, doc_id LIMIT 15")
def semantic_min_score(spark, d):
    q = search.Query(mode="semantic", vector=tuple(T.vector(spark, d)), limit=15, min_score=0.2)
    return search.search(T.index(spark, d), q).select("chunk_id", r6("score"))


@query(f"WITH {T.VECS}, {_Q}, {_SEM}, {T.FILES} SELECT doc_id AS chunk_id, round(score, 6) AS score FROM sem JOIN files ON vec_id = doc_id WHERE lang = 'en' AND quality = 1 AND n_chars BETWEEN 500 AND 5000 ORDER BY sem.score DESC, doc_id LIMIT 10")
def semantic_filtered_scoped(spark, d):
    q = search.Query(mode="semantic", vector=tuple(T.vector(spark, d)), scope="en", filters=(P.parse("quality=1"), P.Range("n_chars", 500, 5000)))
    return search.search(T.index(spark, d), q).select("chunk_id", r6("score"))


def _filtered(spark, d, *filters):
    return T.files(spark, d).where(P.conjunction(F.col("metadata"), list(filters))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'fr'")
def filter_equals(spark, d):
    return _filtered(spark, d, P.Equals("lang", "fr"))


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3')")
def filter_in(spark, d):
    return _filtered(spark, d, P.In("source", ("src1", "src2", "src3")))


@query("SELECT doc_id FROM documents WHERE n_chars >= 1000 AND n_chars <= 2000")
def filter_range(spark, d):
    return _filtered(spark, d, P.Range("n_chars", 1000, 2000))


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def filter_exists(spark, d):
    return _filtered(spark, d, P.Exists("quality"))


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' AND toxic = 0 AND n_chars <= 3000 AND source >= 'src1' AND source <= 'src2'")
def filter_and_combo(spark, d):
    return _filtered(spark, d, P.Equals("lang", "en"), P.Equals("toxic", 0), P.Range("n_chars", max=3000), P.Range("source", "src1", "src2"))


@query("""SELECT 'orders/' || o_orderkey || '.md' AS path, o_custkey = 7 AS same, o_custkey IN (7, 8, 11) AS listed FROM orders""")
def filter_relation_aware(spark, d):
    """Links in two spellings against a path, and against a list of spellings."""
    o = T.dealt(T.table(spark, d, "orders"), "o_orderkey").select("o_orderkey", F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("c"))
    odd = F.to_json(F.struct(F.array(F.concat(F.lit("[name]("), "c", F.lit(".md)"))).alias("client")))
    meta = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("[["), "c", F.lit("|name]]")).alias("client")))).otherwise(odd)
    equal, some = P.Equals("client", "customer/7"), P.In("client", ("[[customer/7]]", "customer/8.md", "[[customer/11]]"))
    return o.select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"), P.conjunction(meta, [equal]).alias("same"), P.conjunction(meta, [some]).alias("listed"))


_NOW = T.NOW
_DECAY = f"CASE WHEN path LIKE 'de/%' THEN 1.0 ELSE 0.5 ** (greatest({_NOW} - coalesce(CASE WHEN doc_id % 5 != 0 THEN {_NOW} - doc_id * 3600 - 86400 END, {_NOW} - doc_id * 3600), 0) / 86400.0 / 30.0) END"


@query(f"WITH {T.VECS}, {_Q}, {_SEM}, {T.FILES}, s AS (SELECT doc_id AS chunk_id, score * {_DECAY} AS score FROM sem JOIN files ON vec_id = doc_id) SELECT chunk_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, chunk_id LIMIT 20")
def time_decay(spark, d):
    q = search.Query(mode="semantic", vector=tuple(T.vector(spark, d)), limit=20, half_life=30.0, now=T.NOW, decay_exclude=("de",))
    return search.search(T.index(spark, d), q).select("chunk_id", r6("score"))


@query("""WITH m AS (SELECT max(epoch(ts)) AS now FROM events)
SELECT event_id, round(value * 0.5 ** (greatest(now - floor(epoch(ts)), 0) / 86400.0 / 90.0), 4) AS score FROM events, m""")
def time_decay_events(spark, d):
    ev = T.table(spark, d, "events").select("event_id", "value", F.unix_timestamp("ts").alias("at"))
    now = T.table(spark, d, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)).head()[0]
    age = F.greatest(F.lit(now) - F.col("at"), F.lit(0.0)) / 86400.0
    return ev.select("event_id", F.round(F.col("value") * F.pow(F.lit(0.5), age / 90.0), 4).alias("score"))


_EDGES = """evec AS (SELECT 'edge:' || l.source || '->' || l.target || '@' || l.line AS edge_id, l.source, l.target, CASE WHEN l.line = 1 THEN v ELSE v[2:] || v[1:1] END AS v FROM links l JOIN files f ON l.source = f.path JOIN vecs ON vec_id = f.doc_id)"""
_BOTH = "bi AS (SELECT source AS a, target AS b FROM links UNION SELECT target, source FROM links)"


@query(f"""WITH {_FUSED}, {T.LINKS}, {_EDGES}, {_BOTH},
top AS (SELECT doc_id AS chunk_id, path, score FROM fused JOIN files ON id = doc_id ORDER BY score DESC, doc_id LIMIT 10), seeds AS (SELECT path FROM top ORDER BY score DESC, chunk_id LIMIT 3),
h1 AS (SELECT DISTINCT b AS path, 1 AS hop FROM bi JOIN seeds ON a = path WHERE b NOT IN (SELECT path FROM seeds)),
h2 AS (SELECT DISTINCT b AS path, 2 AS hop FROM bi JOIN h1 ON a = h1.path WHERE b NOT IN (SELECT path FROM seeds) AND b NOT IN (SELECT path FROM h1)),
hops AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2), es AS (SELECT unnest([source, target]) AS path, greatest(0, least(1, {T.cosine('e.v', 'q.v')})) AS s FROM evec e, q), best AS (SELECT path, max(s) AS s FROM es GROUP BY path)
SELECT chunk_id, round(top.score * CASE WHEN hop IS NULL THEN 1 ELSE 1 + 0.15 * coalesce(best.s, 1) / 2 ** (hop - 1) END, 6) AS score FROM top LEFT JOIN hops USING (path) LEFT JOIN best USING (path)""")
def link_boost(spark, d):
    return _hybrid(spark, d, boost_links=True, boost_hops=2).select("chunk_id", r6("score"))


@query(f"""WITH {_FUSED}, {T.LINKS}, {_BOTH},
top AS (SELECT doc_id AS chunk_id, path, score FROM fused JOIN files ON id = doc_id ORDER BY score DESC, doc_id LIMIT 10), seeds AS (SELECT path, row_number() OVER (ORDER BY score DESC, chunk_id) AS pos FROM top QUALIFY pos <= 3),
h1 AS (SELECT DISTINCT b AS path, 1 AS hop FROM bi JOIN seeds ON a = path WHERE b NOT IN (SELECT path FROM seeds)),
h2 AS (SELECT DISTINCT b AS path, 2 AS hop FROM bi JOIN h1 ON a = h1.path WHERE b NOT IN (SELECT path FROM seeds) AND b NOT IN (SELECT path FROM h1)),
t AS (SELECT * FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) WHERE path NOT IN (SELECT path FROM top)), near AS (SELECT vec_id, score FROM sem ORDER BY score DESC, vec_id LIMIT (SELECT greatest(100, 10 * count(*)) FROM t)),
c AS (SELECT t.path, t.hop, files.doc_id AS chunk_id, coalesce(near.score, 0) AS score FROM t JOIN files USING (path) LEFT JOIN near ON vec_id = doc_id)
SELECT path, hop::INT AS hop, chunk_id, round(score, 6) AS score, coalesce((SELECT s.path FROM seeds s JOIN bi ON a = s.path WHERE b = c.path ORDER BY pos LIMIT 1), (SELECT path FROM seeds WHERE pos = 1)) AS linked_from
FROM c QUALIFY row_number() OVER (PARTITION BY hop ORDER BY c.score DESC, path) <= 3""")
def graph_expansion(spark, d):
    ix, q = T.index(spark, d), tuple(T.vector(spark, d))
    found = search.search(ix, search.Query(text=WORDS, vector=q))
    return search.expand(found, ix, q, depth=2).select("path", "hop", "chunk_id", r6("score"), "linked_from")


@query(f"WITH {T.VECS}, {_Q}, {T.FILES}, {T.LINKS}, {_EDGES}, s AS (SELECT edge_id, source, target, {T.cosine('evec.v', 'q.v')} AS score FROM evec, q WHERE source LIKE 'en/%') SELECT edge_id, source, target, round(score, 6) AS score FROM s ORDER BY s.score DESC, edge_id LIMIT 10")
def edge_search(spark, d):
    q = search.Query(mode="edge", vector=tuple(T.vector(spark, d)), scope="en")
    return search.search(T.index(spark, d), q).select("edge_id", "source", "target", r6("score"))
