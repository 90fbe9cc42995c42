"""Link graph queries: over documents' reading links, over keys of the star schema, and over links in pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import paths
from larkspur.operators import collection, graph, neighbors
from larkspur.plans import tables as T
from larkspur.plans.registry import query

_L = f"{T.FILES}, {T.LINKS}"
_BI = "bi AS (SELECT source AS a, target AS b FROM links UNION SELECT target, source FROM links)"


@query(f"WITH {_L} SELECT l.source, l.target, l.line, CASE WHEN f.path IS NULL THEN 'Broken' ELSE 'Valid' END AS state FROM links l LEFT JOIN files f ON l.target = f.path")
def forward_links(spark, d):
    return graph.forward(T.links(spark, d), T.documents(spark, d)).select("source", "target", "line", "state")


@query(f"WITH {_L} SELECT target, source, line FROM links WHERE target IN (SELECT path FROM files WHERE doc_id IN (4, 7, 10))")
def backlinks(spark, d):
    wanted = T.documents(spark, d).where("doc_id IN (4, 7, 10)").select(F.col("path").alias("target"))
    return graph.backlinks(T.links(spark, d).join(wanted, "target", "left_semi")).select("target", "source", "line")


@query(f"WITH {_L} SELECT source, target FROM links WHERE target NOT IN (SELECT path FROM files)")
def broken_links(spark, d):
    return graph.broken(T.links(spark, d), T.documents(spark, d)).select("source", "target")


_STAR = """star AS (SELECT 'orders/' || o_orderkey AS source, 'customer/' || o_custkey AS target FROM orders
UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation)"""


def star(spark, d):
    """(source, target): foreign keys as links."""
    out = None
    for name, key, other, to in (("orders", "o_orderkey", "o_custkey", "customer"), ("customer", "c_custkey", "c_nationkey", "nation"), ("supplier", "s_suppkey", "s_nationkey", "nation"), ("nation", "n_nationkey", "n_regionkey", "region")):
        one = T.table(spark, d, name).select(F.concat(F.lit(f"{name}/"), F.col(key).cast("string")).alias("source"), F.concat(F.lit(f"{to}/"), F.col(other).cast("string")).alias("target"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_STAR} SELECT 'customer/' || c_custkey AS path FROM customer WHERE 'customer/' || c_custkey NOT IN (SELECT 'customer/' || o_custkey FROM orders) UNION ALL SELECT 'supplier/' || s_suppkey FROM supplier")
def orphans(spark, d):
    """Customers without orders, and the suppliers, which no order names."""
    files = T.table(spark, d, "customer").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("path"))
    files = files.unionByName(T.table(spark, d, "supplier").select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("path")))
    orders = star(spark, d).where(F.col("source").startswith("orders/"))
    return graph.orphans(files, orders)


@query(f"""WITH {_STAR}, bi AS (SELECT source AS a, target AS b FROM star UNION SELECT target, source FROM star),
h1 AS (SELECT DISTINCT b AS path, 1 AS hop FROM bi WHERE a IN ('customer/1', 'supplier/2') AND b NOT IN ('customer/1', 'supplier/2')),
h2 AS (SELECT DISTINCT b AS path, 2 AS hop FROM bi JOIN h1 ON a = h1.path WHERE b NOT IN ('customer/1', 'supplier/2') AND b NOT IN (SELECT path FROM h1)),
h3 AS (SELECT DISTINCT b AS path, 3 AS hop FROM bi JOIN h2 ON a = h2.path WHERE b NOT IN ('customer/1', 'supplier/2') AND b NOT IN (SELECT path FROM h1) AND b NOT IN (SELECT path FROM h2))
SELECT path, hop::INT AS hop FROM (FROM h1 UNION ALL FROM h2 UNION ALL FROM h3)""")
def bfs_min_hop(spark, d):
    return graph.bfs(star(spark, d), ["customer/1", "supplier/2"], 3)


@query(f"""WITH {_L}, s AS (SELECT path FROM files WHERE doc_id = 1),
t1 AS (SELECT [source, target] AS t FROM links WHERE source IN (FROM s)), t2 AS (SELECT list_append(t, target) AS t FROM t1 JOIN links ON source = t[-1] WHERE NOT list_contains(t, target)),
t3 AS (SELECT list_append(t, target) AS t FROM t2 JOIN links ON source = t[-1] WHERE NOT list_contains(t, target))
SELECT array_to_string(t, '>') AS trail, t[-1] AS path, (len(t) - 1)::INT AS hop FROM (FROM t1 UNION ALL FROM t2 UNION ALL FROM t3)""")
def neighborhood_paths(spark, d):
    start = T.documents(spark, d).where("doc_id = 1").select("path").head()[0]
    return graph.neighborhood(T.links(spark, d), start, 3)


@query(f"""WITH {_L}, s AS (SELECT path FROM files WHERE doc_id = 1), t1 AS (SELECT [target, source] AS t FROM links WHERE target IN (FROM s)), t2 AS (SELECT list_append(t, source) AS t FROM t1 JOIN links ON target = t[-1] WHERE NOT list_contains(t, source))
SELECT count(*) AS nodes, coalesce(max(len(t) - 1), 0)::INT AS depth FROM (FROM t1 UNION ALL FROM t2)""")
def neighborhood_counts(spark, d):
    start = T.documents(spark, d).where("doc_id = 1").select("path").head()[0]
    return graph.tree_counts(graph.neighborhood(T.links(spark, d), start, 2, reverse=True))


@query(f"WITH {_L} SELECT source, target, line FROM links WHERE source LIKE 'en/%' AND target LIKE 'en/%'")
def doc_graph_edges(spark, d):
    _, edges = graph.document_graph(T.documents(spark, d), T.links(spark, d), scope="en")
    return edges.select("source", "target", "line")


@query(f"""WITH {T.VECS}, m AS (SELECT a.vec_id AS q, b.vec_id AS id, a.label AS ql, b.label AS l, round({T.cosine('a.v', 'b.v')}, 12) AS s FROM vecs a JOIN vecs b ON a.vec_id != b.vec_id),
w AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, id) <= 25), k AS (SELECT * FROM w WHERE ql != l QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, id) <= 5)
SELECT least(q, id) AS a, greatest(q, id) AS b, round(max(s), 6) AS weight FROM k GROUP BY ALL""")
def chunk_graph_topk_cross(spark, d):
    v = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("label/"), F.col("label").cast("string")).alias("path"), F.col("embedding").alias("vector"))
    return graph.chunk_graph(v).select("a", "b", F.round("weight", 6).alias("weight"))


@query(f"WITH {_L}, e AS (SELECT 'edge:' || source || '->' || target || '@' || line AS edge_id, 'from ' || source AS context FROM links), c AS (SELECT context, row_number() OVER (ORDER BY min(edge_id), context) - 1 AS context_index FROM e GROUP BY context) SELECT edge_id, context_index::BIGINT AS context_index FROM e JOIN c USING (context)")
def compact_contexts(spark, d):
    edges, _ = graph.interned(T.index(spark, d).edges)
    return edges.select("edge_id", F.col("context_index").cast("long").alias("context_index"))


@query(f"""WITH {_L}, {T.VECS}, evec AS (SELECT 'edge:' || l.source || '->' || l.target || '@' || l.line AS edge_id, l.target, CASE WHEN l.line = 1 THEN v ELSE v[2:] || v[1:1] END AS v FROM links l JOIN files f ON l.source = f.path JOIN vecs ON vec_id = f.doc_id)
SELECT edge_id, round({T.cosine('evec.v', 't.v')}, 6) AS strength FROM evec JOIN files ON files.path = evec.target JOIN vecs t ON t.vec_id = files.doc_id""")
def edge_strength(spark, d):
    ix = T.index(spark, d)
    docs = T.documents(spark, d).join(T.table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id")).select("path", F.col("embedding").alias("vector"))
    return graph.strength(ix.edges, ix.edge_vectors, docs).select("edge_id", F.round("strength", 6).alias("strength"))


@query(f"WITH {_L} SELECT 'edge:' || source || '->' || target || '@' || line AS edge_id, source, target FROM links WHERE source = (SELECT path FROM files WHERE doc_id = 3) OR target = (SELECT path FROM files WHERE doc_id = 3)")
def edges_of_file(spark, d):
    path = T.documents(spark, d).where("doc_id = 3").select("path").head()[0]
    edges = T.index(spark, d).edges
    return edges.where((F.col("source") == path) | (F.col("target") == path)).select("edge_id", "source", "target")


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"#?]*)"', 1)) AS href FROM pages)
SELECT page_id, href, CASE WHEN regexp_replace(href, '/+$', '') LIKE '%.md' THEN href ELSE href || '.md' END AS target, count(*) AS n FROM h GROUP BY ALL""")
def resolve_links(spark, d):
    hrefs = T.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"#?]*)"'), F.lit(1))).alias("href"))
    return hrefs.select("page_id", "href", paths.resolve_link(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".md")), F.col("href")).alias("target")).groupBy("page_id", "href", "target").agg(F.count("*").alias("n"))



_RELATED = """o AS (SELECT 'orders/' || o_orderkey || '.md' AS source, 'customer/' || o_custkey || '.md' AS target, o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)),
c AS (SELECT 'customer/' || c_custkey || '.md' AS path, c_name AS title FROM customer)"""


def star_files(spark, d):
    """Customers, and orders that name their customer in a field, as files."""
    c = T.dealt(T.table(spark, d, "customer"), "c_custkey").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"), F.to_json(F.struct(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("segment"))).alias("metadata"))
    o = T.dealt(T.table(spark, d, "orders"), "o_orderkey").select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"), F.to_json(F.struct(F.concat(F.lit("[[customer/"), F.col("o_custkey").cast("string"), F.lit("]]")).alias("client"), F.col("o_orderstatus").alias("status"))).alias("metadata"))
    return c.unionByName(o)


@query(f"WITH {_RELATED} SELECT o.source AS path, 'client' AS field, o.target, c.title FROM o JOIN c ON o.target = c.path")
def relation_populate(spark, d):
    files = star_files(spark, d)
    related = collection.relations(files)
    orders = files.where(F.col("path").startswith("orders/"))
    got = collection.populate(orders, related, files).select("path", F.explode("relations").alias("field", "items"))
    return got.select("path", "field", F.explode("items").alias("i")).select("path", "field", "i.target", "i.title")


@query(f"WITH {_RELATED} SELECT target, source, 'client' AS field, regexp_extract(source, '([^/]*)\\.md$', 1) AS title FROM o")
def referenced_by(spark, d):
    files = star_files(spark, d)
    return collection.referenced_by(collection.relations(files), files)


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT a.vec_id AS q, b.vec_id AS id, round(" + T.cosine("a.v", "b.v") + ", 12) AS s FROM v a JOIN v b ON a.vec_id != b.vec_id), k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, id) <= 15) SELECT least(q, id) AS a, greatest(q, id) AS b, round(max(s), 6) AS weight FROM k WHERE s > 0 GROUP BY ALL")
def knn_graph(spark, d):
    ids = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return neighbors.graph(ids, 15).select("a", "b", F.round("weight", 6).alias("weight"))


@query(f"""WITH {T.FILES}, p AS (SELECT string_split(path, '/') AS s FROM files), n AS (SELECT unnest([array_to_string(s[1:1], '/'), array_to_string(s[1:2], '/'), array_to_string(s, '/')]) AS path, unnest([1, 2, 3]) AS depth FROM p)
SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, depth::INT AS depth, depth < 3 AS is_dir, count(*) AS files FROM n GROUP BY ALL""")
def file_tree(spark, d):
    return graph.file_tree(T.documents(spark, d))


@query("""SELECT 'a/' || p_brand || '/' || p_partkey || '.md' AS source, CASE p_partkey % 4 WHEN 0 THEN 'a/x' || p_size || '.md' WHEN 1 THEN 'a/' || p_brand || '/y' || p_size || '.md' WHEN 2 THEN 'a/' || p_brand || '/e.md' ELSE '' END AS resolved FROM part""")
def resolve_links_relative(spark, d):
    size = F.col("p_size").cast("string")
    fourth = F.col("p_partkey") % 4
    target = F.when(fourth == 0, F.concat(F.lit("../x"), size)).when(fourth == 1, F.concat(F.lit("./y"), size, F.lit(".md#frag"))).when(fourth == 2, "d\\..\\e").otherwise("#top")
    rows = T.table(spark, d, "part").select(F.concat(F.lit("a/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("source"), target.alias("target"))
    return rows.select("source", paths.resolve_link(F.col("source"), F.col("target")).alias("resolved"))
