"""Clusters, keywords, topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.functions import vectors as V
from larkspur.operators import clustering as C
from larkspur.operators import neighbors
from larkspur.plans import tables as T
from larkspur.plans.registry import query


def _vectors(spark, d):
    return T.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.col("embedding").alias("vector"), F.col("label").alias("cluster_id"))


_MEAN = "means AS (SELECT label, list(m ORDER BY i) AS mean FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vecs) GROUP BY label, i) GROUP BY label)"


@query(f"WITH {T.VECS}, {_MEAN} SELECT label, unnest(generate_series(1, len(mean)))::INT AS i, round(unnest(mean), 6) AS x FROM means")
def doc_vector_mean(spark, d):
    means = V.means(_vectors(spark, d), "cluster_id", "vector")
    return means.select(F.col("cluster_id").alias("label"), F.posexplode("mean").alias("i", "x")).select("label", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


_UNIT = "unit AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM vecs)"
_CENTER = "c AS (SELECT label, list(m ORDER BY i) AS mean FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM unit) GROUP BY label, i) GROUP BY label)"


@query(f"WITH {T.VECS}, {_UNIT}, {_CENTER}, s AS (SELECT vecs.label, vec_id::VARCHAR AS path, round({T.cosine('v', 'mean')}, 12) AS s FROM vecs JOIN c USING (label)) SELECT label AS cluster_id, path AS representative FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, path) = 1")
def cluster_representative(spark, d):
    v = _vectors(spark, d)
    members = v.select("path", "cluster_id")
    return C.representatives(members, v.select("path", "vector"), C.centroids(members, v.select("path", "vector")))


@query(f"WITH {T.VECS}, {_UNIT}, {_CENTER}, s AS (SELECT vec_id::VARCHAR AS path, c.label, round({T.cosine('v', 'mean')}, 12) AS s FROM vecs, c) SELECT path, label AS cluster_id FROM s QUALIFY row_number() OVER (PARTITION BY path ORDER BY s DESC, label) = 1")
def nearest_centroid(spark, d):
    v = _vectors(spark, d)
    centers = C.centroids(v.select("path", "cluster_id"), v.select("path", "vector"))
    return C.nearest_centroid(v.select("path", "vector"), centers).select("path", "cluster_id")


def _keywords(spark, d):
    docs = T.spread(T.table(spark, d, "documents")).select(F.col("lang").alias("cluster_id"), "text")
    return C.keywords(docs)


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOP_WORDS)
_TERMS = f"""t AS (SELECT lang, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents), p AS (SELECT lang, unnest(list_zip(ws, list_append(ws[2:], ''))) AS z FROM t),
k AS (SELECT lang, z[1] AS a, z[2] AS b, strlen(z[1]) >= 3 AND z[1] NOT IN ({_STOP}) AS ka, strlen(z[2]) >= 3 AND z[2] NOT IN ({_STOP}) AS kb FROM p),
terms AS (SELECT lang, a AS term FROM k WHERE ka UNION ALL SELECT lang, a || ' ' || b FROM k WHERE ka AND kb), tf AS (SELECT lang, term, count(*) AS tf FROM terms GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), s AS (SELECT lang, term, tf * (ln((1 + (SELECT count(DISTINCT lang) FROM documents)) / (1 + df)) + 1) AS score FROM tf JOIN df USING (term))"""


@query(f"WITH {_TERMS} SELECT lang AS cluster_id, term, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term)::INT AS rank, round(score, 4) AS score FROM s QUALIFY rank <= 5")
def tfidf_keywords(spark, d):
    return _keywords(spark, d).select("cluster_id", "term", "rank", F.round("score", 4).alias("score"))


@query(f"""WITH RECURSIVE {_TERMS}, kw AS (SELECT lang AS cluster_id, term, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS rank FROM s QUALIFY rank <= 5),
r AS (SELECT DISTINCT cluster_id, 0 AS i, []::VARCHAR[] AS chosen FROM kw UNION ALL SELECT r.cluster_id, i + 1, CASE WHEN len(chosen) >= 3 OR (NOT contains(term, ' ') AND len(list_filter(chosen, lambda c: contains(c, ' ') AND list_contains(string_split(c, ' '), term))) > 0) THEN chosen ELSE list_append(chosen, term) END FROM r JOIN kw ON kw.cluster_id = r.cluster_id AND kw.rank = i + 1)
SELECT cluster_id, array_to_string(chosen, ' / ') AS label FROM r WHERE i = 5""")
def cluster_label(spark, d):
    return C.labels(_keywords(spark, d))


@query()
def leiden_communities(spark, d):
    return C.communities(_vectors(spark, d).select("path", "vector"))


@query("SELECT count(*) AS documents, true AS once, true AS better_than_labels FROM embeddings")
def leiden_properties(spark, d):
    """Every document is in one community, and the modularity is at least that of the labels the vectors were made with."""
    v = _vectors(spark, d)
    found = C.communities(v.select("path", "vector")).select("path", "cluster_id")
    edges = neighbors.graph(v.select(F.col("path").alias("id"), "vector"), C.K)
    q = [C.partition_modularity(edges, m).withColumnRenamed("modularity", n) for m, n in ((found, "found"), (v.select("path", "cluster_id"), "labels"))]
    count = found.agg(F.count("*").alias("documents"), (F.count_distinct("path") == F.count("*")).alias("once"))
    return count.join(q[0]).join(q[1]).select("documents", "once", (F.col("found") >= F.col("labels") - 0.01).alias("better_than_labels"))


@query("SELECT count(*) AS documents, true AS once, true AS nearest FROM embeddings")
def kmeans_properties(spark, d):
    """Every document is in one cluster, and in that whose mean is nearest, as K-means ends (one in a hundred may lie between two)."""
    v = _vectors(spark, d)
    unit = v.select("path", V.normalized(F.col("vector")).alias("vector"))
    found = C.kmeans(v.select("path", "vector"), 10).select("path", "cluster_id")
    means = V.means(found.join(unit, "path"), "cluster_id", "vector").agg(F.collect_list(F.struct(F.col("cluster_id").alias("c"), "mean")).alias("ms"))  # one row of ten
    far = lambda m: F.aggregate(F.zip_with("vector", m["mean"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda x, y: x + y)
    nearest = F.array_min(F.transform("ms", lambda m: F.struct(far(m).alias("d"), m["c"].alias("c"))))["c"]
    rows = unit.join(F.broadcast(means)).select("path", nearest.alias("near")).join(found, "path")
    return rows.agg(F.count("*").alias("documents"), (F.count_distinct("path") == F.count("*")).alias("once"), (F.avg((F.col("cluster_id") == F.col("near")).cast("int")) >= 0.99).alias("nearest"))


@query("SELECT 'members' AS part, count(*) AS documents, true AS sound FROM embeddings UNION ALL SELECT 'parts', 0, true")
def cluster_pass_properties(spark, d):
    """A full pass with a former one: each document once, and every cluster has one centroid, parent, representative and label."""
    v = _vectors(spark, d)
    texts = T.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    got = C.cluster(v.select("path", "vector"), texts, v.select("path", "cluster_id"), 1000)
    members = got["members"].agg(F.lit("members").alias("part"), F.count("*").alias("documents"), (F.count("*") == F.count_distinct("path")).alias("sound"))
    every = got["members"].join(texts, "path").select("cluster_id").distinct()  # clusters without any text have no keywords
    bad = None
    for name in ("centroids", "parents", "representatives", "labels"):
        one = got[name].groupBy("cluster_id").count().join((every if name == "labels" else got["members"].select("cluster_id").distinct()).withColumn("known", F.lit(True)), "cluster_id", "full").where("count IS NULL OR count != 1 OR known IS NULL").select("cluster_id")
        bad = one if bad is None else bad.unionByName(one)
    return members.unionByName(bad.agg(F.lit("parts").alias("part"), F.count("*").alias("documents"), (F.count("*") == 0).alias("sound")))


@query(f"WITH {T.FILES}, {T.LINKS} SELECT count(*) AS edges, true AS once, true AS few FROM links l JOIN files f ON l.source = f.path JOIN embeddings ON vec_id = doc_id")
def edge_cluster_properties(spark, d):
    ix = T.index(spark, d)
    members, labels = C.edge_clusters(ix.edges, ix.edge_vectors)
    return members.join(labels, "cluster_id").agg(F.count("*").alias("edges"), (F.count("*") == F.count_distinct("edge_id")).alias("once"), (F.count_distinct("cluster_id") <= 20).alias("few"))


@query()
def kmeans_clusters(spark, d):
    return C.kmeans(_vectors(spark, d).select("path", "vector"), 10)


@query()
def cluster_full_pass(spark, d):
    v = _vectors(spark, d).select("path", "vector")
    texts = T.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    got = C.cluster(v, texts)
    return got["representatives"].join(got["labels"], "cluster_id", "left")


@query()
def edge_clusters(spark, d):
    ix = T.index(spark, d)
    members, labels = C.edge_clusters(ix.edges, ix.edge_vectors)
    return members.join(labels, "cluster_id")


def _topics(spark, d):
    """Topic t of the first four labels: described by that label's mean, seeded by its first two vectors."""
    v = _vectors(spark, d).where("cluster_id < 4")
    seeds = v.groupBy("cluster_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.col("path").cast("long").alias("i"), "vector"))), 1, 2).alias("s"))
    rows = V.means(v, "cluster_id", "vector").join(seeds, "cluster_id")
    return C.topic_centroids(rows.select(F.concat(F.lit("topic "), F.col("cluster_id").cast("string")).alias("topic"), F.col("mean").cast("array<float>").alias("description_vector"), F.transform("s", lambda x: x["vector"]).alias("seed_vectors"), F.when(F.col("cluster_id") == 1, 0.5).alias("threshold")))


_TOPICS = f"""{T.VECS}, {_MEAN}, sd AS (SELECT label, vec_id, v FROM vecs WHERE label < 4 QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 2),
sm AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM sd) GROUP BY label, i) GROUP BY label),
tc AS (SELECT label, list_transform(list_zip(mean::FLOAT[]::DOUBLE[], m), lambda z: 0.6 * z[1] + 0.4 * z[2]) AS c, CASE WHEN label = 1 THEN 0.5 ELSE 0.3 END AS bound FROM means JOIN sm USING (label)),
at AS (SELECT vec_id, 'topic ' || tc.label AS topic, round({T.cosine('v', 'c')}, 12) AS score, bound FROM vecs, tc), hit AS (SELECT * FROM at WHERE score >= bound)""".replace("at AS", "att AS").replace("FROM at ", "FROM att ")


@query(f"WITH {_TOPICS} SELECT vec_id::VARCHAR AS path, topic, round(score, 6) AS score FROM hit")
def topic_assignment(spark, d):
    return C.assign_topics(_vectors(spark, d).select("path", "vector"), _topics(spark, d)).select("path", "topic", F.round("score", 6).alias("score"))


@query(f"WITH {_TOPICS} SELECT vec_id::VARCHAR AS path FROM vecs WHERE vec_id NOT IN (SELECT vec_id FROM hit)")
def topic_unassigned(spark, d):
    v = _vectors(spark, d).select("path", "vector")
    return C.unassigned(v, C.assign_topics(v, _topics(spark, d)))


@query(f"WITH {_TOPICS} SELECT vec_id::VARCHAR AS path, topic FROM hit QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, topic) = 1")
def topic_primary(spark, d):
    return C.primary_topic(C.assign_topics(_vectors(spark, d).select("path", "vector"), _topics(spark, d))).select("path", "topic")


@query(f"WITH {_TOPICS} SELECT topic, count(*) AS members, round(avg(score), 6) AS mean_score FROM hit GROUP BY topic")
def topic_info(spark, d):
    return C.topic_info(C.assign_topics(_vectors(spark, d).select("path", "vector"), _topics(spark, d))).select("topic", "members", F.round("mean_score", 6).alias("mean_score"))


@query("WITH o AS (SELECT vec_id, label AS c FROM embeddings), n AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END AS c FROM embeddings), b AS (SELECT o.c AS old_id, n.c AS new_id, count(*) AS x FROM o JOIN n USING (vec_id) GROUP BY ALL) SELECT old_id, new_id, round(x / ((SELECT count(*) FROM o WHERE c = old_id) + (SELECT count(*) FROM n WHERE c = new_id) - x), 6) AS jaccard FROM b")
def cluster_identity_jaccard(spark, d):
    old = _vectors(spark, d).select("path", "cluster_id")
    moved = F.when(F.col("path").cast("long") % 5 == 0, (F.col("cluster_id") + 1) % 10).otherwise(F.col("cluster_id"))
    return C.overlaps(old, old.select("path", moved.cast("int").alias("cluster_id"))).select("old_id", "new_id", F.round("jaccard", 6).alias("jaccard"))


@query(f"WITH {T.VECS}, m AS (SELECT a.vec_id AS q, b.label, round({T.cosine('a.v', 'b.v')}, 12) AS s, b.vec_id AS id FROM vecs a JOIN vecs b ON a.vec_id % 10 = 0 AND b.vec_id % 10 != 0), k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, id) <= 15), g AS (SELECT q, label, round(sum(s), 12) AS s FROM k WHERE s > 0 GROUP BY ALL) SELECT q::VARCHAR AS path, label AS cluster_id FROM g QUALIFY row_number() OVER (PARTITION BY q ORDER BY g.s DESC, label) = 1")
def cluster_assign_vote(spark, d):
    v = _vectors(spark, d)
    fresh, old = v.where(F.col("path").cast("long") % 10 == 0), v.where(F.col("path").cast("long") % 10 != 0)
    # ties between neighbours go by number, as in SQL
    pad = lambda df: df.withColumn("path", F.lpad("path", 12, "0"))
    got = C.assign(pad(fresh).select("path", "vector"), pad(old).select("path", "cluster_id"), pad(old).select("path", "vector"))
    return got.select(F.col("path").cast("long").cast("string").alias("path"), "cluster_id")
