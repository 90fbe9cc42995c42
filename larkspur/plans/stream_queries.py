"""Streams, and what Spark adds for free over the star schema (extras; the rest of the engine doesn't use them)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur import scratch
from larkspur.functions import text as X
from larkspur.functions import vectors as V
from larkspur.plans import tables as T
from larkspur.plans.registry import query
from larkspur.sources.vault import Store
from larkspur.streaming import watch


@query("""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || 'x' ELSE text END AS t FROM documents WHERE doc_id % 7 != 0)
SELECT doc_id || '.md' AS path, sha256(t) AS content_hash, regexp_matches(t, '\\S') AS chunked, true AS current FROM f""")
def incremental_upsert(spark, d):
    """The final state after a stream of creations, then changes to every third document and deletions of every seventh, twice over: files, whether they have chunks, and whether the vectors of all these, their terms' lengths and no others are stored."""
    base = scratch.fresh(spark, "watch")
    docs = T.table(spark, d, "documents").select("doc_id", "text")
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
    none = F.lit(None).cast("string")
    created = docs.select(path.alias("path"), F.lit("created").alias("kind"), F.timestamp_seconds(F.lit(1)).alias("ts"), F.col("text").alias("content"), none.alias("new_path"))
    later = docs.where("doc_id % 3 = 0 OR doc_id % 7 = 0").select(path.alias("path"), F.when(F.col("doc_id") % 7 == 0, "deleted").otherwise("modified").alias("kind"), F.timestamp_seconds(F.lit(2)).alias("ts"), F.when(F.col("doc_id") % 7 != 0, F.concat("text", F.lit("x"))).alias("content"), none.alias("new_path"))
    store = Store(spark, f"{base}/store")
    for batch in (created, later, later):
        batch.write.mode("append").parquet(f"{base}/events")
        stream = spark.readStream.schema(batch.schema).parquet(f"{base}/events")
        watch.watch(stream, store, f"{base}/progress", interval=None).awaitTermination()
    chunks, vectors = store.read("chunks"), store.read("vectors")
    terms = store.read("terms").where("term = '' AND field = 'c'").select("chunk_id", "length")
    words = F.size(X.tokens(X.plain(F.col("content"))))
    both = chunks.select("chunk_id", "path", "content").join(vectors.select("chunk_id", "vector"), "chunk_id", "full").join(terms, "chunk_id", "full")
    good = F.coalesce((F.col("vector") == V.mock_embedding(F.col("content"), 64).cast("array<float>")) & (F.col("length") == words), F.lit(False))
    state = both.groupBy("path").agg(F.bool_and(good).alias("current"), F.lit(True).alias("chunked"))
    out = store.read("files").select("path", "content_hash").join(state, "path", "full")
    return out.select("path", "content_hash", F.coalesce("chunked", F.lit(False)).alias("chunked"), F.coalesce("current", F.lit(True)).alias("current"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windows_tumbling(spark, d):
    return watch.windowed_counts(T.table(spark, d, "events"), by="event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL 10 minutes, ts) - to_minutes(10 * k) AS start, event_type, count(*) AS n FROM events, range(0, 3) t(k) GROUP BY ALL")
def windows_sliding(spark, d):
    return watch.windowed_counts(T.table(spark, d, "events"), "30 minutes", "10 minutes", by="event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS first FROM events), s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minutes AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def windows_session(spark, d):
    s = watch.sessions(T.table(spark, d, "events"))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def star_join(spark, d):
    o, c, n = (T.table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def star_semi(spark, d):
    return T.table(spark, d, "customer").join(T.table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def star_anti(spark, d):
    return T.table(spark, d, "part").join(T.table(spark, d, "lineitem").where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("SELECT s_suppkey, count(l_orderkey) AS lines FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey AND l_returnflag = 'R' GROUP BY s_suppkey")
def star_left(spark, d):
    li = T.table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return T.table(spark, d, "supplier").join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left").groupBy("s_suppkey").agg(F.count("l_orderkey").alias("lines"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def star_rollup(spark, d):
    return T.table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def star_cube(spark, d):
    return T.table(spark, d, "documents").cube("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS third FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
def window_ranks(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return T.table(spark, d, "orders").select("o_custkey", "o_orderkey", *(f().over(w).cast("long").alias(n) for f, n in ((F.rank, "r"), (F.dense_rank, "dr"), (lambda: F.ntile(3), "third"))))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last3, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def window_frames(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return T.table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("last3"), F.lag("event_id").over(w).alias("before"))


@query("SELECT kind, k FROM (SELECT 'union' AS kind, * FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'both', * FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only', * FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier))")
def set_operations(spark, d):
    a, b = T.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), T.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    named = lambda df, n: df.select(F.lit(n).alias("kind"), "k")
    return named(a.union(b).distinct(), "union").union(named(a.intersect(b), "both")).union(named(a.subtract(b), "only"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def distinct_exact(spark, d):
    return T.table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("SELECT event_type, true AS close FROM events GROUP BY event_type")
def distinct_error(spark, d):
    """The approximate count is within 6 %, three standard deviations of 2 %, of the exact one."""
    # each user once per type before both counts: beside a distinct count the sketch would be kept for every pair of type and user, at 3 KB each
    once = T.table(spark, d, "events").select("event_type", "user_id").distinct()
    both = once.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count("user_id").alias("n"))
    return both.select("event_type", (F.abs(F.col("a") - F.col("n")) <= 0.06 * F.col("n")).alias("close"))


@query()
def distinct_approximate(spark, d):
    return T.table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))
