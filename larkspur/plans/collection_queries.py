"""Queries over documents as a table, their schema, ingest and upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import paths, text, vectors
from larkspur.functions import predicates as P
from larkspur.operators import collection, doctor, graph, ingest, shards
from larkspur.operators import schema as S
from larkspur.plans import tables as T
from larkspur.plans.graph_queries import star_files
from larkspur.plans.registry import query
from larkspur.sources import markdown
from larkspur.streaming import watch

_F = T.FILES


def _page(spark, d, **kw):
    q = collection.Query(**kw)
    return collection.page(collection.rows(T.files(spark, d), q), q)


@query(f"WITH {_F} SELECT path, n_chars FROM files WHERE path LIKE 'en/src1/%' AND quality = 1 ORDER BY n_chars DESC, path LIMIT 20 OFFSET 3")
def collection_page(spark, d):
    got = _page(spark, d, path="en/src1", filters=(P.Equals("quality", 1),), sort="n_chars", descending=True, limit=20, offset=3)
    return got.select("path", F.get_json_object("metadata", "$.n_chars").cast("long").alias("n_chars"))


@query(f"WITH {_F} SELECT count(*) AS total FROM files WHERE path LIKE 'en/%' AND toxic = 0")
def collection_total(spark, d):
    q = collection.Query(path="en", recursive=True, filters=(P.Equals("toxic", 0),))
    return collection.rows(T.files(spark, d), q).agg(F.count("*").alias("total"))


@query(f"WITH {_F}, r AS (SELECT * FROM files WHERE path LIKE 'fr/%') SELECT * FROM (SELECT 'lang' AS name, true AS in_schema, count(lang) AS present FROM r UNION ALL SELECT 'source', true, count(source) FROM r UNION ALL SELECT 'n_chars', true, count(n_chars) FROM r UNION ALL SELECT 'quality', true, count(quality) FROM r UNION ALL SELECT 'toxic', true, count(toxic) FROM r)")
def collection_columns(spark, d):
    files = T.files(spark, d)
    found = collection.rows(files, collection.Query(path="fr", recursive=True))
    return collection.columns(found, S.infer(files))


@query(f"""WITH {_F}, e AS (SELECT 'lang' AS name, lang AS v FROM files UNION ALL SELECT 'source', source FROM files UNION ALL SELECT 'n_chars', n_chars::VARCHAR FROM files UNION ALL SELECT 'quality', quality::VARCHAR FROM files UNION ALL SELECT 'toxic', toxic::VARCHAR FROM files)
SELECT name, CASE WHEN name IN ('lang', 'source') THEN 'String' ELSE 'Number' END AS field_type, count(v) AS occurrences, array_to_string(list_sort(list(DISTINCT v))[1:20], ',') AS samples FROM e WHERE v IS NOT NULL GROUP BY name""")
def schema_infer(spark, d):
    return S.infer(T.files(spark, d)).withColumn("samples", F.array_join("samples", ","))


@query(f"""WITH {_F}, e AS (SELECT lang AS scope, unnest(['lang', 'source', 'n_chars', 'quality', 'toxic']) AS name, unnest([lang, source, n_chars::VARCHAR, quality::VARCHAR, toxic::VARCHAR]) AS v FROM files)
SELECT scope, name, CASE WHEN name IN ('lang', 'source') THEN 'String' ELSE 'Number' END AS field_type, count(v) AS occurrences FROM e WHERE v IS NOT NULL GROUP BY scope, name""")
def schema_scoped(spark, d):
    return S.infer_scoped(T.files(spark, d))


@query("""WITH d AS (SELECT count(*) AS n, (SELECT count(*) FROM labels JOIN documents USING (doc_id)) AS l FROM documents)
SELECT * FROM (SELECT 'lang' AS name, 'String' AS field_type, n AS occurrences, 'Language' AS description, true AS required FROM d UNION ALL SELECT 'source', 'Relation', n, NULL, false FROM d UNION ALL SELECT 'n_chars', 'Number', n, NULL, false FROM d
UNION ALL SELECT 'quality', 'Boolean', l, 'inner', false FROM d UNION ALL SELECT 'toxic', 'Number', l, NULL, false FROM d UNION ALL SELECT 'reviewer', 'String', 0, NULL, true FROM d)""")
def schema_overlay_merge(spark, d):
    declared = [S.Field("lang", description="Language", required=True), S.Field("source", field_type="Relation"), S.Field("quality", field_type="Number", description="outer"), S.Field("quality", scope="en", field_type="Boolean", description="inner"), S.Field("reviewer", required=True), S.Field("elsewhere", scope="fr")]
    return S.merge(spark, S.infer(T.files(spark, d)), S.resolve(declared, "en/src1/1.md")).select("name", "field_type", "occurrences", "description", "required")


@query(f"WITH {_F} SELECT path, quality, row_number() OVER (ORDER BY quality IS NULL, quality DESC, path) AS pos FROM files QUALIFY pos <= 500")
def sort_nulls_last_desc(spark, d):
    from pyspark.sql import Window

    got = _page(spark, d, recursive=True, sort="quality", descending=True, limit=500).select("path", F.get_json_object("metadata", "$.quality").cast("int").alias("quality"))
    order = Window.orderBy(F.col("quality").isNull(), F.desc("quality"), "path")
    return got.withColumn("pos", F.row_number().over(order).cast("long"))


@query("SELECT count(*) FILTER (doc_id % 10 = 0) AS \"new\", count(*) FILTER (doc_id % 10 = 1) AS reembed, count(*) FILTER (doc_id % 10 = 2) AS metadata, count(*) FILTER (doc_id % 10 > 2) AS \"unchanged\", 3::BIGINT AS deleted FROM documents")
def info_counts(spark, d):
    by = _changes(spark, d).agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("new", "reembed", "metadata", "unchanged", "deleted")))
    return by


def _changes(spark, d):
    docs = T.documents(spark, d).select("path", "doc_id", F.sha2("text", 256).alias("content_hash"), F.sha2("text", 256).alias("body_hash"))
    last = F.col("doc_id") % 10
    old = docs.where(last != 0).select("path", F.when(last.isin(1, 2), "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(last == 1, "old").otherwise(F.col("body_hash")).alias("body_hash"))
    gone = spark.createDataFrame([(f"gone/{i}.md", "x", "x") for i in range(3)], "path string, content_hash string, body_hash string")
    return ingest.changes(docs, old.unionByName(gone))


@query(f"WITH {_F} SELECT path, CASE doc_id % 10 WHEN 0 THEN 'new' WHEN 1 THEN 'reembed' WHEN 2 THEN 'metadata' ELSE 'unchanged' END AS change FROM files UNION ALL SELECT 'gone/' || i || '.md', 'deleted' FROM range(3) t(i)")
def change_detection(spark, d):
    return _changes(spark, d)


@query(f"WITH {_F} SELECT state, count(*) AS files FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'new' WHEN doc_id % 10 IN (1, 2) THEN 'modified' ELSE 'indexed' END AS state FROM files UNION ALL SELECT 'deleted' FROM range(2)) GROUP BY state")
def disk_states(spark, d):
    docs = T.documents(spark, d).select("path", "doc_id", F.sha2("text", 256).alias("content_hash"))
    known = docs.where("doc_id % 10 != 0").select("path", F.when(F.col("doc_id") % 10 <= 2, "old").otherwise(F.col("content_hash")).alias("content_hash"))
    gone = spark.createDataFrame([("x/1.md", "h"), ("x/2.md", "h")], "path string, content_hash string")
    return collection.state_counts(collection.states(docs.drop("doc_id"), known.unionByName(gone)))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, d):
    return T.table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("""WITH t AS (SELECT doc_id, n FROM (SELECT doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n FROM documents)), k AS (SELECT doc_id, n, unnest(range(0, greatest(n, 1), 462)) AS start FROM t WHERE n > 512),
kept AS (SELECT doc_id, n, start FROM k WHERE start = 0 OR start - 462 + 512 < n)
SELECT doc_id, (start // 462)::INT AS idx, start::INT AS first_token, least(start + 512, n)::INT AS last_token FROM kept UNION ALL SELECT doc_id, 0, 0, n::INT FROM t WHERE n BETWEEN 1 AND 512""")
def chunk_windows(spark, d):
    """Windows of 512 tokens that share 50; tokens are words here."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    docs = T.table(spark, d, "documents").select("doc_id", n.alias("n")).where("n > 0")
    starts = F.filter(F.sequence(F.lit(0), F.col("n") - 1, F.lit(462)), lambda s: (s == 0) | (s - 462 + 512 < F.col("n")))
    return docs.select("doc_id", "n", F.posexplode(starts).alias("idx", "first_token")).select("doc_id", "idx", "first_token", F.least(F.col("first_token") + 512, F.col("n")).alias("last_token"))


@query("SELECT vec_id AS chunk_id FROM embeddings JOIN documents ON vec_id = doc_id")
def stale_removal(spark, d):
    return ingest.remove_stale(T.vectors(spark, d).select("chunk_id"), T.table(spark, d, "documents").select(F.col("doc_id").alias("path")), "chunk_id")


@query("SELECT item_id, round(list_sum(v), 6) AS total, round(v[1], 6) AS head, len(v)::INT AS n FROM (SELECT item_id, list_transform(range(0, 40), lambda i: ('0x' || substr(sha256(text), 1 + 2 * (i % 32), 2))::INT / 255.0::DOUBLE) AS v FROM benchmark)")
def mock_embedding(spark, d):
    v = T.table(spark, d, "benchmark").select("item_id", vectors.mock_embedding(F.col("text"), 40).alias("v"))
    return v.select("item_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get("v", F.lit(0)), 6).alias("head"), F.size("v").alias("n"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_event_per_path(spark, d):
    ev = T.table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e"))
    return ev.select("user_id", "e.event_id", "e.event_type")


@query(f"WITH {_F}, s AS (SELECT * FROM (VALUES ('english', 'en'), ('first', 'en/src1'), ('none', 'xx')) t(shard, scope)) SELECT shard, count(path) AS files FROM s LEFT JOIN files ON path = scope OR starts_with(path, scope || '/') GROUP BY shard")
def shard_scope_counts(spark, d):
    known = shards.Shards()
    for name, path in (("english", "en"), ("first", "en/src1"), ("none", "xx")):
        known.add(name, path)
    return shards.counts(T.documents(spark, d), known.table(spark))


@query("WITH o AS (SELECT o_orderkey, o_custkey FROM orders) SELECT 'client' AS field, count(*) AS dangling FROM o WHERE o_custkey % 7 = 0")
def doctor_dangling_relations(spark, d):
    files = star_files(spark, d)
    key = F.regexp_extract("path", r"^customer/(\d+)\.md$", 1)
    some = files.where(F.when(key != "", key.cast("long") % 7 != 0).otherwise(True))
    return doctor.dangling_relations(collection.relations(some)).select("field", "dangling")


@query(f"""WITH {_F}, {T.LINKS} SELECT * FROM (SELECT 'files_without_chunks' AS "check", 0::BIGINT AS findings UNION ALL SELECT 'chunks_without_vector', count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 'vectors_without_chunk', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'bad_metadata', 0 UNION ALL SELECT 'dangling_relations', 0 UNION ALL SELECT 'broken_links', count(*) FROM links WHERE target NOT IN (SELECT path FROM files) UNION ALL SELECT 'vector_sizes', 0)""")
def doctor_report(spark, d):
    ix = T.index(spark, d)
    return doctor.report(ix.files, ix.chunks, ix.vectors, collection.relations(ix.files), ix.links).select("check", "findings")


@query(f"WITH {_F}, {T.LINKS} SELECT 'from ' || source AS paragraph, count(*) AS edges FROM links GROUP BY source")
def dedupe_paragraph_contexts(spark, d):
    edges = T.index(spark, d).edges.select("edge_id", F.col("context").alias("paragraph"))
    return graph.contexts(edges).select("paragraph", F.size("edges").cast("long").alias("edges"))


@query(f"WITH {_F}, {T.LINKS} SELECT (SELECT count(*) FROM files WHERE lang = 'en') AS files, (SELECT count(*) FROM files WHERE lang = 'en') AS chunks, (SELECT count(*) FROM files JOIN embeddings ON vec_id = doc_id WHERE lang = 'en') AS vectors, (SELECT count(*) FROM links WHERE source LIKE 'en/%') AS links")
def status_scoped(spark, d):
    ix = T.index(spark, d)
    v = ix.vectors.join(ix.chunks.select("chunk_id", "path"), "chunk_id")
    return ingest.status({"files": ix.files, "chunks": ix.chunks, "vectors": v, "links": ix.links}, "en")




@query("""WITH o AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 2 = 0) AS even FROM orders)
SELECT * FROM (SELECT 'client' AS name, 'Relation' AS field_type, n AS occurrences FROM o UNION ALL SELECT 'urgent', 'Boolean', n FROM o UNION ALL SELECT 'placed', 'Date', n FROM o UNION ALL SELECT 'total', 'Number', n FROM o UNION ALL SELECT 'status', 'String', n FROM o
UNION ALL SELECT 'tags', 'List', n FROM o UNION ALL SELECT 'scan', 'File', n FROM o UNION ALL SELECT 'mixed', 'Mixed', n FROM o UNION ALL SELECT 'either', 'Mixed', n FROM o UNION ALL SELECT 'nested', 'Json', even FROM o)""")
def schema_infer_kinds(spark, d):
    o = T.dealt(T.table(spark, d, "orders"), "o_orderkey")
    link = F.concat(F.lit("[[customer/"), F.col("o_custkey").cast("string"), F.lit("]]"))
    meta = F.struct(
        link.alias("client"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("placed"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"),
        F.array("o_orderstatus", "o_orderpriority").alias("tags"), F.lit("[scan](scans/a.pdf)").alias("scan"), F.array(link, F.lit("[[a.png]]")).alias("mixed"), F.when(F.col("o_orderkey") % 2 == 0, F.struct("o_custkey")).alias("nested"),
    )
    plain = F.to_json(meta)
    # one field is a number in even orders and text in odd ones
    either = F.when(F.col("o_orderkey") % 2 == 0, '"either":1,').otherwise('"either":"x",')
    rows = o.select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("{"), either, F.substr(plain, F.lit(2))).alias("metadata"))
    return S.infer(rows).select("name", "field_type", "occurrences")


_PART = """p AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_size AS size, 'parts/' || p_partkey || '.md' AS path FROM part)"""


def _parts(spark, d):
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.concat(F.lit("parts/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), "p_retailprice")


@query(f"WITH {_PART} SELECT path, CASE WHEN size % 3 = 0 THEN k::VARCHAR WHEN size % 3 = 1 THEN name ELSE k::VARCHAR END AS title, CASE WHEN size % 3 = 1 THEN 'title' ELSE 'stem' END AS title_source FROM p")
def title_derivation(spark, d):
    third = F.col("size") % 3
    meta = F.when(third == 0, F.to_json(F.struct("size"))).when(third == 1, F.to_json(F.struct(F.col("name").alias("title")))).otherwise('{"title":"  "}')
    return collection.rows(_parts(spark, d).select("path", meta.alias("metadata")), collection.Query(recursive=True)).select("path", "title", "title_source")


@query(f"WITH {_PART}, v AS (SELECT path, k, size, CASE WHEN k % 5 < 3 THEN ((k * 7919) % 1000 - 500) / 100.0 END AS num, CASE WHEN k % 5 = 3 THEN brand END AS txt FROM p) SELECT path FROM v ORDER BY num IS NULL AND txt IS NULL, txt IS NOT NULL, num, txt, path LIMIT 150 OFFSET 20")
def sort_exact_decimals(spark, d):
    """Numbers by value, then text, then nothing."""
    number = ((F.col("k") * 7919 % 1000 - 500) / 100).cast("decimal(6,2)")
    fifth = F.col("k") % 5
    meta = F.when(fifth < 3, F.concat(F.lit('{"v":'), number.cast("string"), F.lit("}"))).when(fifth == 3, F.to_json(F.struct(F.col("brand").alias("v")))).otherwise('{"v":null}')
    q = collection.Query(sort="v", recursive=True, limit=150, offset=20)
    return collection.page(collection.rows(_parts(spark, d).select("path", meta.alias("metadata")), q), q).select("path")


def _notes(spark, d):
    """A note for each part: front matter with a link, two headings, a wikilink and a Markdown link, and some of each in code."""
    lines = ["---", 'title: "{name}"', "size: {size}", 'maker: "[[brand/{size}|{brand}]]"', "---", "intro [[part/{k}|next]]", "", "# {name}", "", "see [type](types/{size}.md#t) and ![picture](p.png)", "", "## Price", "cheap", "```", "[[not/a]] # link", "```", ""]
    text = F.lit("\n".join(lines))
    for name in ("name", "size", "brand", "k"):
        text = F.replace(text, F.lit(f"{{{name}}}"), F.col(name).cast("string"))
    return markdown.parse(T.dealt(_parts(spark, d), "k").select("path", text.cast("binary").alias("content"), F.lit(1).cast("long").alias("modified_at")))


@query(f"WITH {_PART} SELECT path || '#0' AS chunk_id, '' AS trail, 1 AS start_line, 2 AS end_line FROM p UNION ALL SELECT path || '#1', name, 3, 6 FROM p UNION ALL SELECT path || '#2', name || ' > Price', 7, 11 FROM p")
def heading_sections(spark, d):
    return markdown.chunks(_notes(spark, d)).select("chunk_id", F.array_join("trail", " > ").alias("trail"), "start_line", "end_line")


@query(f"WITH {_PART} SELECT path AS source, 'part/' || k AS target, 'next' AS text, 1 AS line FROM p UNION ALL SELECT path, 'not/a', 'not/a', 10 FROM p")
def wikilinks(spark, d):
    """Those in code count too."""
    return markdown.links(_notes(spark, d)).where("is_wikilink AND field IS NULL").select("source", "target", "text", "line")


@query(f"WITH {_PART} SELECT path AS source, 'types/' || size || '.md#t' AS target, 'type' AS text, 5 AS line FROM p")
def md_links(spark, d):
    return markdown.links(_notes(spark, d)).where("NOT is_wikilink AND field IS NULL").select("source", "target", "text", "line")


@query(f"WITH {_PART} SELECT path AS source, 'maker' AS field, 'brand/' || size AS target, brand AS text FROM p")
def front_matter_links(spark, d):
    return markdown.links(_notes(spark, d)).where("field IS NOT NULL").select("source", "field", "target", "text")


@query(f"""WITH {_PART} SELECT path, '{{"title":"' || name || '","size":' || size || ',"maker":"[[brand/' || size || '|' || brand || ']]"}}' AS metadata FROM p""")
def front_matter_split(spark, d):
    return _notes(spark, d).select("path", "metadata")


@query("""WITH e AS (SELECT event_id, ts, 'u/' || user_id || '.md' AS path, 'm/' || event_id % 50 || '.md' AS moved, event_type AS t FROM events),
r AS (SELECT path, CASE WHEN t IN ('error', 'view') THEN 'deleted' WHEN t = 'signup' THEN 'created' ELSE 'modified' END AS kind, ts, CASE WHEN t IN ('error', 'view') THEN NULL ELSE event_id::VARCHAR END AS content FROM e UNION ALL SELECT moved, 'created', ts, event_id::VARCHAR FROM e WHERE t = 'view')
SELECT path, kind, content FROM r QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, kind = 'deleted', content DESC NULLS LAST) = 1""")
def debounced_events(spark, d):
    """Events of users as events of files: errors delete, views move, the rest write."""
    t = F.col("event_type")
    kind = F.when(t == "error", "deleted").when(t == "view", "renamed").when(t == "signup", "created").otherwise("modified")
    ev = T.table(spark, d, "events").select(
        F.concat(F.lit("u/"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.when(t != "error", F.col("event_id").cast("string")).alias("content"),
        F.when(t == "view", F.concat(F.lit("m/"), (F.col("event_id") % 50).cast("string"), F.lit(".md"))).alias("new_path"),
    )
    return watch.debounced(watch.classify(ev)).select("path", "kind", "content")


@query(f"WITH {_F} SELECT scope, count(path) AS files FROM (SELECT unnest(['en', 'en/', './en/src1', '.', 'e']) AS scope, unnest(['en/%', 'en/%', 'en/src1/%', '%', 'e/%']) AS pattern) LEFT JOIN files ON path LIKE pattern GROUP BY scope")
def scope_segments(spark, d):
    files, out = T.documents(spark, d), None
    for s in ("en", "en/", "./en/src1", ".", "e"):
        one = files.where(paths.in_scope(F.col("path"), s)).agg(F.count("*").alias("files")).select(F.lit(s).alias("scope"), "files")
        out = one if out is None else out.unionByName(one)
    return out
