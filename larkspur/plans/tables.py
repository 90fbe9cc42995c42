"""The engine's tables made from the driver's: documents as files with JSON metadata, embeddings as vectors, reading links between documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.search import Index

NOW = 1_700_000_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table whose files give fewer partitions than there are cores, dealt to all of them, for work that costs far more than a shuffle of so little; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """A table of few bytes a row, dealt by key to four tasks a core, for work that costs far more than a shuffle: its files may hold millions of rows in one row group, which one task reads."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def pieces(df: DataFrame, key: str, size: int = 16 << 20) -> DataFrame:
    """A table in parts by key, as many as its files hold times `size` bytes, for work whose rows outgrow its input."""
    n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // size
    return df.repartition(n + 1, key) if n >= df.sparkSession.sparkContext.defaultParallelism else df


def path_of(doc_id: Column, lang: Column, source: Column) -> Column:
    return F.concat_ws("/", lang, source, F.concat(doc_id.cast("string"), F.lit(".md")))


def documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, path, lang, source, n_chars, text."""
    return spread(table(spark, d, "documents")).select("doc_id", path_of(F.col("doc_id"), F.col("lang"), F.col("source")).alias("path"), "lang", "source", "n_chars", "text")


def files(spark: SparkSession, d: str) -> DataFrame:
    """path, doc_id, metadata, modified_at, indexed_at: metadata has lang, source, n_chars and, where labelled, quality and toxic; every fifth document has no modification time."""
    docs = documents(spark, d).drop("text").join(table(spark, d, "labels"), "doc_id", "left")
    meta = F.to_json(F.struct("lang", "source", "n_chars", "quality", "toxic"))
    indexed = F.lit(NOW) - F.col("doc_id") * 3600
    return docs.select("path", "doc_id", meta.alias("metadata"), F.when(F.col("doc_id") % 5 != 0, indexed - 86400).alias("modified_at"), indexed.alias("indexed_at"))


def links(spark: SparkSession, d: str) -> DataFrame:
    """source, target, line, field: each document links to the next and to three times its number and one; targets that don't exist lie in missing/."""
    docs = documents(spark, d).select("doc_id", "path")
    raw = docs.select(F.col("path").alias("source"), F.posexplode(F.array(F.col("doc_id") + 1, F.col("doc_id") * 3 + 1)).alias("pos", "to"))
    known = docs.select(F.col("doc_id").alias("to"), F.col("path").alias("there"))
    target = F.coalesce("there", F.concat(F.lit("missing/"), F.col("to").cast("string"), F.lit(".md")))
    rows = raw.join(known, "to", "left").select("source", target.alias("target"), (F.col("pos") + 1).cast("long").alias("line"))
    return rows.where("source != target").groupBy("source", "target").agg(F.min("line").alias("line")).withColumn("field", F.lit(None).cast("string"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    """One embedding, by its id."""
    row = table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").head()
    return list(row[0]) if row else [1.0]


def index(spark: SparkSession, d: str) -> Index:
    docs = documents(spark, d)
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "path", F.col("text").alias("content"), F.lit(0).alias("n"))
    edges = links(spark, d).select(F.concat(F.lit("edge:"), "source", F.lit("->"), "target", F.lit("@"), F.col("line").cast("string")).alias("edge_id"), "source", "target", "line", F.concat(F.lit("from "), "source").alias("context"))
    return Index(chunks, vectors(spark, d), files(spark, d), links(spark, d), edges, edge_vectors(spark, d))


def edge_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A vector for each link of a document that has an embedding: that of the document it comes from, turned by one place for its second link."""
    docs = documents(spark, d).select("doc_id", F.col("path").alias("source"))
    own = links(spark, d).join(docs, "source").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    turned = F.when(F.col("line") == 1, F.col("embedding")).otherwise(F.concat(F.slice("embedding", 2, F.size("embedding") - 1), F.slice("embedding", 1, 1)))
    return own.select(F.concat(F.lit("edge:"), "source", F.lit("->"), "target", F.lit("@"), F.col("line").cast("string")).alias("edge_id"), turned.alias("vector"))


#: The same tables in SQL, to be put after WITH.
FILES = "files AS (SELECT d.doc_id, d.lang || '/' || d.source || '/' || d.doc_id || '.md' AS path, d.lang, d.source, d.n_chars, d.text, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
LINKS = """links AS (SELECT a.source, coalesce(b.path, 'missing/' || a.t || '.md') AS target, min(a.line)::BIGINT AS line
  FROM (SELECT path AS source, doc_id + 1 AS t, 1 AS line FROM files UNION ALL SELECT path, doc_id * 3 + 1, 2 FROM files) a
  LEFT JOIN files b ON b.doc_id = a.t WHERE a.source != coalesce(b.path, 'missing/' || a.t || '.md') GROUP BY ALL)"""
VECS = "vecs AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def cosine(a: str, b: str) -> str:
    return f"coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 0)"


def bm25(words: list[str]) -> str:
    """CTEs toks and lex (doc_id, bm25)."""
    parts = " + ".join(
        f"(SELECT ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) FROM stats) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len / (SELECT a FROM stats)))" for i in range(len(words))
    )
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS t{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (t{i} > 0) AS df{i}" for i in range(len(words)))
    return f"""toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents),
tf AS (SELECT doc_id, len(t) AS len, {tf} FROM toks), stats AS (SELECT count(*) AS n, avg(len) AS a, {df} FROM tf),
lex AS (SELECT doc_id, {parts} AS bm25 FROM tf WHERE {' OR '.join(f't{i} > 0' for i in range(len(words)))})"""
