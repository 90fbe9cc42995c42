"""Checks of an index, as a table of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXAMPLES = 5


def dangling_relations(related: DataFrame) -> DataFrame:
    """(field, dangling, examples): relations whose document is missing, with up to five of them."""
    bad = related.where("NOT exists").select("field", F.concat_ws(" -> ", "source", "target").alias("example"))
    few = bad.distinct().withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy("example"))).where(F.col("r") <= EXAMPLES)
    listed = few.groupBy("field").agg(F.array_join(F.array_sort(F.collect_list("example")), "; ").alias("examples"))
    return bad.groupBy("field").agg(F.count("*").alias("dangling")).join(listed, "field").orderBy("field")


def missing_folders(files: DataFrame, folders: list[str]) -> DataFrame:
    """Declared relation folders without any document."""
    spark = files.sparkSession
    wanted = spark.createDataFrame([(f.rstrip("/"),) for f in folders], "folder string")
    parts = F.split("path", "/", -1)
    there = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("folder")).distinct()
    return wanted.join(there, "folder", "left_anti")


def report(files: DataFrame, chunks: DataFrame, vectors: DataFrame, related: DataFrame, links: DataFrame, folders: list[str] | None = None) -> DataFrame:
    """(check, findings, ok). folders: where declared relations lead, if they are to be checked."""
    checks = {
        "files_without_chunks": files.select("path").join(chunks.select("path").distinct(), "path", "left_anti"),
        "chunks_without_vector": chunks.select("chunk_id").join(vectors.select("chunk_id"), "chunk_id", "left_anti"),
        "vectors_without_chunk": vectors.select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_anti"),
        "bad_metadata": files.where("metadata IS NOT NULL AND try_parse_json(metadata) IS NULL").select("path"),
        "dangling_relations": related.where("NOT exists").select("source"),
        "broken_links": links.join(files.select(F.col("path").alias("target")), "target", "left_anti").select("source"),
        "vector_sizes": vectors.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count")).offset(1).select("n"),
    }
    if folders is not None:
        checks["missing_folders"] = missing_folders(files, folders)
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("findings")).select(F.lit(name).alias("check"), "findings", (F.col("findings") == 0).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out
