"""The link graph as a table (source, target, line, field, ...): links, backlinks, orphans, neighbourhoods, semantic edges and the graphs for display."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import paths
from larkspur.functions import vectors as V

MAX_DEPTH = 3


def build(raw: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Link entries from raw ones (source, target as written, text, line, field, is_wikilink): resolved, body links before relations, one per (source, target, field), no self-links, no empty targets."""
    out = raw.withColumn("target", F.when(F.col("field").isNull(), paths.resolve_link(F.col("source"), F.col("target"))).otherwise(F.col("target")))
    out = out.where("target != '' AND target != source")
    first = Window.partitionBy("source", "target", "field").orderBy("line", "text")
    return out.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def forward(links: DataFrame, files: DataFrame, source: str | None = None) -> DataFrame:
    """Links with the state of their target."""
    out = links if source is None else links.where(F.col("source") == source)
    known = files.select(F.col("path").alias("target"), F.lit(True).alias("known")).distinct()
    return out.join(known, "target", "left").withColumn("state", F.when(F.col("known"), "Valid").otherwise("Broken")).drop("known")


def backlinks(links: DataFrame, target: str | None = None) -> DataFrame:
    out = links if target is None else links.where(F.col("target") == target)
    return out.orderBy("target", "source", "line", "field")


def broken(links: DataFrame, files: DataFrame) -> DataFrame:
    return links.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_anti")


def orphans(files: DataFrame, links: DataFrame) -> DataFrame:
    """Files without links out (broken ones count) or in."""
    out = files.select("path").join(links.select(F.col("source").alias("path")).distinct(), "path", "left_anti")
    return out.join(links.select(F.col("target").alias("path")).distinct(), "path", "left_anti")


def bfs(links: DataFrame, seeds: list[str], depth: int) -> DataFrame:
    """(path, hop): documents within `depth` (at most three) links of the seeds in either direction, seeds left out. One join per hop, and only new documents go on."""
    spark = links.sparkSession
    both = links.select("source", "target").unionByName(links.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    start = spark.createDataFrame([(s,) for s in seeds], "path string")
    seen, frontier = start.withColumn("hop", F.lit(0)), start
    for hop in range(1, min(depth, MAX_DEPTH) + 1):
        frontier = frontier.join(both, frontier.path == both.source).select(F.col("target").alias("path")).distinct().join(seen.select("path"), "path", "left_anti")
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return seen.where("hop > 0")


def linked_from(links: DataFrame, seeds: list[str], targets: DataFrame) -> DataFrame:
    """(path, linked_from): the first seed with a direct link to or from each target."""
    spark = links.sparkSession
    first = spark.createDataFrame([*enumerate(seeds)], "pos int, seed string")
    both = links.select("source", "target").unionByName(links.select(F.col("target").alias("source"), F.col("source").alias("target")))
    met = both.join(first, both.source == first.seed).select(F.col("target").alias("path"), "pos", "seed")
    return targets.join(met, "path").groupBy("path").agg(F.min_by("seed", "pos").alias("linked_from"))


def neighborhood(links: DataFrame, start: str, depth: int = 1, reverse: bool = False) -> DataFrame:
    """(trail, path, hop): all directed trails of one to three links without a repeated document."""
    a, b = ("target", "source") if reverse else ("source", "target")
    step = links.select(F.col(a).alias("at"), F.col(b).alias("next")).distinct()
    now = step.where(F.col("at") == start).select(F.array(F.lit(start), F.col("next")).alias("trail")).where(~F.array_contains(F.array(F.lit(start)), F.element_at("trail", -1)))
    out = now
    for _ in range(1, max(1, min(depth, MAX_DEPTH))):
        now = now.join(step, F.element_at("trail", -1) == F.col("at")).where(~F.array_contains("trail", F.col("next"))).select(F.concat("trail", F.array("next")).alias("trail"))
        out = out.unionByName(now)
    return out.select(F.array_join("trail", ">").alias("trail"), F.element_at("trail", -1).alias("path"), (F.size("trail") - 1).alias("hop"))


def tree_counts(trails: DataFrame) -> DataFrame:
    """Nodes of the tree (repeats count) and its depth."""
    return trails.agg(F.count("*").alias("nodes"), F.coalesce(F.max("hop"), F.lit(0)).alias("depth"))


def contexts(mentions: DataFrame) -> DataFrame:
    """(paragraph, edges): equal paragraphs once, so each is embedded once; edges are the ids that share it."""
    return mentions.groupBy("paragraph").agg(F.array_sort(F.collect_set("edge_id")).alias("edges"))


def strength(edges: DataFrame, edge_vectors: DataFrame, doc_vectors: DataFrame) -> DataFrame:
    """(edge_id, strength): cosine of an edge's context to its target document."""
    return edges.join(edge_vectors, "edge_id").join(doc_vectors.select(F.col("path").alias("target"), F.col("vector").alias("doc")), "target").select("edge_id", V.cosine(F.col("vector"), F.col("doc")).alias("strength"))


def visible(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among the nodes."""
    return edges.join(nodes.select(F.col("path").alias("source")), "source", "left_semi").join(nodes.select(F.col("path").alias("target")), "target", "left_semi")


def with_semantics(links: DataFrame, edges: DataFrame) -> DataFrame:
    """Links with what is known of them as edges; relations have no paragraph, so many have nothing."""
    ids = links.withColumn("edge_id", paths.edge_id(F.col("source"), F.col("target"), F.col("line"), F.col("field")))
    return ids.join(edges.drop("source", "target"), "edge_id", "left")


def document_graph(files: DataFrame, links: DataFrame, edges: DataFrame | None = None, scope: str = "", clusters: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the documents in a scope; clusters: (path, cluster_id)."""
    nodes = files.where(paths.in_scope(F.col("path"), scope)).select("path")
    if clusters is not None:
        nodes = nodes.join(clusters, "path", "left")
    shown = visible(links, nodes)
    return nodes, with_semantics(shown, edges) if edges is not None else shown


def chunk_graph(vectors: DataFrame, k: int = 5, window: int = 20) -> DataFrame:
    """Undirected edges (a, b, weight): of each chunk's k + window nearest, the first k in other documents. vectors: chunk_id, path, vector."""
    from larkspur.operators import neighbors

    ids = vectors.select(F.col("chunk_id").alias("id"), "vector")
    near = neighbors.nearest(ids, ids, k + window, skip_self=True)
    of = vectors.select(F.col("chunk_id").alias("id"), F.col("path").alias("path"))
    rows = near.join(of, "id").join(of.select(F.col("id").alias("query"), F.col("path").alias("own")), "query").where("path != own")
    first = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    rows = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    return rows.groupBy(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b")).agg(F.max("score").alias("weight"))


def interned(edges: DataFrame, column: str = "context") -> tuple[DataFrame, DataFrame]:
    """(edges with context_index, contexts): each distinct context stored once, numbered by first appearance."""
    first = edges.where(F.col(column).isNotNull()).groupBy(column).agg(F.min("edge_id").alias("first"))
    numbered = first.withColumn("context_index", F.row_number().over(Window.orderBy("first", column)) - 1).drop("first")
    return edges.join(numbered, column, "left").drop(column), numbered


def file_tree(files: DataFrame) -> DataFrame:
    """(path, name, depth, is_dir, files): every folder and file, with the files below; folders first, then by name."""
    parts = F.split("path", "/", -1)
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), (i < F.size(parts)).alias("is_dir"), i.alias("depth")))
    rows = files.select(F.explode(every).alias("n")).groupBy("n.path", "n.is_dir", "n.depth").agg(F.count("*").alias("files"))
    return rows.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "depth", "is_dir", "files").orderBy(F.desc("is_dir"), "path")
