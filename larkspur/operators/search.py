"""Search: semantic, lexical, hybrid by reciprocal ranks, and over edges; with filters, scope, decay, link boost and expansion over the link graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import paths, predicates
from larkspur.functions import vectors as V
from larkspur.operators import graph, lexical

RRF_K, HALF_LIFE_DAYS, BOOST, SEEDS = 60, 90.0, 0.15, 3
#: Rows of a top-k that the driver may hold.
HELD = 10_000


@dataclass(frozen=True)
class Query:
    text: str = ""
    vector: tuple[float, ...] = ()
    mode: str = "hybrid"
    limit: int = 10
    min_score: float | None = None
    filters: tuple = ()
    scope: str = ""
    half_life: float | None = None
    now: int | None = None
    decay_include: tuple[str, ...] = ()
    decay_exclude: tuple[str, ...] = ()
    boost_links: bool = False
    boost_weight: float = BOOST
    boost_hops: int = 1
    reference_window: bool = False
    stemmed: bool = False


@dataclass(frozen=True)
class Index:
    """chunks (chunk_id, path, content, headings, n), vectors (chunk_id, vector), files (path, metadata, modified_at, indexed_at), links (source, target), edges (edge_id, source, target, ...), edge_vectors (edge_id, vector)."""

    chunks: DataFrame
    vectors: DataFrame | None = None
    files: DataFrame | None = None
    links: DataFrame | None = None
    edges: DataFrame | None = None
    edge_vectors: DataFrame | None = None
    #: lexical.terms(chunks) as stored; without it texts are read.
    terms: DataFrame | None = None


def top_k(scored: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best; ties go by key. One pass, k rows per task."""
    return scored.orderBy(F.desc(score), key).limit(k)


def semantic(vectors: DataFrame, query: list[float], key: str = "chunk_id", column: str = "vector") -> DataFrame:
    """(key, score): cosine of every vector to the query."""
    return vectors.select(key, V.cosine_to(F.col(column), list(query)).alias("score"))


def ranked(scored: DataFrame, score: str, key: str, k: int, name: str) -> DataFrame:
    """The k best with their ranks from 1. The window only sees the k rows of a top-k."""
    return top_k(scored, score, key, k).withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), key)).cast("long"))


def held(df: DataFrame, most: int) -> DataFrame:
    """A result of at most `most` rows, worked out once and kept as literal rows; left as a plan if it may be large."""
    if most > HELD:
        return df
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def fuse(lists: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """(key, score): reciprocal-rank fusion, 1 for a row that leads all lists. Each list: key and rank."""
    both = None
    for one in lists:
        part = one.select(key, (1.0 / (k + F.col("rank"))).alias("part"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy(key).agg((F.sum("part") / F.lit(len(lists) / (k + 1))).alias("score"))


def decayed(score: Column, modified: Column, now: int, half_life: float = HALF_LIFE_DAYS) -> Column:
    age = F.greatest(F.lit(now) - modified, F.lit(0)) / 86400.0
    return score * F.pow(F.lit(0.5), age / half_life)


def decays(path: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """Exclusion beats inclusion; no inclusion means all."""
    return ~paths.in_any_scope(path, list(exclude)) & (paths.in_any_scope(path, list(include)) if include else F.lit(True))


def assemble(scored: DataFrame, index: Index, q: Query) -> DataFrame:
    """Rows of candidates with their chunk and file, in the order scope, decay, minimum score, metadata."""
    rows = scored.join(index.chunks, "chunk_id")
    if q.scope:
        rows = rows.where(paths.in_scope(F.col("path"), q.scope))
    if index.files is not None:
        rows = rows.join(index.files, "path")
        if q.half_life:
            when = F.coalesce(F.col("modified_at"), F.col("indexed_at"))
            late = decays(F.col("path"), q.decay_include, q.decay_exclude)
            rows = rows.withColumn("score", F.when(late, decayed(F.col("score"), when, q.now or 0, q.half_life)).otherwise(F.col("score")))
    if q.min_score is not None:
        rows = rows.where(F.col("score") >= q.min_score)
    if q.filters:
        rows = rows.where(predicates.conjunction(F.col("metadata"), list(q.filters)))
    return rows


def candidates(index: Index, q: Query, window: int | None) -> DataFrame:
    """(chunk_id, score) of one mode; `window` bounds each ranked list of the hybrid mode."""
    if q.mode == "semantic":
        return semantic(index.vectors, q.vector)
    lex = lexical.score_terms(index.terms, q.text, stemmed=q.stemmed) if index.terms is not None else lexical.score(index.chunks, q.text, headings="headings" if "headings" in index.chunks.columns else None, stemmed=q.stemmed)
    if q.mode == "lexical":
        return lex.select("chunk_id", lexical.saturated(F.col("bm25")).alias("score"))
    lists = [ranked(semantic(index.vectors, q.vector), "score", "chunk_id", window, "rank"), ranked(lex, "bm25", "chunk_id", window, "rank")]
    return fuse([held(x.select("chunk_id", "rank"), window) for x in lists], "chunk_id")


def search(index: Index, q: Query) -> DataFrame:
    """The best `limit` rows of any mode. Semantic and lexical scores don't depend on ranks, so filters go first and the answer is as full as the data allows; hybrid scores do, so its window doubles under a scope until the answer is full."""
    if not q.limit or (q.mode != "semantic" and q.mode != "edge" and not q.text.strip()):
        return assemble(candidates(index, Query(text="-", vector=q.vector or (1.0,), mode="lexical"), 1), index, q).limit(0)
    if q.mode == "edge":
        return edge_search(index, q)
    if q.mode != "hybrid":
        rows = candidates(index, q, None)
        if q.reference_window:
            rows = top_k(rows, "score", "chunk_id", 3 * q.limit)
        found = top_k(assemble(rows, index, q), "score", "chunk_id", q.limit)
    else:
        window, ceiling = 5 * q.limit, None
        while True:
            rows = assemble(candidates(index, q, window), index, q)
            if not q.scope or rows.limit(q.limit).count() >= q.limit:
                break
            ceiling = index.chunks.count() if ceiling is None else ceiling
            if window >= ceiling:
                break
            window = min(2 * window, ceiling)
        found = top_k(rows, "score", "chunk_id", q.limit)
    return boosted(found, index, q) if q.boost_links and index.links is not None else found


def edge_scores(index: Index, vector: tuple[float, ...]) -> DataFrame:
    """(path, edge_score): the best clamped cosine of the edges at either end of which a document stands."""
    near = index.edge_vectors.select("edge_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), V.cosine_to(F.col("vector"), list(vector)))).alias("s")).join(index.edges.select("edge_id", "source", "target"), "edge_id")
    return near.select(F.explode(F.array("source", "target")).alias("path"), "s").groupBy("path").agg(F.max("s").alias("edge_score"))


def boosted(found: DataFrame, index: Index, q: Query) -> DataFrame:
    """The same rows, those near the leading rows' documents in the link graph scored higher. Seeds are at most three paths."""
    found = held(found, q.limit)
    seeds = [r.path for r in found.orderBy(F.desc("score"), "chunk_id").limit(SEEDS).select("path").collect()]
    hops = graph.bfs(index.links, seeds, q.boost_hops)
    rows = found.join(hops, "path", "left")
    weight = F.lit(q.boost_weight)
    if index.edge_vectors is not None and q.vector:
        rows = rows.join(edge_scores(index, q.vector), "path", "left")
        weight = weight * F.coalesce(F.col("edge_score"), F.lit(1.0))
    lift = F.when(F.col("hop").isNotNull(), 1 + weight / F.pow(F.lit(2.0), F.col("hop") - 1)).otherwise(1.0)
    return rows.withColumn("score", F.col("score") * lift).orderBy(F.desc("score"), "chunk_id")


def expand(found: DataFrame, index: Index, vector: tuple[float, ...], depth: int = 1, per_hop: int = 3) -> DataFrame:
    """Documents around the leading results: each with its best chunk among the nearest max(100, 10 n), or else its first; the best of each hop."""
    first = found.orderBy(F.desc("score"), "chunk_id").select("path").limit(HELD).collect()
    seeds = [*dict.fromkeys(r.path for r in first[:SEEDS])]
    seen = found.select("path").distinct() if len(first) == HELD else found.sparkSession.createDataFrame([*{(r.path,) for r in first}], "path string")
    targets = graph.bfs(index.links, seeds, depth).join(seen, "path", "left_anti")
    n = max(100, 10 * targets.count())
    near = top_k(semantic(index.vectors, vector), "score", "chunk_id", n).join(index.chunks.select("chunk_id", "path"), "chunk_id")
    best = near.groupBy("path").agg(F.max_by("chunk_id", F.struct("score", F.negate(F.xxhash64("chunk_id")))).alias("near_id"), F.max("score").alias("near_score"))
    fallback = index.chunks.groupBy("path").agg(F.min_by("chunk_id", "n").alias("first_id"))
    rows = targets.join(best, "path", "left").join(fallback, "path").select("path", "hop", F.coalesce("near_id", "first_id").alias("chunk_id"), F.coalesce("near_score", F.lit(0.0)).alias("score"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("hop").orderBy(F.desc("score"), "path"))).where(F.col("r") <= per_hop).drop("r")
    linked = graph.linked_from(index.links, seeds, rows.select("path"))
    out = rows.join(linked, "path", "left").withColumn("linked_from", F.coalesce("linked_from", F.lit(seeds[0] if seeds else None)))
    if index.edges is not None:
        context = index.edges.groupBy(F.col("source").alias("linked_from"), F.col("target").alias("path")).agg(F.min_by("context", "edge_id").alias("edge_context"))
        out = out.join(context, ["linked_from", "path"], "left")
    return out.orderBy("hop", "path")


def edge_search(index: Index, q: Query) -> DataFrame:
    """The best edges by their own vectors; a scope looks at the source. Edges known only by id are read from it."""
    near = semantic(index.edge_vectors, q.vector, "edge_id")
    parsed = near.select("edge_id", "score", F.regexp_extract("edge_id", r"^edge:(.*)->.*@[^@]*$", 1).alias("id_source"), F.regexp_extract("edge_id", r"^edge:.*->(.*)@[^@]*$", 1).alias("id_target"))
    rows = parsed.join(index.edges, "edge_id", "left").withColumns({"source": F.coalesce("source", "id_source"), "target": F.coalesce("target", "id_target")}).drop("id_source", "id_target")
    if q.scope:
        rows = rows.where(paths.in_scope(F.col("source"), q.scope))
    if q.min_score is not None:
        rows = rows.where(F.col("score") >= q.min_score)
    return top_k(rows, "score", "edge_id", q.limit)


def search_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score): the k nearest of each query. Queries (query_id, vector) go to the vectors in bounded blocks."""
    from larkspur.operators import neighbors

    return neighbors.nearest(vectors.select(F.col(key).alias("id"), "vector"), queries.select(F.col("query_id").alias("id"), "vector"), k).select(F.col("query").alias("query_id"), F.col("id").alias(key), "score")


def by_distance(vectors: DataFrame, query: list[float], k: int, key: str = "chunk_id") -> DataFrame:
    found = semantic(vectors, query, key).select(key, (1 - F.col("score")).alias("distance"))
    return found.orderBy("distance", key).limit(k)
