"""Clusters of document vectors, their keywords and labels, stable identities, topics.

Distances, centroids, keywords and assignments are distributed. Community detection
itself works on the k-NN graph (k edges per document) in one task, as a single
sequential optimisation must; beyond `MAX_NODES` nodes it refuses, and the caller may
choose `kmeans`, whose clusters are of another kind.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur import scratch
from larkspur.functions import text as X
from larkspur.functions import vectors as V
from larkspur.operators import neighbors

K, SEED, RESOLUTION, PARENT_FACTOR, MIN_SIZE, PARENTS_FROM = 15, 42, 1.0, 0.25, 2, 7
SAME_ID, SAME_LABEL, TOPIC_FLOOR, DESCRIPTION_WEIGHT = 0.3, 0.6, 0.30, 0.6
MAX_NODES = 2_000_000
#: Changes after which clusters are worked out anew.
REBALANCE = 50


def leiden(nodes: list, edges: list[tuple[int, int, float]], resolution: float = RESOLUTION, seed: int = SEED, rounds: int = 100) -> list[int]:
    """Community of each node number: local moving by a queue, refinement into connected parts, aggregation, until modularity settles."""
    return leiden_of(len(nodes), *_columns(edges), resolution, seed, rounds)


def _columns(edges: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, w = zip(*edges, strict=True) if edges else ((), (), ())
    return np.array(a, np.int64), np.array(b, np.int64), np.array(w, np.float64)


def _sums(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, sum, place of its first row) of each distinct key, in its order; each sum is taken in the order of the rows."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    return k[new], np.bincount(np.cumsum(new) - 1, weights=w[order]) if len(k) else np.zeros(0), order[new]


class Graph:
    """Links of n nodes in three arrays, 16 bytes a link and end: each node's neighbours in the order in which they came."""

    def __init__(self, n: int, source: np.ndarray, target: np.ndarray, w: np.ndarray):
        self.n = n
        key, sums, first = _sums(source * max(1, n) + target, w)
        s = key // max(1, n)
        order = np.lexsort((first, s))
        self.source, self.target, self.w = s[order].astype(np.int32), (key % max(1, n))[order].astype(np.int32), sums[order]
        self.at = np.searchsorted(self.source, np.arange(n + 1)).tolist()

    def __len__(self) -> int:
        return self.n

    def of(self, i: int) -> tuple[list[int], list[float]]:
        a, b = self.at[i], self.at[i + 1]
        return self.target[a:b].tolist(), self.w[a:b].tolist()


def leiden_of(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float = RESOLUTION, seed: int = SEED, rounds: int = 100) -> list[int]:
    """The same of edges in arrays."""
    import random

    rng = random.Random(seed)
    other = a != b
    a, b, w = a[other], b[other], w[other]
    graph = Graph(n, np.stack([a, b], 1).ravel(), np.stack([b, a], 1).ravel(), np.repeat(w, 2))
    loops = [0.0] * n
    member = np.arange(n)  # node of the current level for each original node
    total = sum(sum(graph.of(i)[1]) for i in range(n)) or 1.0
    start = None
    for _ in range(rounds):
        size = [sum(graph.of(i)[1]) + 2 * loops[i] for i in range(len(graph))]
        of = start or [*range(len(graph))]
        moved = _move(graph, size, of, total, resolution, rng)
        parts = _refine(graph, of, size, total, resolution)
        if not moved and len(set(parts)) == len(graph):
            break
        distinct, number = np.unique(np.array(parts), return_inverse=True)
        k = len(distinct)
        coarse = np.zeros(k, np.int64)
        coarse[number] = of
        p, q = number[graph.source], number[graph.target]
        inside = p == q
        # a node's own loop comes before its links, node by node, so that sums are taken in one order
        at = np.lexsort((np.r_[np.zeros(len(graph), np.int8), np.ones(int(inside.sum()), np.int8)], np.r_[np.arange(len(graph)), graph.source[inside]]))
        inner = np.bincount(np.r_[number, p[inside]][at], weights=np.r_[loops, graph.w[inside] / 2][at], minlength=k).tolist()
        merged = Graph(k, p[~inside].astype(np.int64), q[~inside].astype(np.int64), graph.w[~inside])
        member = number[member]
        done = k == len(graph)
        coarse = coarse.tolist()
        ids = {c: i for i, c in enumerate(dict.fromkeys(coarse))}
        graph, loops, start = merged, inner, [ids[c] for c in coarse]
        if done:
            break
    of = start or [*range(len(graph))]
    return [of[m] for m in member.tolist()]


def _move(graph, size, of, total, resolution, rng) -> bool:
    weight: dict[int, float] = {}
    for i, c in enumerate(of):
        weight[c] = weight.get(c, 0.0) + size[i]
    queue = [*range(len(graph))]
    rng.shuffle(queue)
    waiting, moved, at = set(queue), False, 0
    while at < len(queue):
        i = queue[at]
        at += 1
        waiting.discard(i)
        links: dict[int, float] = {of[i]: 0.0}
        near, ws = graph.of(i)
        for j, w in zip(near, ws, strict=True):
            links[of[j]] = links.get(of[j], 0.0) + w
        own = of[i]
        weight[own] -= size[i]
        gain = lambda c: links[c] - resolution * size[i] * weight.get(c, 0.0) / total  # noqa: E731, B023
        best = max(sorted(links), key=lambda c: (round(gain(c), 12), c == own))
        of[i] = best
        weight[best] = weight.get(best, 0.0) + size[i]
        if best != own:
            moved = True
            for j in near:
                if of[j] != best and j not in waiting:
                    queue.append(j)
                    waiting.add(j)
    return moved


def _refine(graph, of, size, total, resolution) -> list[int]:
    """Within each community, single nodes join well-connected neighbours; parts stay connected."""
    part = [*range(len(graph))]
    weight = [*size]
    alone = [True] * len(graph)
    for i in range(len(graph)):
        if not alone[i]:
            continue
        links: dict[int, float] = {}
        for j, w in zip(*graph.of(i), strict=True):
            if of[j] == of[i]:
                links[part[j]] = links.get(part[j], 0.0) + w
        good = {p: w - resolution * size[i] * weight[p] / total for p, w in links.items() if p != i}
        if good:
            best = max(sorted(good), key=lambda p: round(good[p], 12))
            if good[best] > 0:
                weight[best] += size[i]
                weight[i] -= size[i]
                part[i] = best
                alone[best] = False
    return part


def modularity(of: list[int], edges: list[tuple[int, int, float]], resolution: float = RESOLUTION) -> float:
    total = 2 * sum(w for _, _, w in edges) or 1.0
    degree: dict[int, float] = {}
    inside = 0.0
    for a, b, w in edges:
        degree[of[a]] = degree.get(of[a], 0.0) + w
        degree[of[b]] = degree.get(of[b], 0.0) + w
        inside += 2 * w * (of[a] == of[b])
    return inside / total - resolution * sum(d * d for d in degree.values()) / total**2


def _merge_small(of: list[int], edges: list[tuple[int, int, float]], least: int) -> list[int]:
    """Communities under `least` join the one they are linked to most strongly, the smallest first. Only the links of a community that is merged are looked at."""
    return _merged(of, *_columns(edges), least)


def _merged(of: list[int], a: np.ndarray, b: np.ndarray, w: np.ndarray, least: int) -> list[int]:
    of = [*of]
    ends = np.r_[a, b]
    order = np.argsort(ends, kind="stable")
    at = np.searchsorted(ends[order], np.arange(len(of) + 1)).tolist()
    members: dict[int, list[int]] = {}
    for i, c in enumerate(of):
        members.setdefault(c, []).append(i)
    heap = [(len(m), c) for c, m in members.items() if len(m) < least]
    heapq.heapify(heap)
    while heap:
        size, c = heapq.heappop(heap)
        if len(members.get(c, ())) != size:
            continue
        links: dict[int, float] = {}
        for e in sorted({e for i in members[c] for e in (order[at[i] : at[i + 1]] % max(1, len(a))).tolist()}):
            x, y = of[a[e]], of[b[e]]
            if x != y:
                other = y if x == c else x
                links[other] = links.get(other, 0.0) + float(w[e])
        if not links:
            continue  # no merging of others gives it any
        into = max(sorted(links), key=lambda x: links[x])
        for i in members[c]:
            of[i] = into
        members[into] += members.pop(c)
        if len(members[into]) < least:
            heapq.heappush(heap, (len(members[into]), into))
    return of


def _relabel(of: list[int]) -> list[int]:
    """Numbers by size, then by smallest member."""
    first, size = {}, {}
    for i, c in enumerate(of):
        first.setdefault(c, i)
        size[c] = size.get(c, 0) + 1
    number = {c: i for i, c in enumerate(sorted(size, key=lambda c: (-size[c], first[c])))}
    return [number[c] for c in of]


def communities(vectors: DataFrame, k: int = K, resolution: float = RESOLUTION, seed: int = SEED, least: int = MIN_SIZE) -> DataFrame:
    """(path, cluster_id, parent_id) of documents (path, vector). Parents come from a coarser resolution, where there are at least seven clusters and it joins some."""
    ids = vectors.select(F.col("path").alias("id"), "vector")
    n = ids.count()
    if n > MAX_NODES:
        raise ValueError(f"{n} documents are more than the {MAX_NODES} whose communities one task finds: choose kmeans(vectors, size_for({n})) or raise MAX_NODES")
    edges = neighbors.graph(ids, max(1, min(k, n - 1)))
    every = vectors.select(F.col("path").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("weight")).unionByName(edges.select("a", "b", "weight"))

    def run(key, table):
        # names become numbers in Arrow; no link is an object of its own
        names = pc.unique(table.column("a").filter(pc.is_null(table.column("b"))))
        names = names.take(pc.sort_indices(names))
        linked = table.filter(pc.is_valid(table.column("b")))
        a, b = (pc.index_in(linked.column(c), value_set=names).to_numpy().astype(np.int64) for c in ("a", "b"))
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], linked.column("weight").to_numpy()[order]
        of = _relabel(_merged(leiden_of(len(names), a, b, w, resolution, seed), a, b, w, least))
        parent = [None] * len(names)
        size = len(set(of))
        if size >= PARENTS_FROM:
            x, y = np.array(of)[a], np.array(of)[b]
            between = x != y
            key_, sums, _ = _sums(np.minimum(x, y)[between] * size + np.maximum(x, y)[between], w[between])
            up = _relabel(leiden_of(size, key_ // size, key_ % size, sums, resolution * PARENT_FACTOR, seed))
            if 1 < len(set(up)) < size:
                parent = [size + up[c] for c in of]
        return pa.table([names, pa.array(of, pa.int32()), pa.array(parent, pa.int32())], names=["path", "cluster_id", "parent_id"])

    return every.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(run, "path string, cluster_id int, parent_id int")


def size_for(n: int, granularity: float = 1.0, low: int = 2, high: int = 50) -> int:
    return max(low, min(high, round(math.sqrt(n * granularity / 2))))


def kmeans(vectors: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """(path, cluster_id) by K-means, at most 100 rounds."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("path", array_to_vector(V.normalized(F.col("vector"))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=100, tol=1e-4).fit(rows)
    return model.transform(rows).select("path", F.col("prediction").cast("int").alias("cluster_id"))


def partition_modularity(edges: DataFrame, members: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """One row: the modularity of a partition (path, cluster_id) of a graph (a, b, weight)."""
    of = lambda end: members.select(F.col("path").alias(end), F.col("cluster_id").alias(f"{end}_cluster"))
    rows = edges.join(of("a"), "a").join(of("b"), "b")
    inside = rows.agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("a_cluster") == F.col("b_cluster"), F.col("weight")).otherwise(0.0)).alias("inside"))
    ends = rows.select(F.col("a_cluster").alias("c"), "weight").unionByName(rows.select(F.col("b_cluster").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("w"))
    squares = ends.agg(F.sum(F.col("w") * F.col("w")).alias("squares"))
    return inside.join(squares).select((F.col("inside") / F.col("all") - resolution * F.col("squares") / (4 * F.col("all") * F.col("all"))).alias("modularity"))


def centroids(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(cluster_id, centroid): normalised mean of the normalised members."""
    rows = members.join(vectors.select("path", V.normalized(F.col("vector")).alias("vector")), "path")
    return V.means(rows, "cluster_id", "vector").select("cluster_id", V.normalized(F.col("mean")).alias("centroid"))


def representatives(members: DataFrame, vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """(cluster_id, representative): the member nearest to its centroid, ties by path."""
    rows = members.join(vectors, "path").join(centers, "cluster_id").select("cluster_id", "path", F.round(V.cosine(F.col("vector"), F.col("centroid")), 12).alias("s"))
    best = rows.groupBy("cluster_id").agg(F.max("s").alias("s"))
    return rows.join(best, ["cluster_id", "s"]).groupBy("cluster_id").agg(F.min("path").alias("representative"))


def fold_small(members: DataFrame, vectors: DataFrame, least: int = MIN_SIZE) -> DataFrame:
    """Clusters under `least` members go to the nearest other centroid, if its cosine is positive."""
    size = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    small = members.join(size.where(F.col("size") < least), "cluster_id").select("path").join(vectors, "path")
    centers = centroids(members.join(size.where(F.col("size") >= least), "cluster_id").select("path", "cluster_id"), vectors)
    near = nearest_centroid(small, centers).where("score > 0").select("path", F.col("cluster_id").alias("into"))
    return members.join(near, "path", "left").select("path", F.coalesce("into", "cluster_id").alias("cluster_id"))


def nearest_centroid(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """(path, cluster_id, score): centroids go to the documents in blocks."""
    found = neighbors.nearest(centers.select(F.col("cluster_id").alias("id"), F.col("centroid").alias("vector")), vectors.select(F.col("path").alias("id"), "vector"), 1)
    return found.select(F.col("query").alias("path"), F.col("id").alias("cluster_id"), "score")


def assign(fresh: DataFrame, members: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """(path, cluster_id) of new documents: the cluster with most similarity among their k nearest members, else the nearest centroid."""
    near = neighbors.nearest(vectors.select(F.col("path").alias("id"), "vector"), fresh.select(F.col("path").alias("id"), "vector"), k).where("score > 0")
    votes = near.join(members, near.id == members.path).groupBy("query", "cluster_id").agg(F.sum("score").alias("s"))
    best = votes.groupBy("query").agg(F.max_by("cluster_id", F.struct(F.round("s", 12), -F.col("cluster_id"))).alias("cluster_id")).select(F.col("query").alias("path"), "cluster_id")
    best = scratch.saved(best, "votes")  # read three times below: the search is done once
    rest = fresh.join(best, "path", "left_anti")
    return best.unionByName(nearest_centroid(rest, centroids(members, vectors)).select("path", "cluster_id"))


def running_centroid(old: DataFrame, added: DataFrame) -> DataFrame:
    """Centroids (cluster_id, centroid, n) after vectors (cluster_id, vector) joined them, without reading old members."""
    new = V.means(added, "cluster_id", "vector").join(added.groupBy("cluster_id").agg(F.count("*").alias("m")), "cluster_id")
    both = old.join(new, "cluster_id", "left")
    total = F.col("n") + F.coalesce("m", F.lit(0))
    moved = F.zip_with(F.col("centroid").cast("array<double>"), "mean", lambda a, b: (a * F.col("n") + b * F.col("m")) / total)
    return both.select("cluster_id", F.when(F.col("m").isNull(), F.col("centroid").cast("array<double>")).otherwise(moved).alias("centroid"), total.alias("n"))


def assign_edges(fresh: DataFrame, members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(edge_id, cluster_id) of new edges: the cluster with the nearest centroid. members: (edge_id, cluster_id); fresh and vectors: (edge_id, vector)."""
    of = lambda df: df.withColumnRenamed("edge_id", "path")
    return nearest_centroid(of(fresh), centroids(of(members), of(vectors))).select(F.col("path").alias("edge_id"), "cluster_id")


def needs_rebalance(changes: int, threshold: int = REBALANCE) -> bool:
    """Whether so many documents (or edges) came and went since the last full pass that another one is due."""
    return changes >= threshold


# --- keywords


def keywords(texts: DataFrame, group: str = "cluster_id", text: str = "text", n: int = 5) -> DataFrame:
    """(group, rank, term, score): TF-IDF where each group is one document; ties by term."""
    tf = texts.select(group, F.explode(X.terms(F.col(text))).alias("term")).groupBy(group, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    groups = texts.select(group).distinct().count()
    scored = tf.join(df, "term").withColumn("score", F.col("tf") * X.smoothed_idf(F.lit(groups), F.col("df")))
    best = Window.partitionBy(group).orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select(group, "rank", "term", "score")


def labels(words: DataFrame, group: str = "cluster_id") -> DataFrame:
    """(group, label): up to three keywords by rank, without single words that stand in a pair chosen before."""
    listed = words.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("ws"))

    def step(acc, w):
        said = F.exists(acc, lambda c: F.contains(c, F.lit(" ")) & F.array_contains(F.split(c, " "), w["term"]))
        skip = (F.size(acc) >= 3) | (~F.contains(w["term"], F.lit(" ")) & said)
        return F.when(skip, acc).otherwise(F.concat(acc, F.array(w["term"])))

    chosen = F.aggregate("ws", F.array().cast("array<string>"), step)
    return listed.select(group, F.when(F.size(chosen) > 0, F.array_join(chosen, " / ")).otherwise("Unlabeled").alias("label"))


# --- identity


def overlaps(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id, jaccard) of member tables (path, cluster_id)."""
    o, w = old.select("path", F.col("cluster_id").alias("old_id")), new.select("path", F.col("cluster_id").alias("new_id"))
    both = o.join(w, "path").groupBy("old_id", "new_id").agg(F.count("*").alias("both"))
    a, b = o.groupBy("old_id").agg(F.count("*").alias("a")), w.groupBy("new_id").agg(F.count("*").alias("b"))
    return both.join(a, "old_id").join(b, "new_id").select("old_id", "new_id", (F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).alias("jaccard"))


def identities(old: DataFrame, new: DataFrame, next_id: int) -> dict[int, tuple[int, bool]]:
    """New number to (lasting id, whether the label stays): greedy one-to-one by overlap; others get ids never used before. Works on one row per overlapping pair of clusters."""
    pairs = sorted(((r.jaccard, r.old_id, r.new_id) for r in overlaps(old, new).where(F.col("jaccard") >= SAME_ID).collect()), key=lambda x: (-x[0], x[1], x[2]))
    out: dict[int, tuple[int, bool]] = {}
    used: set[int] = set()
    for j, o, w in pairs:
        if o not in used and w not in out:
            out[w] = (o, j >= SAME_LABEL)
            used.add(o)
    for w in sorted(r.cluster_id for r in new.select("cluster_id").distinct().collect()):
        if w not in out:
            out[w], next_id = (next_id, False), next_id + 1
    return out


def cluster(vectors: DataFrame, texts: DataFrame, previous: DataFrame | None = None, next_id: int = 0, previous_labels: DataFrame | None = None) -> dict[str, DataFrame]:
    """The full pass: members, parents, centroids, representatives, keywords, labels. texts: (path, text).

    previous: the members of the last pass, whose ids go to the clusters that overlap them most; where nearly all members are the
    same, the label (cluster_id, label) of the last pass stays too. All tables use the lasting ids.
    """
    spark = vectors.sparkSession
    found = communities(vectors).select("path", "cluster_id", "parent_id")
    flat = fold_small(found.select("path", "cluster_id"), vectors)
    same = spark.createDataFrame([], "cluster_id int")
    if previous is not None:
        names = identities(previous, flat, next_id)
        lasting = spark.createDataFrame([(w, i) for w, (i, _) in names.items()], "cluster_id int, lasting int")
        same = spark.createDataFrame([(i,) for i, kept in names.values() if kept], "cluster_id int")
        flat = flat.join(lasting, "cluster_id").select("path", F.col("lasting").alias("cluster_id"))
    # what was folded into a cluster may come from another parent: most of its members say which it has
    votes = flat.join(found.select("path", "parent_id"), "path").groupBy("cluster_id", "parent_id").agg(F.count("*").alias("n"))
    parents = votes.groupBy("cluster_id").agg(F.max_by("parent_id", F.struct("n", -F.col("parent_id"))).alias("parent_id"))
    centers = centroids(flat, vectors)
    words = keywords(flat.join(texts, "path"))
    named = labels(words)
    if previous_labels is not None:
        kept = previous_labels.join(same, "cluster_id", "left_semi").select("cluster_id", F.col("label").alias("old"))
        named = named.join(kept, "cluster_id", "left").select("cluster_id", F.coalesce("old", "label").alias("label"))
    return {"members": flat, "parents": parents, "centroids": centers, "representatives": representatives(flat, vectors, centers), "keywords": words, "labels": named}


def edge_clusters(edges: DataFrame, vectors: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame] | None:
    """(members, labels) of semantic edges by K-means over their vectors; none under four edges. edges: (edge_id, context); vectors: (edge_id, vector)."""
    n = vectors.count()
    if n < 4:
        return None
    members = kmeans(vectors.select(F.col("edge_id").alias("path"), "vector"), size_for(n, high=limit)).select(F.col("path").alias("edge_id"), "cluster_id")
    words = keywords(edges.join(members, "edge_id").select("cluster_id", F.col("context").alias("text")))
    return members, labels(words)


# --- topics


def topic_centroids(topics: DataFrame, description: str = "description_vector", seeds: str = "seed_vectors") -> DataFrame:
    """(topic, centroid, threshold): 0.6 of the description and 0.4 of the mean seed, or whichever there is."""
    one = topics.select("topic", F.explode(seeds).alias("v"))
    mean = V.means(one, "topic", "v")
    both = topics.join(mean, "topic", "left")
    d, m = V.doubles(F.col(description)), F.col("mean")
    mix = F.when(d.isNull(), m).when(m.isNull(), d).otherwise(V.mixed(d, m, DESCRIPTION_WEIGHT))
    return both.select("topic", V.normalized(mix).alias("centroid"), "threshold")


def assign_topics(vectors: DataFrame, topics: DataFrame, floor: float = TOPIC_FLOOR) -> DataFrame:
    """(path, topic, score): every topic that is near enough. Topics are a declared list, joined to each document in blocks."""
    count = topics.count()
    near = neighbors.nearest(topics.select(F.col("topic").alias("id"), F.col("centroid").alias("vector")), vectors.select(F.col("path").alias("id"), "vector"), max(1, count))
    bound = topics.select(F.col("topic").alias("id"), F.greatest(F.coalesce("threshold", F.lit(floor)), F.lit(floor)).alias("bound"))
    return near.join(bound, "id").where("score >= bound").select(F.col("query").alias("path"), F.col("id").alias("topic"), "score")


def unassigned(vectors: DataFrame, assigned: DataFrame) -> DataFrame:
    return vectors.select("path").join(assigned.select("path").distinct(), "path", "left_anti")


def primary_topic(assigned: DataFrame) -> DataFrame:
    best = Window.partitionBy("path").orderBy(F.desc("score"), "topic")
    return assigned.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def topic_info(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("topic").agg(F.count("*").alias("members"), F.avg("score").alias("mean_score"))
