"""A collection of documents in one place: its store, and every operation on it as a method that returns a DataFrame."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.config import Config
from larkspur.functions import paths, predicates
from larkspur.functions import vectors as V
from larkspur.operators import clustering, derived, doctor, graph, ingest, shards
from larkspur.operators import collection as tables
from larkspur.operators import schema as schemas
from larkspur.operators import search as searching
from larkspur.sources import embedding
from larkspur.sources.vault import Store, ignore_lines
from larkspur.streaming import watch

TOPICS = "topic string, description string, threshold double, seeds array<string>"
COMPUTED = "path string, field string, value string, code string, message string"


class Collection:
    """root: the directory of Markdown files; store: where the tables are. provider: embeds texts; without one the mock is used."""

    def __init__(self, spark: SparkSession, root: str, store: str, config: Config = Config(), provider: embedding.Provider | None = None, overlay: list[schemas.Field] | None = None, shard_list: list[shards.Shard] | None = None):
        self.spark, self.root, self.store, self.config, self.provider = spark, root.rstrip("/"), Store(spark, store), config.checked(), provider
        if provider is None and config.embedding_url:
            self.provider = embedding.Http(config.embedding_url, config.embedding_model, config.embedding_shape, config.embedding_key_env)
        self.overlay, self.shards = overlay or [], shards.Shards(shard_list if shard_list is not None else self._stored_shards())

    # --- shards and topics: short declared lists, kept in the store

    def _stored_shards(self) -> list[shards.Shard]:
        found = self.store.read("shards")
        return [shards.Shard(r.id, r.name, r.path) for r in found.collect()] if found is not None else []

    def _keep_shards(self) -> None:
        self.store.write(shards=self.spark.createDataFrame([(s.id, s.name, s.path) for s in self.shards.list()], "id string, name string, path string"))

    def add_shard(self, name: str, path: str) -> shards.Shard:
        out = self.shards.add(name, path)
        self._keep_shards()
        return out

    def update_shard(self, id: str, path: str | None = None, rename: str | None = None) -> shards.Shard:
        if path:
            self.shards.retarget(id, path)
        if rename:
            self.shards.update(id, rename)
        self._keep_shards()
        return self.shards.get(id)

    def remove_shard(self, id: str) -> None:
        self.shards.remove(id)
        self._keep_shards()

    def shard_table(self) -> DataFrame:
        """(shard, name, scope, parent), with the number of files."""
        table = self.shards.table(self.spark)
        return table.join(shards.counts(self._table("files"), table), "shard").orderBy("scope")

    def topic_table(self) -> DataFrame:
        """(topic, description, threshold, seeds): the declared topics; seeds are paths of documents."""
        found = self.store.read("topics")
        return self.spark.createDataFrame([], TOPICS) if found is None else found.orderBy("topic")

    def set_topic(self, topic: str, description: str | None = None, threshold: float | None = None, seeds: tuple[str, ...] | None = None, new: bool = False) -> None:
        """Declare a topic, or with new=False change what is given of it."""
        known = {r.topic: r for r in self.topic_table().collect()}
        if new == (topic in known):
            raise ValueError(f"topic {topic!r} is {'taken' if new else 'unknown'}")
        old = known.get(topic)
        pick = lambda now, name: now if now is not None or old is None else old[name]
        known[topic] = (topic, pick(description, "description"), pick(threshold, "threshold"), list(pick(seeds, "seeds") or []))
        self.store.write(topics=self.spark.createDataFrame([tuple(r) for r in known.values()], TOPICS))

    def remove_topic(self, topic: str) -> None:
        left = [tuple(r) for r in self.topic_table().collect() if r.topic != topic]
        self.store.write(topics=self.spark.createDataFrame(left, TOPICS))

    def topic_definitions(self) -> DataFrame:
        """The declared topics with the vectors of their descriptions and seeds, for `topics`."""
        declared = self.topic_table()
        described = self.settings().embed(declared.select("topic", F.col("description").alias("content"), "threshold", "seeds"), "content")
        means = self.document_vectors()
        seeds = declared.select("topic", F.explode("seeds").alias("path")).join(means, "path").groupBy("topic").agg(F.collect_list("vector").alias("seed_vectors"))
        text = F.when(F.col("content").isNotNull(), F.col("vector"))
        return described.select("topic", text.alias("description_vector"), "threshold").join(seeds, "topic", "left")

    # --- tables

    def _table(self, name: str) -> DataFrame:
        found = self.store.read(name)
        if found is None:
            raise LookupError(f"the store has no {name}: ingest first")
        return found

    def files(self) -> DataFrame:
        """Documents with their effective metadata."""
        computed = self.store.read("computed")
        files = self._table("files")
        return files if computed is None else tables.effective(files, computed)

    def index(self) -> searching.Index:
        mentions = self._table("mentions").select("edge_id", "source", "target", F.col("paragraph").alias("context"))
        vectors = self._table("vectors").select("chunk_id", "vector")
        return searching.Index(self._table("chunks").drop("path").join(self._table("chunks").select("chunk_id", "path"), "chunk_id"), vectors, self.files(), self._table("links"), mentions, self._table("edge_vectors").select("edge_id", "vector"), self._table("terms"))

    def document_vectors(self) -> DataFrame:
        """(path, vector): mean of a document's chunks."""
        return V.means(self._table("vectors"), "path", "vector").select("path", F.col("mean").alias("vector"))

    def edge_vectors(self) -> DataFrame:
        return self._table("edge_vectors")

    # --- writing

    def settings(self) -> ingest.Settings:
        """What the configuration says about taking documents in."""
        c = self.config
        ignored = tuple(ignore_lines(self.spark, self.root)) if c.ignore_files else ()
        return ingest.Settings(self.provider, c.embedding_dims, c.embedding_batch, c.source_dirs, c.ignore_patterns, ignored, c.chunk_max_tokens, c.chunk_overlap_tokens, c.embedding_at_once)

    def parsed(self) -> DataFrame:
        return ingest.parsed(self.spark, self.root, self.settings())

    def ingest(self, full: bool = False, file: str | None = None) -> DataFrame:
        """Take in what changed; with `file`, that document only."""
        return ingest.ingest(self.store, self.root, self.settings(), full, file)

    def preview(self) -> DataFrame:
        return ingest.preview(self.parsed(), self.store.read("files"), self.settings())

    def watch(self, events: DataFrame, checkpoint: str, interval: str | None = "", on_batch=None):
        """The loop; without an interval (None) it takes what is there and stops, by default it runs at the configured one."""
        every = f"{self.config.watch_debounce_ms} milliseconds" if interval == "" else interval
        return watch.watch(events, self.store, checkpoint, every, on_batch, self.settings())

    def run_modules(self) -> DataFrame:
        """Formulas, lookups and rollups of the overlay, for all documents; results are written to the store."""
        formulas, moves = derived.definitions_for(self.overlay)
        got = derived.run(self._table("files"), self.relations(), formulas, moves)
        self.store.write(computed=got if got is not None else self.spark.createDataFrame([], COMPUTED))
        return self._table("computed")

    def module_status(self) -> DataFrame:
        """(field, done, failed)."""
        return self._table("computed").groupBy("field").agg(F.count_if(F.col("code").isNull()).alias("done"), F.count_if(F.col("code").isNotNull()).alias("failed")).orderBy("field")

    # --- reading

    def search(self, text: str = "", vector: list[float] | None = None, shard: str | None = None, filters: list[str] | None = None, **kw) -> DataFrame:
        """Results of any mode. The query's vector is given, or made by the provider or the mock."""
        c = self.config
        q = searching.Query(text=text, mode=c.search_mode, limit=c.search_limit, boost_links=c.boost_links, boost_weight=c.boost_weight, boost_hops=c.boost_hops, half_life=c.decay_half_life if c.decay else None, stemmed=c.stemming)
        q = replace(q, **kw, filters=tuple(map(predicates.parse, filters or [])))
        if shard:
            q = replace(q, scope=self.shards.get(shard).path)
        if q.mode != "lexical":
            q = replace(q, vector=tuple(vector or self._embedded(text)))
        if q.half_life and q.now is None:
            q = replace(q, now=self._table("files").agg(F.max("modified_at")).head()[0] or 0)
        return searching.search(self.index(), q)

    def _embedded(self, text: str) -> list[float]:
        if self.provider:
            return self.provider([text])[0]
        return self.spark.range(1).select(V.mock_embedding(F.lit(text), self.config.embedding_dims)).head()[0]

    def expand(self, results: DataFrame, vector: list[float], depth: int = 1, per_hop: int = 3) -> DataFrame:
        return searching.expand(results, self.index(), tuple(vector), depth, per_hop)

    def status(self, scope: str = "") -> DataFrame:
        return ingest.status({n: self._table(n) for n in ("files", "chunks", "vectors", "links")}, scope)

    def info(self) -> DataFrame:
        """What an ingest would do now."""
        return self.preview()

    def relations(self) -> DataFrame:
        return tables.relations(self._table("files"), {(f.scope, f.name): f.relation_target for f in self.overlay})

    def schema(self, scope: str = "") -> DataFrame:
        return schemas.schema(self._table("files"), self.overlay, scope)

    def collection(self, populate: bool = False, **kw) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rows of the page, columns, total)."""
        q = tables.Query(**kw)
        files = self.files()
        found = tables.rows(files, q)
        page = tables.page(found, q)
        return tables.populate(page, self.relations(), files) if populate else page, tables.columns(found, self.schema(q.path)), found.agg(F.count("*").alias("total"))

    def get(self, path: str, populate: bool = False) -> DataFrame:
        one = tables.document(self.files(), path)
        return tables.populate(one, self.relations(), self.files()) if populate else one

    def referenced_by(self, path: str) -> DataFrame:
        return tables.referenced_by(self.relations(), self._table("files"), path)

    def links(self, path: str) -> DataFrame:
        return graph.forward(self._table("links"), self._table("files"), path)

    def backlinks(self, path: str) -> DataFrame:
        return graph.backlinks(self._table("links"), path)

    def orphans(self) -> DataFrame:
        return graph.orphans(self._table("files"), self._table("links"))

    def neighborhood(self, path: str, depth: int = 1, reverse: bool = False) -> DataFrame:
        return graph.neighborhood(self._table("links"), path, depth, reverse)

    def edges(self, path: str | None = None, relationship: str | None = None) -> DataFrame:
        """Semantic edges with strength and relationship (the label of their cluster)."""
        edges = self.index().edges
        known = graph.strength(edges, self.edge_vectors().select("edge_id", "vector"), self.document_vectors())
        out = edges.join(known, "edge_id", "left")
        found = clustering.edge_clusters(edges, self.edge_vectors().select("edge_id", "vector"))
        if found is not None:
            members, labels = found
            out = out.join(members.join(labels, "cluster_id").select("edge_id", F.col("label").alias("relationship")), "edge_id", "left")
        else:
            out = out.withColumn("relationship", F.lit(None).cast("string"))
        if path:
            out = out.where((F.col("source") == path) | (F.col("target") == path))
        if relationship:
            out = out.where(F.contains(F.lower("relationship"), F.lit(relationship.lower())))
        return out

    def graph(self, level: str = "document", scope: str = "") -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of documents or of chunks."""
        if level == "document":
            return graph.document_graph(self._table("files"), self._table("links"), self.index().edges, scope)
        vectors = self._table("vectors").where(paths.in_scope(F.col("path"), scope))
        return vectors.select("chunk_id", "path"), graph.chunk_graph(vectors)

    def tree(self) -> DataFrame:
        """Folders and files, with the state of each file against the disk."""
        now = self.parsed().select("path", "content_hash")
        states = tables.states(now, self._table("files").select("path", "content_hash"))
        return graph.file_tree(states).join(states, "path", "left")

    def texts(self) -> DataFrame:
        return ingest.document_texts(self._table("chunks"))

    def clusters(self) -> dict[str, DataFrame]:
        """The full pass over all documents, kept in the store; clusters that are nearly the same as in the last pass keep their id and label."""
        known, info = self.store.read("cluster_members"), self.store.read("cluster_state")
        state = info.head() if info is not None else None
        got = clustering.cluster(self.document_vectors(), self.texts(), known, state.next_id if state else 0, self.store.read("cluster_labels"))
        self.store.write(**{f"cluster_{n}": df for n, df in got.items()})
        top = self._table("cluster_members").agg(F.max("cluster_id")).head()[0]
        self._keep_state(max((top if top is not None else -1) + 1, state.next_id if state else 0), 0)
        return {n: self._table(f"cluster_{n}") for n in got}

    def _keep_state(self, next_id: int, changes: int) -> None:
        self.store.write(cluster_state=self.spark.createDataFrame([(next_id, changes)], "next_id int, changes long"))

    def follow_clusters(self, threshold: int = clustering.REBALANCE) -> DataFrame:
        """Bring the stored clusters up to date with the documents without a full pass: new and changed ones join the cluster of their nearest members, gone ones leave. After `threshold` changes there is a full pass."""
        known, vectors = self.store.read("cluster_members"), self.document_vectors()
        if known is None:
            return self.clusters()["members"]
        stay = known.join(vectors.select("path"), "path", "left_semi")
        fresh = vectors.join(known, "path", "left_anti")
        joined = clustering.assign(fresh, stay, vectors.join(stay, "path", "left_semi"))
        state = self._table("cluster_state").head()
        changes = state.changes + fresh.count() + known.count() - stay.count()
        if clustering.needs_rebalance(changes, threshold):
            return self.clusters()["members"]
        old = self._table("cluster_centroids").join(stay.groupBy("cluster_id").agg(F.count("*").alias("n")), "cluster_id")
        centers = clustering.running_centroid(old, joined.join(vectors, "path").select("cluster_id", "vector")).select("cluster_id", "centroid")
        self.store.write(cluster_members=stay.unionByName(joined), cluster_centroids=centers)
        self._keep_state(state.next_id, changes)
        return self._table("cluster_members")

    def topics(self, definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(assigned, unassigned); definitions: topic, description_vector, seed_vectors, threshold."""
        v = self.document_vectors()
        got = clustering.assign_topics(v, clustering.topic_centroids(definitions), self.config.topic_threshold)
        return got, clustering.unassigned(v, got)

    def analyse_shard(self, shard: str) -> dict[str, DataFrame]:
        return shards.analyse(self.document_vectors(), self.texts(), self.shards.get(shard))

    def doctor(self) -> DataFrame:
        return doctor.report(self._table("files"), self._table("chunks"), self._table("vectors"), self.relations(), self._table("links"), sorted({f.relation_target for f in self.overlay if f.relation_target}))

    def chunks(self) -> DataFrame:
        return self._table("chunks")
