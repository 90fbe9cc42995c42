"""Shards: named scopes of a collection, with derived parents and their own counts and analysis."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import paths


@dataclass(frozen=True)
class Shard:
    id: str
    name: str
    path: str


def valid_path(path: str) -> str:
    p = path.replace("\\", "/").removeprefix("./").rstrip("/")
    if not p or p.startswith("/") or re.match(r"^[A-Za-z]:", p) or any(x in ("", ".", "..") for x in p.split("/")):
        raise ValueError(f"{path!r} is no folder of the collection")
    return p


class Shards:
    """A small catalogue, held by the driver."""

    def __init__(self, shards: list[Shard] | None = None):
        self.by_id = {s.id: s for s in shards or []}
        self.topics: dict[str, dict[str, dict]] = {}

    def list(self) -> list[Shard]:
        return sorted(self.by_id.values(), key=lambda s: (s.path.split("/"), s.name, s.id))

    def get(self, id: str) -> Shard:
        return self.by_id[id]

    def add(self, name: str, path: str, id: str | None = None) -> Shard:
        key = id or re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-")
        p = valid_path(path)
        if not key or key in self.by_id:
            raise ValueError(f"shard id {key!r} is empty or taken")
        if any(s.path == p for s in self.by_id.values()):
            raise ValueError(f"{p} already is a shard")
        self.by_id[key] = Shard(key, name, p)
        return self.by_id[key]

    def update(self, id: str, name: str) -> Shard:
        self.by_id[id] = replace(self.by_id[id], name=name)
        return self.by_id[id]

    def retarget(self, id: str, path: str) -> Shard:
        p = valid_path(path)
        if any(s.path == p and s.id != id for s in self.by_id.values()):
            raise ValueError(f"{p} already is a shard")
        self.by_id[id] = replace(self.by_id[id], path=p)
        return self.by_id[id]

    def remove(self, id: str) -> None:
        del self.by_id[id]
        self.topics.pop(id, None)

    def set_topic(self, id: str, topic: str, description: str = "", seeds: tuple[str, ...] = (), threshold: float | None = None) -> None:
        self.get(id)
        self.topics.setdefault(id, {})[topic] = {"description": description, "seeds": list(seeds), "threshold": threshold}

    def remove_topic(self, id: str, topic: str) -> None:
        del self.topics[id][topic]

    def parent(self, id: str) -> str | None:
        """The shard with the longest proper prefix of this one's path."""
        own = self.by_id[id].path
        around = [s for s in self.by_id.values() if own.startswith(s.path + "/")]
        return max(around, key=lambda s: len(s.path)).id if around else None

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s.id, s.name, s.path, self.parent(s.id)) for s in self.list()], "shard string, name string, scope string, parent string")


def counts(files: DataFrame, table: DataFrame) -> DataFrame:
    """(shard, files): documents of each shard, nested shards counted in all around them. Each path is spread to its folders, then joined by equality."""
    parts = F.split("path", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    per_folder = files.select(F.explode(above).alias("scope")).groupBy("scope").agg(F.count("*").alias("files"))
    return table.join(per_folder, "scope", "left").select("shard", F.coalesce("files", F.lit(0)).alias("files"))


def restrict(df: DataFrame, shard: Shard, column: str = "path") -> DataFrame:
    return df.where(paths.in_scope(F.col(column), shard.path))


def fingerprint(files: DataFrame, settings: dict) -> DataFrame:
    """One row that changes when any document of the shard or a setting does; order plays no part, so it combines partially."""
    h = F.xxhash64("path", "content_hash").cast("decimal(38,0)")
    return files.agg(F.count("*").alias("files"), F.sum(h).alias("sum")).select(F.sha2(F.concat_ws("|", F.col("files").cast("string"), F.col("sum").cast("string"), F.lit(repr(sorted(settings.items())))), 256).alias("fingerprint"))


def analyse(vectors: DataFrame, texts: DataFrame, shard: Shard, previous: DataFrame | None = None) -> dict[str, DataFrame]:
    """Clusters of one shard, at most about the square root of its documents."""
    from larkspur.operators import clustering

    return clustering.cluster(restrict(vectors, shard), restrict(texts, shard), previous)
