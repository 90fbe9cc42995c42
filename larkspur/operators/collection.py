"""Documents as a table: rows of a folder, filtered, sorted by any field, paged; columns; relations filled in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import paths, predicates
from larkspur.operators import schema as S


@dataclass(frozen=True)
class Query:
    path: str = ""
    recursive: bool = False
    filters: tuple = ()
    sort: str | None = None
    descending: bool = False
    limit: int | None = None
    offset: int = 0


def states(disk: DataFrame, known: DataFrame) -> DataFrame:
    """(path, state): indexed, modified, new or deleted, from (path, content_hash) on disk and in the index."""
    d, k = disk.select("path", F.col("content_hash").alias("now")), known.select("path", F.col("content_hash").alias("then"))
    state = F.when(F.col("now").isNull(), "deleted").when(F.col("then").isNull(), "new").when(F.col("now") == F.col("then"), "indexed").otherwise("modified")
    return d.join(k, "path", "full_outer").select("path", state.alias("state"))


def state_counts(states_: DataFrame) -> DataFrame:
    return states_.groupBy("state").agg(F.count("*").alias("files"))


def rows(files: DataFrame, q: Query) -> DataFrame:
    """The filtered rows with title; not yet sorted or paged, so their count is the total."""
    out = files.where(paths.below(F.col("path"), q.path, q.recursive))
    if q.filters:
        out = out.where(predicates.conjunction(F.col("metadata"), list(q.filters)))
    name = predicates.plain(predicates.field(F.col("metadata"), "title"))
    return out.withColumn("title", paths.title(name, F.col("path"))).withColumn("title_source", paths.title_source(name))


def sort_keys(value: Column, descending: bool) -> list[Column]:
    """Nulls last both ways; numbers as exact decimals, before anything else as text; ties go by path upwards."""
    missing = value.isNull() | (value == "null")
    number = predicates.decimal(value)
    text = F.when(number.isNull(), predicates.plain(value))
    turn = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_last())
    kind = number.isNull().cast("int")
    return [missing.asc(), kind.desc() if descending else kind.asc(), turn(number), turn(text), F.col("path").asc()]


def page(found: DataFrame, q: Query) -> DataFrame:
    """The rows of one page. Sorting with a limit keeps only offset + limit rows per task."""
    out = found
    if q.sort:
        by = F.col("title") if q.sort == "title" else F.col("path") if q.sort == "path" else None
        keys = sort_keys(predicates.field(F.col("metadata"), q.sort), q.descending) if by is None else [by.desc() if q.descending else by.asc(), F.col("path").asc()]
        out = out.orderBy(*keys)
    else:
        out = out.orderBy("path")
    if q.limit is not None:
        out = out.limit(q.offset + q.limit)
    return out.offset(q.offset) if q.offset else out


def columns(found: DataFrame, schema: DataFrame) -> DataFrame:
    """(name, in_schema, present): fields of the schema and fields of the filtered rows, before paging."""
    seen = S.entries(found, "path").groupBy("name").agg(F.count("*").alias("present"))
    return schema.select("name", F.lit(True).alias("in_schema")).join(seen, "name", "full_outer").select("name", F.coalesce("in_schema", F.lit(False)).alias("in_schema"), F.coalesce("present", F.lit(0)).alias("present")).orderBy("name")


def relations(files: DataFrame, folders: dict[tuple[str, str], str | None] | None = None) -> DataFrame:
    """(source, field, pos, raw, target, exists): link values of metadata resolved to the first document of their candidates that exists, or else the first candidate. folders: by (scope, field), where the field's targets lie; the longest scope holds, None is nowhere in particular."""
    values = S.entries(files, "path")
    items = F.when(F.col("value").startswith("["), F.transform(F.from_json("value", "array<variant>"), lambda v: F.to_json(v))).otherwise(F.array("value"))
    each = values.select(F.col("path").alias("source"), F.col("name").alias("field"), F.posexplode(items).alias("pos", "raw"))
    each = each.withColumn("raw", predicates.plain(F.col("raw"))).withColumn("link", F.when(F.col("raw").isNotNull(), paths.link_target(F.col("raw")))).where(paths.link_kind(F.col("link")) == "relation")
    candidates = paths.relation_candidates(F.col("source"), F.col("link"))
    plain = candidates
    for (scope, name), folder in sorted((folders or {}).items(), key=lambda x: len(x[0][0])):
        there = paths.relation_candidates(F.col("source"), F.col("link"), folder) if folder else plain
        candidates = F.when((F.col("field") == name) & paths.in_scope(F.col("source"), scope), there).otherwise(candidates)
    tried = each.select("source", "field", "pos", "raw", F.posexplode(candidates).alias("rank", "target"))
    known = files.select(F.col("path").alias("target"), F.lit(True).alias("known")).distinct()
    met = tried.join(known, "target", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    best = F.min_by(F.struct("target", "known"), F.struct((~F.col("known")).alias("a"), F.col("rank")))
    return met.groupBy("source", "field", "pos", "raw").agg(best.alias("b")).select("source", "field", "pos", "raw", F.col("b.target").alias("target"), F.col("b.known").alias("exists"))


def populate(page_: DataFrame, related: DataFrame, files: DataFrame) -> DataFrame:
    """The page's rows, in their order, with `relations`: field to the ordered targets, each with path, whether it exists, title and metadata. Self-references are left out."""
    page_ = page_.withColumn("_pos", F.monotonically_increasing_id())
    name = predicates.plain(predicates.field(F.col("metadata"), "title"))
    of = files.select(F.col("path").alias("target"), paths.title(name, F.col("path")).alias("target_title"), F.col("metadata").alias("target_metadata"))
    mine = related.where("source != target").join(page_.select(F.col("path").alias("source")).distinct(), "source", "left_semi").join(of, "target", "left")
    item = F.struct("pos", "target", "exists", F.coalesce("target_title", paths.stem(F.col("target"))).alias("title"), F.col("target_metadata").alias("metadata"))
    by_field = mine.groupBy("source", "field").agg(F.array_sort(F.collect_list(item), lambda a, b: a["pos"] - b["pos"]).alias("items"))
    per_doc = by_field.groupBy(F.col("source").alias("path")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "items")), lambda a, b: F.when(a["field"] < b["field"], -1).when(a["field"] > b["field"], 1).otherwise(0))).alias("relations"))
    return page_.join(per_doc, "path", "left").orderBy("_pos").drop("_pos")


def referenced_by(related: DataFrame, files: DataFrame, target: str | None = None) -> DataFrame:
    """(target, source, field, title): documents that name a document in a field, ordered by source and field."""
    name = predicates.plain(predicates.field(F.col("metadata"), "title"))
    of = files.select(F.col("path").alias("source"), paths.title(name, F.col("path")).alias("title"))
    out = related.where("exists AND source != target")
    out = out if target is None else out.where(F.col("target") == target)
    return out.select("target", "source", "field").distinct().join(of, "source").select("target", "source", "field", "title").orderBy("target", "source", "field")


def document(files: DataFrame, path: str) -> DataFrame:
    """One document's row; the path filter reaches the scan."""
    return files.where(F.col("path") == paths.scope_of(path))


def effective(files: DataFrame, computed: DataFrame) -> DataFrame:
    """Metadata with computed values over it; a computed field with an error hides its stored value. computed: (path, field, value, code)."""
    each = computed.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("field", F.when(F.col("code").isNull(), F.parse_json("value")).alias("v")))).alias("over"))
    both = files.join(each, "path", "left")
    old = F.coalesce(F.from_json("metadata", "map<string,variant>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys("over"), k))
    good = F.map_filter("over", lambda k, v: v.isNotNull())
    return both.withColumn("metadata", F.when(F.col("over").isNull(), F.col("metadata")).otherwise(F.to_json(F.map_concat(kept, good)))).drop("over")
