"""Schemas of semi-structured metadata, as tables: inferred from values, merged with a declared overlay, by scope.

Numbers are read through VARIANT, which drops trailing zeros of their text.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import paths
from larkspur.functions.let import let
from larkspur.functions.predicates import plain

SAMPLES = 20
TYPES = ("String", "Number", "Boolean", "List", "Date", "Mixed", "Formula", "Relation", "File", "Json", "Lookup", "Rollup")


@dataclass(frozen=True)
class Field:
    """A declared field of an overlay, for a scope ('' for all)."""

    name: str
    scope: str = ""
    field_type: str | None = None
    description: str | None = None
    required: bool = False
    allowed: tuple[str, ...] | None = None
    relation_target: str | None = None
    formula: str | None = None
    result_type: str | None = None
    relation_field: str | None = None
    target_field: str | None = None
    direction: str | None = None
    relation_scope: str | None = None


def entries(files: DataFrame, *keep: str) -> DataFrame:
    """(keep ..., name, value): a row for each top-level field of a JSON object; value is its JSON text."""
    # values become text inside the generator: a filter on them would be pushed below a projection and write each one twice
    each = F.transform(F.map_entries(F.from_json("metadata", "map<string,variant>")), lambda e: F.struct(e["key"].alias("name"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("value")))
    return files.select(*keep, F.explode(each).alias("e")).select(*keep, "e.name", "e.value")


def _kind_of_text(text: Column) -> Column:
    return paths.link_kind(paths.link_target(text))


def infer_type(value: Column) -> Column:
    """Type of a JSON text. Links come first; lists of only document links or only file links keep that type, mixed ones are Mixed."""

    def of_kinds(kinds):
        return F.when(F.array_contains(kinds, "none"), "List").when(F.size(F.array_distinct(kinds)) > 1, "Mixed").when(F.get(kinds, F.lit(0)) == "relation", "Relation").otherwise("File")

    def of_list(items):
        nested = F.exists(items, lambda x: x.startswith("[") | x.startswith("{"))
        kinds = F.transform(items, lambda x: F.when(x.startswith('"'), F.coalesce(_kind_of_text(plain(x)), F.lit("none"))).otherwise("none"))
        return F.when(F.size(items) == 0, "List").when(nested, "Json").otherwise(let(kinds, of_kinds))

    def of_text(text):
        return let(_kind_of_text(text), lambda kind: F.when(kind == "relation", "Relation").when(kind == "file", "File").when(text.rlike(r"^\d{4}-\d\d-\d\d(?:$|T)"), "Date").otherwise("String"))

    def of(v):
        items = F.transform(F.from_json(v, "array<variant>"), lambda x: F.coalesce(F.to_json(x), F.lit("null")))
        return (
            F.when(v.isin("true", "false"), "Boolean").when(v.rlike("^-?[0-9]"), "Number").when(v.startswith("["), let(items, of_list)).when(v.startswith("{"), "Json")
            .when(v == "null", "String").otherwise(let(plain(v), of_text))
        )

    return let(value, of)


def infer(files: DataFrame, scope: str = "") -> DataFrame:
    """(name, field_type, occurrences, samples): nulls don't count, differing types are Mixed, samples are the first 20 of the sorted distinct values."""
    rows = entries(files.where(paths.in_scope(F.col("path"), scope))).where("value != 'null'")
    # equal values of a field are looked at once; the condition keeps both readers' columns alike, so that they share the exchange
    once = rows.groupBy("name", "value").agg(F.count("*").alias("n")).where("n > 0")
    typed = once.select("name", "n", infer_type(F.col("value")).alias("t"), plain(F.col("value")).alias("sample"))
    # distinct values per field are narrowed before they are gathered
    counts = typed.groupBy("name").agg(F.sum("n").alias("occurrences"), F.min("t").alias("a"), F.max("t").alias("b"))
    from pyspark.sql import Window

    first = typed.select("name", "sample").distinct().withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("sample"))).where(F.col("r") <= SAMPLES)
    samples = first.groupBy("name").agg(F.array_sort(F.collect_list("sample")).alias("samples"))
    return counts.join(samples, "name").select("name", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("Mixed").alias("field_type"), "occurrences", "samples").orderBy("name")


def scopes(files: DataFrame) -> DataFrame:
    """Distinct top folders."""
    return files.where(F.contains("path", F.lit("/"))).select(F.split("path", "/")[0].alias("scope")).distinct().orderBy("scope")


def infer_scoped(files: DataFrame) -> DataFrame:
    """The inferred schema of every top folder at once: (scope, name, field_type, occurrences)."""
    rows = entries(files.where(F.contains("path", F.lit("/"))), "path").where("value != 'null'").select(F.split("path", "/")[0].alias("scope"), "name", infer_type(F.col("value")).alias("t"))
    g = rows.groupBy("scope", "name").agg(F.count("*").alias("occurrences"), F.min("t").alias("a"), F.max("t").alias("b"))
    return g.select("scope", "name", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("Mixed").alias("field_type"), "occurrences").orderBy("scope", "name")


_OVERLAY = "name string, scope string, field_type string, description string, required boolean, allowed array<string>, relation_target string, formula string, result_type string, relation_field string, target_field string, direction string, relation_scope string"


def validate(fields: list[Field]) -> None:
    seen = set()
    for f in fields:
        if not f.name.strip():
            raise ValueError("a field needs a name")
        if (f.scope, f.name) in seen:
            raise ValueError(f"{f.name} is declared twice for scope {f.scope!r}")
        seen.add((f.scope, f.name))
        if f.field_type is not None and f.field_type not in TYPES:
            raise ValueError(f"{f.name}: unknown type {f.field_type}")
        if f.field_type == "Formula" and not f.formula:
            raise ValueError(f"{f.name}: a Formula needs a formula")
        if f.field_type in ("Lookup", "Rollup") and not (f.relation_field and f.target_field):
            raise ValueError(f"{f.name}: a {f.field_type} needs relation_field and target_field")
        if f.field_type == "Rollup" and f.direction not in ("outgoing", "incoming"):
            raise ValueError(f"{f.name}: direction is outgoing or incoming")


def load_overlay(text: str) -> list[Field]:
    """An overlay from YAML: fields for all, and for scopes."""
    import yaml

    raw = yaml.safe_load(text) or {}
    out = []
    for scope, group in [("", raw), *((paths.scope_of(k), v or {}) for k, v in (raw.get("scopes") or {}).items())]:
        for name, f in (group.get("fields") or {}).items():
            f = dict(f or {})
            known = {k: f.get(k) for k in ("description", "formula", "relation_field", "target_field", "relation_scope") if k in f}
            out.append(Field(name, scope, _type(f.get("field_type") or f.get("type")), required=bool(f.get("required")), allowed=tuple(map(str, f["allowed_values"])) if f.get("allowed_values") else None, relation_target=f.get("target"), result_type=f.get("result_type"), direction=f.get("relation_direction") or f.get("direction"), **known))
    validate(out)
    return out


def _type(name: str | None) -> str | None:
    return None if name is None else name[:1].upper() + name[1:].lower()


def resolve(fields: list[Field], path: str) -> list[Field]:
    """What holds for a path: per name the field with the longest scope around it."""
    best: dict[str, Field] = {}
    for f in sorted(fields, key=lambda f: len(f.scope)):
        s = paths.scope_of(f.scope)
        if not s or path == s or path.startswith(s + "/"):
            best[f.name] = f
    return [best[n] for n in sorted(best)]


def merge(spark: SparkSession, inferred: DataFrame, fields: list[Field]) -> DataFrame:
    """The inferred schema with the declared one over it; declared fields without values have no occurrences."""
    validate(fields)
    overlay = spark.createDataFrame([{**asdict(f), "allowed": list(f.allowed) if f.allowed else None} for f in fields], _OVERLAY)
    over = overlay.select("name", F.col("field_type").alias("declared"), "description", "required", "allowed", "relation_target", "formula", "result_type")
    rows = inferred.join(over, "name", "full_outer")
    return rows.select(
        "name", F.coalesce("declared", "field_type", F.lit("String")).alias("field_type"), "description", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        "allowed", F.coalesce("required", F.lit(False)).alias("required"), "relation_target", "formula", "result_type",
    ).orderBy("name")


def schema(files: DataFrame, fields: list[Field], scope: str = "") -> DataFrame:
    """The schema that holds in a scope: values below it, and the overlay of it and of what encloses it."""
    return merge(files.sparkSession, infer(files, scope), resolve(fields, paths.scope_of(scope)))
