"""Derived fields: formulas per row, lookups and rollups along relations.

Definitions are put in strata: a lookup or rollup that reads another one comes after
it, one join per stratum. Results are rows (path, field, value, code, message), value
as JSON; errors are codes, never exceptions or missing rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur import scratch
from larkspur.functions import paths, predicates
from larkspur.functions.formula import columns as C
from larkspur.functions.formula.compiler import Definition
from larkspur.functions.let import let

SUM, LENGTH = "values.reduce((sum, value) => sum + value, 0)", "values.length"
#: Rounds of a field that reads itself along relations.
MAX_DEPTH = 256


@dataclass(frozen=True)
class Lookup:
    """`field` of documents in `scope`: the target's `target_field` through the relation `relation`.

    Folders in `excluded` have another declaration of the field. relation_types: declared types of the relation's field, (scope,
    type), by which it may not be a relation at all; without one, its values tell.
    """

    field: str
    relation: str
    target_field: str
    scope: str = ""
    excluded: tuple[str, ...] = ()
    relation_types: tuple[tuple[str, str | None], ...] = ()


@dataclass(frozen=True)
class Rollup:
    """`field` of documents in `scope`: a formula over `values`, the `target_field` of documents they relate to (outgoing) or that relate to them (incoming, from `relation_scope`)."""

    field: str
    relation: str
    target_field: str
    direction: str = "outgoing"
    formula: str = SUM
    scope: str = ""
    relation_scope: str = ""
    result_type: str = "json"
    excluded: tuple[str, ...] = ()
    relation_types: tuple[tuple[str, str | None], ...] = ()


def _owned(path: Column, d: Lookup | Rollup) -> Column:
    """Whether the definition holds for a document."""
    out = paths.in_scope(path, d.scope)
    for other in d.excluded:
        out = out & ~paths.in_scope(path, other)
    return out


def definitions_for(fields: list) -> tuple[dict[str, list[Definition]], list[Lookup | Rollup]]:
    """What an overlay declares: for each of its scopes the formulas that hold for documents whose innermost scope it is, and all lookups and rollups.

    Of declarations of one field, that with the longest scope around a document holds, whatever its type.
    """
    from larkspur.operators import schema as S

    scopes = sorted({paths.scope_of(f.scope) for f in fields} | {""})
    formulas_, moves = {}, []
    for scope in scopes:
        formulas_[scope] = [Definition(f.name, f.formula, f.result_type or "json") for f in S.resolve(fields, scope) if f.field_type == "Formula"]
    for f in fields:
        own = paths.scope_of(f.scope)
        if f.field_type not in ("Lookup", "Rollup"):
            continue
        inner = tuple(sorted(s for g in fields if g.name == f.name and (s := paths.scope_of(g.scope)) != own and (not own or s.startswith(own + "/"))))
        kinds = tuple((paths.scope_of(g.scope), g.field_type or ("Relation" if g.relation_target else None)) for g in fields if g.name == f.relation_field)
        if f.field_type == "Lookup":
            moves.append(Lookup(f.name, f.relation_field, f.target_field, own, inner, kinds))
        else:
            moves.append(Rollup(f.name, f.relation_field, f.target_field, f.direction, f.formula or "", own, paths.scope_of(f.relation_scope or ""), f.result_type or "", inner, kinds))
    return formulas_, moves


def scoped_formulas(files: DataFrame, by_scope: dict[str, list[Definition]], unsupported: dict[str, frozenset[str]]) -> DataFrame | None:
    """The formulas of each scope for the documents whose innermost declared scope it is."""
    out = None
    for scope, definitions in by_scope.items():
        if not definitions:
            continue
        mine = paths.in_scope(F.col("path"), scope)
        for other in by_scope:
            if other != scope and (not scope or other.startswith(scope + "/")):
                mine = mine & ~paths.in_scope(F.col("path"), other)
        one = formulas(files.where(mine), definitions, unsupported.get(scope, frozenset()))
        out = one if out is None else out.unionByName(one)
    return out


def formulas(files: DataFrame, definitions: list[Definition], unsupported: frozenset[str] = frozenset()) -> DataFrame:
    """(path, field, value, code, message) of every definition for every document."""
    name = predicates.plain(predicates.field(F.col("metadata"), "title"))
    rows = files.select("path", "metadata", paths.title(name, F.col("path")).alias("title"))
    got = C.evaluate(rows, definitions, extra={"path": "path", "title": "title"}, unsupported=unsupported)
    return got.select("path", F.explode("computed").alias("field", "c")).select("path", "field", "c.value", "c.code", "c.message")


def _strata(definitions: list) -> list[list]:
    """Groups in order; what is left in cycles comes last, as one group of None."""
    left, out = list(definitions), []
    while left:
        open_ = {d.field for d in left}
        now = [d for d in left if d.target_field not in open_] or _selves(left)
        if not now:
            break
        out.append(now)
        left = [d for d in left if d not in now]
    return [*out, *([left] if left else [])]


def _selves(left: list) -> list:
    """Definitions that read their own field in other documents, once no other definition of that field is open."""
    return [d for d in left if d.target_field == d.field and all(x.target_field == x.field for x in left if x.field == d.field)]


def derive(files: DataFrame, related: DataFrame, definitions: list[Lookup | Rollup], formula_results: DataFrame | None = None) -> DataFrame:
    """All lookups and rollups. related: collection.relations(files)."""
    # only the fields that some definition reads are taken out of the metadata
    wanted = sorted({n for d in definitions for n in (d.relation, d.target_field)})
    each = let(F.try_parse_json("metadata"), lambda m: F.array(*(F.struct(F.lit(n).alias("field"), predicates.field_of(m, n).alias("value")) for n in wanted)))
    values = files.select("path", F.explode(each).alias("v")).select("path", "v.field", "v.value", F.lit(None).cast("string").alias("code")).where("value IS NOT NULL")
    if formula_results is not None:
        values = _over(values, formula_results.select("path", "field", "value", "code"))
    out, open_ = None, list(definitions)
    for group in _strata(definitions):
        parts = []
        for d in group:
            stuck = d.target_field != d.field and d.target_field in {x.field for x in open_}
            one = _lookup if isinstance(d, Lookup) else _rollup
            parts.append(_cyclic(files, d) if stuck else _by_levels(files, related, values, d, one) if d.target_field == d.field else one(files, related, values, d))
        one = parts[0]
        for p in parts[1:]:
            one = one.unionByName(p)
        values = _over(values, one.select("path", "field", "value", "code"))
        out = one if out is None else out.unionByName(one)
        open_ = [d for d in open_ if d not in group]
    return out


def _over(values: DataFrame, fresh: DataFrame) -> DataFrame:
    """Values with newer ones in place of older."""
    return values.join(fresh.select("path", "field").distinct(), ["path", "field"], "left_anti").unionByName(fresh)


def _result(rows: DataFrame, field: str, value: Column, code: Column) -> DataFrame:
    return rows.select("path", F.lit(field).alias("field"), F.when(code.isNull(), value).alias("value"), code.alias("code"), F.when(code.isNotNull(), F.concat(F.lit(f"{field}: "), code)).alias("message"))


def _cyclic(files: DataFrame, d) -> DataFrame:
    return _result(files.where(_owned(F.col("path"), d)).select("path"), d.field, F.lit(None).cast("string"), F.lit("dependency_cycle"))


def _by_levels(files: DataFrame, related: DataFrame, values: DataFrame, d, one) -> DataFrame:
    """A field that reads itself in other documents: those outside its scope are given, each round settles the owners whose targets are settled; owners that never settle wait for each other."""
    owners = files.where(_owned(F.col("path"), d)).select("path")
    read = values.where(F.col("field").isin(d.field, d.relation))
    given = scratch.saved(read.join(owners.withColumn("field", F.lit(d.field)), ["path", "field"], "left_anti"), "given")
    known, settled, late = given, -1, F.lit(False)
    for _ in range(MAX_DEPTH):
        found = scratch.saved(one(files, related, known, d), "level")
        good = found.where("code IS NULL").select("path", "field", "value", "code")
        n = good.count()
        if n == settled:
            break
        known, settled = given.unionByName(good), n
    else:
        # what the next round would settle lies deeper than the limit; what it wouldn't waits in a cycle
        more = one(files, related, known, d).where("code IS NULL").select("path").join(good.select("path"), "path", "left_anti")
        found = found.join(more.withColumn("late", F.lit(True)), "path", "left")
        late = F.coalesce("late", F.lit(False))
    waits = (F.col("code") == "target_field_missing") & F.col("waits")
    on = related.where(F.col("field") == d.relation).select("source", "target").join(owners.withColumnRenamed("path", "target"), "target", "left_semi").select(F.col("source").alias("path")).distinct()
    marked = found.join(on.withColumn("waits", F.lit(True)), "path", "left")
    return marked.withColumn("code", F.when(late, "dependency_limit").when(waits, "dependency_cycle").otherwise(F.col("code"))).select("path", "field", "value", "code", F.when(F.col("code").isNotNull(), F.concat(F.lit(f"{d.field}: "), "code")).alias("message"))


def _steps(related: DataFrame, values: DataFrame, d) -> DataFrame:
    """(source, pos, target, exists, value, code): each relation value with the target's field."""
    mine = related.where(F.col("field") == d.relation).drop("field")
    theirs = values.where(F.col("field") == d.target_field).select(F.col("path").alias("target"), F.col("value"), F.col("code"))
    return mine.join(theirs, "target", "left")


def _failure(x: Column, d) -> Column:
    return F.when(~x["exists"], "relation_unresolved").when(x["code"].isNotNull(), "dependency_failed").when(x["value"].isNull(), "target_field_missing")


def _declared(path: Column, d) -> Column:
    """The declared type of the relation's field for a document; null without one."""
    out = F.lit(None).cast("string")
    for scope, kind in sorted(d.relation_types, key=lambda x: len(x[0])):
        out = F.when(paths.in_scope(path, scope), F.lit(kind).cast("string")).otherwise(out)
    return out


def _not_a_relation(path: Column, value: Column, d) -> Column:
    """Whether the relation's field is declared as something else or, undeclared, holds something else."""
    from larkspur.operators import schema as S

    kind = _declared(path, d)
    other = (S.infer_type(value) != "Relation") & ~F.regexp_replace(value, r"\s", "").isin("[]", "null")
    return F.when(kind.isNotNull(), kind != "Relation").otherwise(F.coalesce(other, F.lit(False)))


def _lookup(files: DataFrame, related: DataFrame, values: DataFrame, d: Lookup) -> DataFrame:
    """A single value, or for a list relation the list in its order; null where the relation is absent."""
    own = values.where(F.col("field") == d.relation).select("path", F.col("value").alias("relation"))
    steps = _steps(related, values, d).groupBy(F.col("source").alias("path")).agg(F.array_sort(F.collect_list(F.struct("pos", "exists", "value", "code"))).alias("xs"))
    rows = files.where(_owned(F.col("path"), d)).select("path").join(own, "path", "left").join(steps, "path", "left")
    wanted = F.when(F.col("relation").startswith("["), F.size(F.from_json("relation", "array<variant>"))).otherwise(1)
    absent = F.col("relation").isNull() | (F.col("relation") == "null")
    bad = F.get(F.filter(F.transform("xs", lambda x: _failure(x, d)), lambda c: c.isNotNull()), F.lit(0))
    wrong = _not_a_relation(F.col("path"), F.col("relation"), d)
    code = F.when(wrong, "relation_field_type").when(absent, F.lit(None)).when(F.col("xs").isNull() & (wanted > 0), "invalid_relation").when(F.size("xs") < wanted, "invalid_relation").otherwise(bad)
    values_ = F.transform("xs", lambda x: x["value"])
    many = F.concat(F.lit("["), F.array_join(F.coalesce(values_, F.array().cast("array<string>")), ","), F.lit("]"))
    value = F.when(absent, "null").when(F.col("relation").startswith("["), many).otherwise(F.get(values_, F.lit(0)))
    return _result(rows, d.field, value, code)


def _rollup(files: DataFrame, related: DataFrame, values: DataFrame, d: Rollup) -> DataFrame:
    """Sums and counts are aggregates, which combine before the shuffle; other formulas get the list of values."""
    scope = files.where(_owned(F.col("path"), d)).select("path")
    if d.direction == "outgoing":
        each = _steps(related, values, d).select(F.col("source").alias("path"), F.col("pos").alias("at"), "value", F.struct("exists", "value", "code").alias("x"))
        each = each.withColumn("failure", _failure(F.col("x"), d)).drop("x")
        own = values.where(F.col("field") == d.relation).select("path", F.col("value").alias("relation"))
        wrong = F.when(_not_a_relation(F.col("path"), F.col("relation"), d), "relation_field_type")
        scope = scope.join(own, "path", "left").select("path", wrong.alias("blocked"))
    else:
        inside = related.where((F.col("field") == d.relation) & paths.in_scope(F.col("source"), d.relation_scope))
        # one bad relation in the scanned scope fails every owner: the first one by path says how
        raw = values.where((F.col("field") == d.relation) & paths.in_scope(F.col("path"), d.relation_scope) & (F.col("value") != "null"))
        items = F.when(F.col("value").startswith("["), F.size(F.from_json("value", "array<variant>"))).otherwise(1)
        seen = inside.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("seen"), F.bool_or(~F.col("exists")).alias("bad"))
        verdict = F.when(_not_a_relation(F.col("path"), F.col("value"), d), "relation_field_type").when(F.col("bad"), "relation_unresolved").when(items > F.coalesce("seen", F.lit(0)), "invalid_relation")
        failed = raw.join(seen, "path", "left").select("path", verdict.alias("verdict")).where("verdict IS NOT NULL")
        blocked = failed.agg(F.min_by("verdict", "path").alias("blocked")).withColumn("one", F.lit(1))  # one row
        mine = values.where(F.col("field") == d.target_field).select(F.col("path").alias("source"), "value", "code")
        failure = F.when(F.col("code").isNotNull(), "dependency_failed").when(F.col("value").isNull(), "target_field_missing")
        each = inside.select("source", "target").distinct().join(mine, "source", "left").select(F.col("target").alias("path"), F.col("source").alias("at"), "value", failure.alias("failure"))
        scope = scope.withColumn("one", F.lit(1)).join(F.broadcast(blocked), "one").drop("one")
    if not d.formula or not d.result_type:
        return _result(scope, d.field, F.lit(None).cast("string"), F.coalesce("blocked", F.lit("invalid_schema")))
    plain = d.formula.replace(" ", "")
    bad = F.min_by("failure", F.when(F.col("failure").isNotNull(), F.col("at"))).alias("failure")
    if plain in (LENGTH, SUM.replace(" ", "")):
        number = F.col("value").try_cast("decimal(38,10)")
        got = each.groupBy("path").agg(bad, F.count("*").alias("n"), F.sum(number).alias("total"), F.bool_or(~F.col("value").rlike("^-?[0-9]")).alias("odd"))
        rows = scope.join(got, "path", "left")
        failed = F.coalesce("blocked", "failure")
        if plain == LENGTH:
            return _result(rows, d.field, F.coalesce("n", F.lit(0)).cast("string"), failed)
        text = F.regexp_replace(F.regexp_replace(F.coalesce("total", F.lit(0)).cast("decimal(38,10)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        return _result(rows, d.field, text, F.coalesce(failed, F.when(F.col("odd"), "type_mismatch")))
    got = each.groupBy("path").agg(bad, F.array_sort(F.collect_list(F.struct("at", "value"))).alias("xs"))
    rows = scope.join(got, "path", "left").select("path", F.coalesce("blocked", "failure").alias("failed"), F.coalesce(F.transform("xs", lambda x: x["value"]), F.array().cast("array<string>")).alias("vs"))
    payload = F.concat(F.lit('{"values":['), F.array_join("vs", ","), F.lit("]}"))
    found = C.evaluate(rows.select("path", "failed", payload.alias("metadata")), [Definition(d.field, d.formula, d.result_type)])
    c = F.col("computed")[d.field]
    return _result(found, d.field, c["value"], F.coalesce("failed", c["code"]))


def fingerprints(files: DataFrame, definitions: list[Definition]) -> DataFrame:
    """(path, definition_fp, input_fp): what a stored result was worked out from."""
    return files.select("path", F.sha2(F.lit(C.definitions_json(definitions)), 256).alias("definition_fp"), F.sha2(F.coalesce("metadata", F.lit("")), 256).alias("input_fp"))


def stale(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents whose stored fingerprints differ or are missing; only these are worked out again."""
    return now.join(stored.select("path", "definition_fp", "input_fp"), ["path", "definition_fp", "input_fp"], "left_anti")


def run(files: DataFrame, related: DataFrame, definitions: list[Definition] | dict[str, list[Definition]], derived: list[Lookup | Rollup]) -> DataFrame | None:
    """Formulas first, then lookups and rollups over their results; formulas can't read the latter. definitions: for all documents, or by scope."""
    by_scope = definitions if isinstance(definitions, dict) else {"": definitions}
    first = scoped_formulas(files, by_scope, {s: frozenset(d.field for d in derived if not d.scope or s == d.scope or s.startswith(d.scope + "/")) for s in by_scope})
    if not derived:
        return first
    rest = derive(files, related, derived, first)
    return rest if first is None else first.unionByName(rest)
