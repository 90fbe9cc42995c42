"""Formulas as Columns and over frames.

`column` turns a formula into one Spark expression where built-in functions give the
same result: bounded-scale arithmetic, comparisons, logic, conditionals, templates and
the plain text, list and Math functions. `evaluate` runs any formulas, row by row in
Arrow batches, and returns value, code and message for each.
"""

from __future__ import annotations

import json
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.formula.compiler import Definition, Program
from larkspur.functions.formula.syntax import Limits, Node, parse
from larkspur.functions.formula.values import from_json


class Unsupported(Exception):
    """This formula needs evaluate()."""



_TEXT = {
    "trim": lambda s: F.trim(s), "trimStart": lambda s: F.ltrim(s), "trimEnd": lambda s: F.rtrim(s), "toUpperCase": lambda s: F.upper(s), "toLowerCase": lambda s: F.lower(s),
    "includes": lambda s, x: F.contains(s, x), "startsWith": lambda s, x: F.startswith(s, x), "endsWith": lambda s, x: F.endswith(s, x), "indexOf": lambda s, x: (F.instr(s, x) - 1),
    "concat": lambda s, *x: F.concat(s, *x), "repeat": lambda s, n: F.repeat(s, n), "charAt": lambda s, i: F.substr(s, i + 1, F.lit(1)),
    "slice": lambda s, a, b=None: _cut(s, a, b), "padStart": lambda s, n, p=None: F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, p if p is not None else F.lit(" "))),
    "padEnd": lambda s, n, p=None: F.when(F.length(s) >= n, s).otherwise(F.rpad(s, n, p if p is not None else F.lit(" "))), "split": lambda s, x: F.split(s, F.concat(F.lit(r"\Q"), x, F.lit(r"\E")), F.lit(-1)),
}
_MATH = {
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": lambda x: F.floor(x + F.lit(Decimal("0.5"))), "sign": F.signum,
    "min": lambda *x: F.least(*x) if len(x) > 1 else x[0], "max": lambda *x: F.greatest(*x) if len(x) > 1 else x[0],
}
_LISTS = {"join": lambda v, by=None: F.array_join(v, ",") if by is None else F.call_function("array_join", v, by), "includes": F.array_contains, "flat": lambda v: F.flatten(v)}


def _cut(s: Column, a: Column, b: Column | None) -> Column:
    n = F.length(s)
    start = F.when(a < 0, F.greatest(n + a, F.lit(0))).otherwise(F.least(a, n))
    end = n if b is None else F.when(b < 0, F.greatest(n + b, F.lit(0))).otherwise(F.least(b, n))
    return F.substr(s, start + 1, F.greatest(end - start, F.lit(0)))


def column(source: str, names: dict[str, Column], lists: frozenset[str] = frozenset(), limits: Limits = Limits()) -> Column:
    """One expression; names gives each field's Column, `lists` those that are arrays."""
    return _build(parse(source, limits).tree, names, lists)


def _is_list(node: Node, lists: frozenset[str]) -> bool:
    return node.kind == "list" or (node.kind == "name" and node.value in lists) or (node.kind == "method" and node.value[0] in ("map", "filter", "flat", "split", "slice") and (node.value[0] == "split" or _is_list(node.parts[0], lists)))


def _build(node: Node, names: dict[str, Column], lists: frozenset[str]) -> Column:
    go = lambda n: _build(n, names, lists)
    k = node.kind
    if k in ("number", "text", "bool"):
        v = node.value
        return F.lit(int(v) if isinstance(v, Decimal) and v == v.to_integral_value() and abs(v) < 1 << 31 else v)
    if k == "null":
        return F.lit(None)
    if k == "name" and node.value in names:
        return names[node.value]
    if k == "get" and node.parts[1].kind == "text":
        owner, key = node.parts[0], node.parts[1].value
        if owner.kind == "name" and owner.value == "fields" and key in names:
            return names[key]
        if key == "length":
            return F.size(go(owner)) if _is_list(owner, lists) else F.length(go(owner))
    if k == "unary" and node.value in "!-":
        return ~go(node.parts[0]) if node.value == "!" else -go(node.parts[0])
    if k == "if":
        return F.when(go(node.parts[0]), go(node.parts[1])).otherwise(go(node.parts[2]))
    if k == "logic":
        a, b = map(go, node.parts)
        return a & b if node.value == "&&" else a | b if node.value == "||" else F.coalesce(a, b)
    if k == "binary":
        a, b = map(go, node.parts)
        op = node.value
        if op == "+" and any(_texty(p) for p in node.parts):
            return F.concat(a.cast("string"), b.cast("string"))
        plain = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "===": lambda: a.eqNullSafe(b), "!==": lambda: ~a.eqNullSafe(b), "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}
        if op in plain:
            return plain[op]()
    if k == "template":
        return F.concat(*(go(p).cast("string") for p in node.parts))
    if k == "list":
        return F.array(*map(go, node.parts))
    if k == "static" and node.value[0] == "Math" and node.value[1] in _MATH:
        return _MATH[node.value[1]](*map(go, node.parts))
    if k == "global" and node.value == "String":
        return go(node.parts[0]).cast("string")
    if k == "method":
        return _method(node, names, lists, go)
    raise Unsupported(f"{k} at {node.at}")


def _texty(node: Node) -> bool:
    return node.kind in ("text", "template") or (node.kind == "binary" and node.value == "+" and any(map(_texty, node.parts))) or (node.kind == "method" and node.value[0] in _TEXT and node.value[0] not in ("includes", "startsWith", "endsWith", "indexOf", "split"))


def _method(node: Node, names: dict[str, Column], lists: frozenset[str], go) -> Column:
    name, (owner, *args) = node.value[0], node.parts
    v = go(owner)
    if not args or args[0].kind != "arrow":
        table = _LISTS if _is_list(owner, lists) else _TEXT
        if name == "test" and owner.kind == "regex":
            flags = "".join(f for f in owner.value[1] if f in "ims")
            return go(args[0]).rlike(f"(?{flags}){owner.value[0]}" if flags else owner.value[0])
        if name == "replace" and args[0].kind == "regex" and "g" in args[0].value[1] and args[1].kind == "text" and "$" not in args[1].value:
            return F.regexp_replace(v, args[0].value[0], args[1].value.replace("\\", "\\\\"))
        if name in table and not any(a.kind == "regex" for a in args):
            return table[name](v, *map(go, args))
        raise Unsupported(name)
    params, body = args[0].value, args[0].parts[0]
    if name == "reduce" and len(args) == 2:
        start = go(args[1])
        return F.aggregate(v, start.cast("decimal(38,10)") if args[1].kind == "number" else start, lambda acc, x: _cast_like(_build(body, names | dict(zip(params, (acc, x), strict=False)), lists), args[1]))
    if len(params) == 1 and name in ("map", "filter", "some", "every"):
        f = {"map": F.transform, "filter": F.filter, "some": F.exists, "every": F.forall}[name]
        return f(v, lambda x: _build(body, names | {params[0]: x}, lists))
    raise Unsupported(name)


def _cast_like(c: Column, start: Node) -> Column:
    return c.cast("decimal(38,10)") if start.kind == "number" else c


RESULT = "map<string,struct<value:string,code:string,message:string>>"


def evaluate(rows: DataFrame, definitions: list[Definition], metadata: str = "metadata", extra: dict[str, str] | None = None, limits: Limits = Limits(), unsupported: frozenset[str] = frozenset()) -> DataFrame:
    """The rows with `computed`: by name, value (JSON), code and message. metadata: a JSON column with the fields; extra: names of further text columns, such as path and title. Rows never fail."""
    extra = extra or {}
    out_schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, computed {RESULT}"
    kinds = pa.map_(pa.string(), pa.struct([("value", pa.string()), ("code", pa.string()), ("message", pa.string())]))

    def run(batches):
        program = Program(definitions, limits, unsupported)
        for batch in batches:
            found = []
            others = {n: batch.column(c).to_pylist() for n, c in extra.items()}
            for i, raw in enumerate(batch.column(metadata).to_pylist()):
                row = from_json(raw) if raw else {}
                row = dict(row) if isinstance(row, dict) else {}
                result = program.run(row | {n: v[i] for n, v in others.items()})
                found.append([(n, {"value": v, "code": c, "message": m}) for n, (v, c, m) in sorted(result.items())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kinds)], names=[*batch.schema.names, "computed"])

    return rows.mapInArrow(run, out_schema)


def definitions_json(definitions: list[Definition]) -> str:
    """Their fingerprint's source: sorted, compact."""
    return json.dumps([[d.name, d.formula, d.result] for d in sorted(definitions, key=lambda d: d.name)], separators=(",", ":"))
