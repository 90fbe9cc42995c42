"""Metadata filters over JSON: Equals, In, Range and Exists, and their parser.

A value is looked at as its JSON text and kind, so that 1 and "1" stay different and
numbers compare as exact decimals. Filters on fields that are columns of their own
should be written as plain predicates instead: those reach the scan.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions import paths
from larkspur.functions.let import let


@dataclass(frozen=True)
class Equals:
    field: str
    value: object


@dataclass(frozen=True)
class In:
    field: str
    values: tuple


@dataclass(frozen=True)
class Range:
    field: str
    min: object = None
    max: object = None


@dataclass(frozen=True)
class Exists:
    field: str


Filter = Equals | In | Range | Exists


def parse(text: str) -> Equals:
    """KEY=VALUE; the value is a boolean, a number or else text."""
    key, eq, raw = text.partition("=")
    if not eq or not key.strip():
        raise ValueError(f"a filter is KEY=VALUE, not {text!r}")
    if raw in ("true", "false"):
        return Equals(key.strip(), raw == "true")
    if re.fullmatch(r"-?\d+", raw):
        return Equals(key.strip(), int(raw))
    try:
        return Equals(key.strip(), Decimal(raw) if re.fullmatch(r"-?\d+\.\d+(?:[eE][+-]?\d+)?", raw) else raw)
    except InvalidOperation:
        return Equals(key.strip(), raw)


def field(metadata: Column, name: str) -> Column:
    """JSON text of a top-level field; SQL null if it is missing, the text null if it is null."""
    return field_of(F.try_parse_json(metadata), name)


def field_of(parsed: Column, name: str) -> Column:
    """The same of metadata that is parsed already, for several fields of one document."""
    safe = name.replace("\\", "\\\\").replace("'", "\\'")
    return let(F.try_variant_get(parsed, f"$['{safe}']", "variant"), lambda v: F.when(F.is_variant_null(v), "null").otherwise(F.to_json(v)))


def plain(value: Column) -> Column:
    """Text of a JSON value: strings without quotes, others as JSON."""
    return let(value, lambda v: F.when(v.startswith('"'), F.get_json_object(F.concat(F.lit("["), v, F.lit("]")), "$[0]")).otherwise(v))


def decimal(value: Column) -> Column:
    """Exact number of a JSON number; null for other values."""
    return let(value, lambda v: F.when(v.rlike(r"^-?[0-9]"), v.try_cast("decimal(38,18)")))


def _text(value: object) -> str:
    return str(value) if isinstance(value, Decimal) else json.dumps(value, ensure_ascii=False)


def _same(value: Column, wanted: tuple) -> Column:
    """Whether a value is one of those wanted. Its key as a relation is worked out once for all of them, and only for a text that is none of them as it stands."""
    same = F.coalesce(value.isin(*map(_text, wanted)), F.lit(False))
    texts = [w for w in wanted if isinstance(w, str)]
    if not texts:
        return same
    keys = [F.coalesce(paths.relation_key(F.lit(w)), F.lit(w.removesuffix(".md"))) for w in texts]
    linked = F.when(value.startswith('"'), let(paths.relation_key(plain(value)), lambda key: key.isin(*keys)))
    return F.when(same, True).otherwise(F.coalesce(linked, F.lit(False)))


def _items(value: Column) -> Column:
    """Elements of a JSON array as JSON texts."""
    each = F.from_json(value, "array<variant>")
    return F.transform(each, lambda v: F.coalesce(F.to_json(v), F.lit("null")))


def _any(value: Column, wanted: tuple) -> Column:
    """Whether a value, or an item of a list, is one of those wanted."""
    each = let(value, lambda v: F.when(v.startswith("["), _items(v)).otherwise(F.array(v)))
    return F.coalesce(F.exists(each, lambda v: _same(v, wanted)), F.lit(False))


def _bound(value: Column, bound: object, low: bool) -> Column:
    number = isinstance(bound, (int, float, Decimal)) and not isinstance(bound, bool)
    other = F.lit(bound if isinstance(bound, str) else _text(bound))
    as_text = plain(value) >= other if low else plain(value) <= other
    if not number:
        return as_text
    edge = F.lit(str(bound)).cast("decimal(38,18)")
    return let(decimal(value), lambda exact: F.when(exact.isNotNull(), exact >= edge if low else exact <= edge).otherwise(as_text))


def condition(metadata: Column, one: Filter) -> Column:
    value = field(metadata, one.field)
    if isinstance(one, Exists):
        out = let(value, lambda v: v.isNotNull() & (v != "null"))
    elif isinstance(one, Equals):
        out = _any(value, (one.value,))
    elif isinstance(one, In):
        out = _any(value, tuple(one.values)) if one.values else F.lit(False)
    else:

        def within(v):
            out = v.isNotNull()
            if one.min is not None:
                out = out & _bound(v, one.min, True)
            if one.max is not None:
                out = out & _bound(v, one.max, False)
            return out

        out = let(value, within)
    return F.coalesce(out, F.lit(False))


def conjunction(metadata: Column, filters: list[Filter]) -> Column:
    """All filters hold; without filters everything passes, without metadata nothing else does."""
    out = F.lit(True)
    for one in filters:
        out = out & condition(metadata, one)
    return out
