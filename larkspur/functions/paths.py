"""Paths of documents: scopes, links, titles. Each rule once as a Column and, where rows are parsed in Python, once as a function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.let import let


def normalized(path: Column) -> Column:
    """Slashes only, no leading ./ and no trailing slash."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", ""), "/+$", "")


def scope_of(scope: str) -> str:
    """A scope in the same form; empty for the whole collection."""
    s = scope.replace("\\", "/")
    s = s.removeprefix("./").rstrip("/")
    return "" if s == "." else s


def in_scope(path: Column, scope: str) -> Column:
    """Whether a path is the scope or lies below it, by whole segments. On a plain column this reaches the Parquet scan."""
    s = scope_of(scope)
    return F.lit(True) if not s else (path == s) | path.startswith(s + "/")


def in_any_scope(path: Column, scopes: list[str]) -> Column:
    out = F.lit(False)
    for s in scopes:
        out = out | in_scope(path, s)
    return out


def below(path: Column, scope: str, recursive: bool) -> Column:
    """In scope and, unless recursive, a direct child of it."""
    s = scope_of(scope)
    rest = F.substring(path, len(s) + 2, 1 << 30) if s else path
    return in_scope(path, s) if recursive else in_scope(path, s) & (F.instr(rest, "/") == 0)


def components(path: Column) -> Column:
    return F.split(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def title(metadata_title: Column, path: Column) -> Column:
    """The non-blank title, or else the file's stem."""
    return F.coalesce(let(F.trim(metadata_title), lambda t: F.when(t != "", t)), stem(path))


def title_source(metadata_title: Column) -> Column:
    return F.when(F.length(F.trim(metadata_title)) > 0, "title").otherwise("stem")


def _folded(parts: Column) -> Column:
    """Path parts without . and with .. taken back."""
    empty = F.array().cast("array<string>")

    def step(acc, p):
        return F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(parts, empty, step)


def _joined(path: Column) -> Column:
    """A path without empty parts and . and with .. taken back; most have none of these."""
    return let(path, lambda p: F.when(~p.rlike(r"(?:^|/)\.{0,2}(?:/|$)"), p).otherwise(F.array_join(_folded(F.split(p, "/", -1)), "/")))


def with_md(path: Column) -> Column:
    return let(path, lambda p: F.when(p.endswith(".md"), p).otherwise(F.concat(p, F.lit(".md"))))


def _clean_target(target: Column) -> Column:
    return F.replace(F.regexp_replace(F.trim(target), "#.*$", ""), F.lit("\\"), F.lit("/"))


def resolve_link(source: Column, target: Column) -> Column:
    """The document that a body link names, seen from its source's folder; empty if the target is only a fragment."""

    def of(t):
        joined = F.when(t.startswith("/"), t).otherwise(F.concat_ws("/", parent(source), t))
        lead = F.when(t.startswith("/"), "/").otherwise("")
        return F.when(F.length(t) == 0, "").otherwise(with_md(F.concat(lead, _joined(joined))))

    return let(_clean_target(target), of)


def relation_candidates(source: Column, target: Column, folder: str | None = None) -> Column:
    """Documents that a relation may name, in order of preference: with a slash from the root, then from the source's folder; else in the declared folder, or else beside the source."""

    def of(t):
        root, beside = with_md(_joined(t)), resolve_link(source, t)
        near = F.array(with_md(F.concat(F.lit(folder.rstrip("/") + "/"), t))) if folder is not None else F.array(beside)
        return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.contains(t, F.lit("/")), F.array_distinct(F.array(root, beside))).otherwise(near)

    return let(F.regexp_replace(F.trim(_clean_target(target)), "^/+", ""), of)


def is_external(target: Column) -> Column:
    return target.rlike(r"^(?:https?://|mailto:|#)")


_WIKI = r"^\s*\[\[([^\[\]]+)\]\]\s*$"
_MD = r"^\s*\[([^\]]*)\]\(([^()]*)\)\s*$"
_BARE = r"^\s*(\S+\.md)\s*$"


def link_target(value: Column) -> Column:
    """The target of a value that is as a whole a link ([[target|text]], [text](target) or a bare path.md); null if it is none."""

    def of(v):
        wiki = F.trim(F.regexp_replace(F.regexp_extract(v, _WIKI, 1), r"(?s)\|.*$", ""))
        md = F.trim(F.regexp_extract(v, _MD, 2))
        return F.when(v.rlike(_WIKI), wiki).when(v.rlike(_MD), md).when(v.rlike(_BARE), F.regexp_extract(v, _BARE, 1))

    return let(let(value, of), lambda t: F.when((F.length(t) > 0) & ~is_external(t), t))


def link_kind(target: Column) -> Column:
    """relation for documents, file for other extensions."""

    def of(t):
        ext = F.lower(F.regexp_extract(F.regexp_replace(t, "#.*$", ""), r"[^/.][^/]*\.([^./]+)$", 1))
        return F.when(t.isNull(), F.lit(None)).when(ext.isin("", "md", "markdown"), "relation").otherwise("file")

    return let(target, of)


def relation_key(value: Column) -> Column:
    """What two spellings of a relation have in common; null if the value is no link."""
    t = F.regexp_replace(F.trim(_clean_target(link_target(value))), "^/+", "")
    return let(F.regexp_replace(t, r"\.md$", ""), lambda k: F.when(k != "", k))


def edge_id(source: Column, target: Column, line: Column, field: Column) -> Column:
    place = F.when(field.isNotNull(), F.concat(F.lit("fm."), field)).otherwise(line.cast("string"))
    return F.concat(F.lit("edge:"), source, F.lit("->"), target, F.lit("@"), place)
