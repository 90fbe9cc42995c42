"""Text as columns: hashes, tokens, terms, plain text of Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words of keyword extraction.
STOP_WORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by "
    "can can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further get got had hadn't "
    "has hasn't have haven't having he her here hers herself him himself his how i if in into is isn't it its itself just let like ll "
    "me might more most must mustn't my myself no nor not now of off on once only or other our ours ourselves out over own re s same "
    "shall shan't she should shouldn't so some such t than that the their theirs them themselves then there these they this those "
    "through to too under until up us ve very was wasn't we were weren't what when where which while who whom why will with won't "
    "would wouldn't you your yours yourself yourselves"
).split()


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def is_keyword(token: Column) -> Column:
    """At least three bytes and no stop word."""
    return (F.octet_length(token) >= 3) & ~token.isin(*STOP_WORDS)


def terms(text: Column) -> Column:
    """Keywords, and pairs of keywords that are neighbours in the text."""
    t = tokens(text)
    pairs = F.zip_with(t, F.concat(F.slice(t, 2, F.greatest(F.size(t), F.lit(1))), F.array(F.lit(""))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    each = F.transform(
        F.filter(pairs, lambda p: is_keyword(p["a"])),
        lambda p: F.when(is_keyword(p["b"]), F.array(p["a"], F.concat_ws(" ", p["a"], p["b"]))).otherwise(F.array(p["a"])),
    )
    return F.flatten(each)


def plain(markdown: Column) -> Column:
    """Markdown without its marks: text and code stay, breaks become spaces."""
    out = markdown
    for pattern, to in (
        (r"(?m)^\s{0,3}(?:```|~~~).*$", " "), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[\[(?:[^\]|]*\|)?([^\]]+)\]\]", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(?m)^\s{0,3}#{1,6}\s+", ""), (r"(?m)^\s{0,3}(?:>|[-*+]\s|\d+[.)]\s)\s*", ""), (r"(\*\*|__|\*|~~|`)(\S(?:.*?\S)?)\1", "$2"), (r"(?m)^\s{0,3}(?:[-*_]\s*){3,}$", ""), (r"\s+", " "),
    ):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def smoothed_idf(n: Column, df: Column) -> Column:
    return F.ln((1 + n) / (1 + df)) + 1
