"""Line dedup by deletion neighbourhoods, in DataFrame functions only.

A line is removed if a line that stands earlier in the corpus, by document id and
then by place, is equal to it or, where both have at least `min_chars` characters, at
most one edit (a character inserted, deleted or replaced) away. Blank lines of fewer
characters stay: they only part paragraphs.

Two lines one edit apart become equal when a piece around the edit is deleted from
both. Such variants are emitted as hashed keys from coarse to fine, each level only
for lines that share a key of the level before:

1. one half of the line deleted,
2. one eighth of that half deleted,
3. one character of that eighth deleted: the deletion neighbourhood proper. A key
   says where a character was replaced; where one was inserted it joins a line to
   those that reach it by one deletion. So all lines of a key are true
   neighbours of its earliest, and the earliest comes from one aggregate: no pairs
   of a group are listed, however many lines share a key.

The earliest neighbour is then verified by its edit distance. Equal lines, told by two
64-bit hashes, are one class throughout, so a line that stands in a third of all
documents is one row after the first aggregate. What is aggregated is written before it
is joined again, so that both sides are shuffled for the join and hot keys are split.

Null text has no lines. A null id counts as the least. Rows with one id are one
document: lines at the same place don't count against each other. Very long lines and
texts are treated like others. An empty table gives no rows. Columns other than id and
text, whatever their names, are ignored or passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import shared

MIN_CHARS, EIGHTHS = 20, 8
_LEAST = -(1 << 63)
_WORD = r"[^\x20\x09-\x0D]"


def _place(doc_id: Column, no: Column) -> Column:
    """Order of lines in the corpus as one number, which hash aggregates can hold."""
    return (F.coalesce(doc_id, F.lit(_LEAST)).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + no.cast("decimal(10,0)")).cast("decimal(33,0)")


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    every = docs.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    long = F.length("line") >= min_chars
    every = every.where(long | F.col("line").rlike(_WORD))
    return every.select("doc_id", "text_hash", "no", "line", long.alias("long"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), _place(F.col("doc_id"), F.col("no")).alias("at"))


def _halves() -> list[Column]:
    """Keys of the line with its second half deleted, and with its first; as a line of its own length and as one with a character too many."""
    out = []
    for less in (0, 1):
        size = F.length("line") - less
        half = F.floor(size / 2).cast("int")
        out += [F.xxhash64(F.lit(side), size, part(F.col("line"), half)) for side, part in ((0, F.left), (1, F.right))]
    return out


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose key another line has too."""
    twice = rows.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select("key")
    return rows.join(shared.saved(twice, "lines"), "key", "left_semi")


def _eighths(lines: DataFrame) -> DataFrame:
    """(h, first, key, extra, local): for each half that is shared, the other one's eighths; `local` is the deleted piece, `extra` whether it has a character too many."""
    codes = F.filter(F.array(*map(F.lit, range(4))), lambda c: F.get(F.col("codes"), c))
    pieces = F.flatten(F.transform(codes, lambda c: F.transform(F.sequence(F.lit(0), F.lit(EIGHTHS - 1)), lambda j: F.struct(c.alias("code"), j.alias("j")))))
    each = lines.withColumn("piece", F.explode(pieces)).withColumn("extra", (F.col("piece.code") >= 2).cast("int"))
    each = each.withColumn("size", F.length("line") - F.col("extra")).withColumn("half", F.floor(F.col("size") / 2).cast("int"))
    low = F.when(F.col("piece.code") % 2 == 0, F.col("half")).otherwise(0)
    width = F.col("size") - F.col("half")
    for name, j in (("a", F.col("piece.j")), ("b", F.col("piece.j") + 1)):
        each = each.withColumn(name, (low + F.floor(j * width / EIGHTHS)).cast("int"))
    key = F.xxhash64("size", "a", "b", F.left("line", F.col("a")), F.right("line", F.col("size") - F.col("b")))
    return each.select("h", "first", key.alias("key"), "extra", F.substring("line", F.col("a") + 1, F.col("b") - F.col("a") + F.col("extra")).alias("local"))


def _deletions(pieces: DataFrame) -> DataFrame:
    """(key, role, h, first): role 0 replaced at a place, 1 the piece as it is, 2 a character deleted."""
    n = F.length("local")
    without = lambda i: F.concat(F.left("local", i - 1), F.right("local", n - i))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    replaced = F.transform(places, lambda i: F.struct(F.lit(0).alias("role"), F.xxhash64("key", F.lit(0), i, without(i)).alias("key")))
    whole = F.array(F.struct(F.lit(1).alias("role"), F.xxhash64("key", F.lit(1), F.col("local")).alias("key")))
    deleted = F.transform(places, lambda i: F.struct(F.lit(2).alias("role"), F.xxhash64("key", F.lit(1), without(i)).alias("key")))
    variants = F.when(F.col("extra") == 0, F.concat(replaced, whole)).otherwise(deleted)
    return pieces.select("h", "first", F.explode(variants).alias("v")).select("v.key", "v.role", "h", "first")


def _neighbours(lines: DataFrame) -> DataFrame:
    """(h, h2, earlier): for lines with a neighbour that comes earlier, the place of the earliest."""
    found = _deletions(_shared(_eighths(lines)))
    least = [F.min(F.when(F.col("role") == r, F.col("first"))).alias(n) for r, n in ((0, "replaced"), (1, "whole"), (2, "deleted"))]
    met = found.groupBy("key").agg(*least, F.count("*").alias("n")).where("n > 1").drop("n")
    met = shared.saved(met, "lines")
    other = F.when(F.col("role") == 0, F.col("replaced")).when(F.col("role") == 1, F.col("deleted")).otherwise(F.col("whole"))
    earliest = found.join(met, "key").select("h", "first", other.alias("earlier")).where("earlier < first").groupBy("h").agg(F.min("earlier").alias("earlier"))
    mine = lines.select("h", "h2", "line")
    theirs = lines.select(F.col("first").alias("earlier"), F.col("line").alias("other"))
    return earliest.join(mine, "h").join(theirs, "earlier").where(F.levenshtein("line", "other", 1) >= 0).select("h", "h2", "earlier")


def removals(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(of, of_text, lines, near): by document, the numbers of its removed lines, and how many of those weren't exact repeats. docs: doc_id, text, text_hash."""
    lines = _lines(docs, min_chars)
    keys = [F.when(F.col("long"), k).alias(f"k{i}") for i, k in enumerate(_halves())]
    classes = lines.select("h", "h2", "at", *keys).groupBy("h", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n"), *(F.min(f"k{i}").alias(f"k{i}") for i in range(4)))
    classes = shared.saved(classes, "lines")
    halves = classes.where("k0 IS NOT NULL").select("h", F.posexplode(F.array(*(F.col(f"k{i}") for i in range(4)))).alias("code", "key"))
    codes = _shared(halves).groupBy("h").agg(*(F.max(F.col("code") == c).alias(f"c{c}") for c in range(4)))
    wanted = codes.join(classes.where("k0 IS NOT NULL").select("h", "h2", "first"), "h").select("h", "h2", "first", F.array(*(F.col(f"c{c}") for c in range(4))).alias("codes"))
    # both sides of these joins grow with the corpus, so they are shuffled at every size
    wanted = shared.saved(wanted, "lines").hint("merge")
    texts = shared.saved(lines.select("h", "h2", "at", "line").join(wanted, ["h", "h2"]).where("at = first").dropDuplicates(["h"]).select("h", "h2", "first", "codes", "line"), "lines")
    best = classes.select("h", "h2", "first", "n").join(_neighbours(texts), ["h", "h2"], "left").where("n > 1 OR earlier IS NOT NULL").select("h", "h2", "first", F.coalesce(F.least("first", "earlier"), F.col("first")).alias("best"))
    best = shared.saved(best, "lines").hint("merge")
    gone = lines.select("doc_id", "text_hash", "no", "h", "h2", "at").join(best, ["h", "h2"]).where("best < at")
    return gone.groupBy(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_text")).agg(F.array_sort(F.collect_set("no")).alias("lines"), F.collect_set(F.when(F.col("first") == F.col("at"), F.col("no"))).alias("near")).withColumn("near", F.size("near"))


def assess(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: n_lines, n_removed, n_near (removed without an exact repeat before), removed (line numbers from 0, comma-joined)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    gone = removals(src, min_chars)
    each = src.select("doc_id", "text_hash", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines"))
    out = each.join(gone, each.doc_id.eqNullSafe(gone.of) & (each.text_hash == gone.of_text), "left")
    removed = F.coalesce(F.array_join("lines", ","), F.lit(""))
    return out.select("doc_id", F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), removed.alias("removed"))


def remove(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the removed lines; all columns and rows stay."""
    key = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    gone = removals(key, min_chars)
    out = docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["of"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["of_text"]), "left")
    kept = F.array_join(F.filter(F.split(docs[text_col], "\n", -1), lambda line, i: ~F.array_contains(gone["lines"], i)), "\n")
    return out.select(*(F.when(gone["lines"].isNotNull(), kept).otherwise(docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns))


#: DuckDB SQL for assess() over `documents`.
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(s))) AS no, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)
), l AS (SELECT doc_id, no, line, doc_id::HUGEINT * 4294967296 + no AS pos FROM lines
  WHERE length(line) >= {MIN_CHARS} OR regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), d AS (SELECT line, min(pos) AS first, length(line) AS n FROM l GROUP BY line
), k AS (
  SELECT line, first, n, unnest([
    'p' || n || ' ' || left(line, n // 2), 's' || n || ' ' || right(line, n // 2),
    'p' || (n - 1) || ' ' || left(line, (n - 1) // 2), 's' || (n - 1) || ' ' || right(line, (n - 1) // 2)]) AS key FROM d WHERE n >= {MIN_CHARS}
), pairs AS (
  SELECT DISTINCT a.line AS line, a.n AS n, b.line AS other, b.n AS m, b.first AS earlier FROM k a JOIN k b ON a.key = b.key AND b.first < a.first WHERE abs(a.n - b.n) <= 1
), near AS (
  SELECT line, min(earlier) AS earlier FROM pairs WHERE len(list_filter(range(0, greatest(n, m)),
    lambda i: left(line, i) = left(other, i) AND CASE WHEN n = m THEN right(line, n - i - 1) = right(other, n - i - 1)
         WHEN n < m THEN right(line, n - i) = right(other, n - i) ELSE right(line, m - i) = right(other, m - i) END)) > 0 GROUP BY line
), gone AS (
  SELECT l.doc_id, l.no, d.first = l.pos AS only_near FROM l JOIN d USING (line) LEFT JOIN near USING (line) WHERE least(d.first, coalesce(near.earlier, d.first)) < l.pos
), g AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (only_near) AS n_near, string_agg(no::VARCHAR, ',' ORDER BY no) AS removed FROM gone GROUP BY doc_id)
SELECT t.doc_id, coalesce(len(string_split(t.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(g.n_removed, 0)::BIGINT AS n_removed, coalesce(g.n_near, 0)::BIGINT AS n_near, coalesce(g.removed, '') AS removed
FROM documents t LEFT JOIN g USING (doc_id)
"""
