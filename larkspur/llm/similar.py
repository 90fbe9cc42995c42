"""Near-duplicates by the similarity of their shingles: SimHash candidates, then MinHash ones for the rest, each verified exactly.

Two documents link if the Jaccard similarity of their sets of five-word shingles
(lower case; a shorter text is one shingle) is `least` or more; the result is each
document's connected component. Documents with equal sets are one class,
represented once; nothing links without its sets being compared.

First come SimHash fingerprints of the sets, linked at DISTANCE or fewer bits by the
parts and thresholds of `simhash`. Each is verified with the nearest of its links and
the nearest of those to smaller fingerprints, and with those equal to it, so a dense
group gives no more pairs than twice its members.

Fingerprints can't meet all pairs: at 0.8 the mean distance is about 8 bits. So each
class also gets BANDS keys of ROWS least hashes. Classes that share a key are candidates,
and a pair at 0.8 shares none with a chance of (1 - 0.8 ** 5) ** 50 = 2e-9. In each bucket
of a key that the fingerprints' links haven't joined into one component, all other
components' classes are compared with the least class first, then, where that leaves
several components, with one chosen by a hash of class and key, so that a class meets
another hub in each of its buckets. What is still apart is compared in full, bucket by
bucket: a worker gets the sets of a bucket (of two pieces of it, if it is large), counts
what the sets of different components share by products of incidence matrices, and gives
the links that join them. No pairs of a bucket are listed.

Null and empty texts are one class. Null ids, repeated rows, other columns and empty
tables are treated as in `simhash`; a very long text is hashed whole.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import shared, simhash
from larkspur.llm import textkit as T
from larkspur.llm.components import components

SHINGLE, LEAST, ROWS, BANDS = 5, "0.8", 5, 50
#: Bits at which fingerprints are candidates; probes and shuffle grow steeply with it.
DISTANCE = 6
#: Shingles hashed at once, so that they stay in the processor's cache.
STEP = 1 << 15
#: Bytes of text that a worker takes at once.
CHUNK = 1 << 20
#: Classes of a bucket that one task compares with as many others, and cells of its incidence matrix.
PIECE, CELLS = 2000, 1 << 21
_ODD = T.mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles end to end, and where each text's start (one more at the end)."""
    w = T.words(texts, lower=True)
    hashes, inside = T.windows(w, shingle)
    parts, docs = [hashes[inside]], [w.doc[: len(hashes)][inside]]
    for size in range(1, shingle):
        of = np.flatnonzero(w.per_doc == size)
        if len(of):
            parts.append(T.windows(w, size)[0][w.first[of]])
            docs.append(of)
    h, doc = np.concatenate(parts), np.concatenate(docs).astype(np.int64)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def class_ids(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set; zero for an empty one."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = T.mix(np.add.reduceat(T.mix(h), bounds[full]) ^ T.mix(np.diff(bounds)[full].astype(np.uint64)))
    return out


def band_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """BANDS keys of each set that isn't empty, a row for each."""
    full = np.flatnonzero(np.diff(bounds))
    least = np.zeros((len(full), ROWS * BANDS), np.uint64)
    groups = np.split(np.arange(len(full)), np.flatnonzero(np.diff(bounds[full] // STEP)) + 1) if len(full) else []
    for g in groups:
        low, high = bounds[full[g[0]]], bounds[full[g[-1]] + 1]
        part, at = h[low:high], bounds[full[g]] - low
        for k, odd in enumerate(_ODD):
            least[g, k] = np.minimum.reduceat(part * odd, at)
    keys = np.broadcast_to(T.mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(full), BANDS)).copy()
    for r in range(ROWS):
        keys = T.mix(keys ^ least[:, r::ROWS])
    return keys


def _prints(batches):
    for part, texts in T.chunks(batches, limit=CHUNK):
        h, bounds = shingle_sets(texts)
        size = np.diff(bounds)
        keys = band_keys(h, bounds).view(np.int64)
        of = np.concatenate([[0], np.cumsum((size > 0) * BANDS)]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(of), pa.array(keys.ravel()))
        fp = pa.array(simhash.majority(h, bounds).view(np.int64))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(class_ids(h, bounds).view(np.int64)), pa.array(size.astype(np.int64)), fp, listed], names=["doc_id", "text_hash", "class", "size", "print", "keys"])


def _sets(batches):
    for part, texts in T.chunks(batches, limit=CHUNK):
        h, bounds = shingle_sets(texts)
        yield pa.RecordBatch.from_arrays([part.column("class"), pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))], names=["class", "grams"])


def _sets_of(met: DataFrame, src: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, grams) of the classes in a one-column frame."""
    chosen = classes.join(met.distinct(), "class").select("class", "at.id", "at.hash")
    texts = src.join(chosen, (src.key_id == chosen.id) & (src.text_hash == chosen.hash)).select("class", "text").dropDuplicates(["class"])
    return shared.saved(texts.mapInArrow(T.tidied(_sets), "class long, grams array<long>"), "sets")


def _verified(pairs: DataFrame, src: DataFrame, classes: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    pairs = shared.saved(pairs.distinct(), "pairs")
    sets = _sets_of(pairs.select(F.col("a").alias("class")).union(pairs.select("b")), src, classes)
    a, b = (sets.select(F.col("class").alias(x), F.col("grams").alias(f"{x}_grams")) for x in "ab")
    both = F.size(F.array_intersect("a_grams", "b_grams"))
    ok = both * least.denominator >= (F.size("a_grams") + F.size("b_grams") - both) * least.numerator
    return shared.saved(pairs.join(a, "a").join(b, "b").where(ok).select("a", "b"), "near")


def _apart(met: DataFrame, found: DataFrame) -> DataFrame:
    """(key, class, size, root) of the buckets whose classes the links haven't joined into one component."""
    roots = components(found)
    rows = shared.saved(met.select("key", "class", "size").join(roots, met["class"] == roots.node, "left").select("key", "class", "size", F.coalesce("root", "class").alias("root")), "met")
    open_ = shared.saved(rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).where("a != b").select("key", "n"), "open")
    return shared.saved(rows.join(open_, "key"), "apart")


def shared_counts(bounds: np.ndarray, grams: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many grams each of some sets (by number) shares with every set."""
    n = len(bounds) - 1
    member = np.repeat(np.arange(n), np.diff(bounds))
    unique, column, times = np.unique(grams, return_inverse=True, return_counts=True)
    useful = times[column] > 1
    number = np.cumsum(times > 1) - 1
    column, member, width = number[column[useful]], member[useful], int((times > 1).sum())
    out = np.zeros((len(rows), n), np.float32)
    step = max(1, CELLS // max(1, n))
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    for low in range(0, width, step):
        part = slice(*np.searchsorted(column, [low, low + step]))
        matrix = np.zeros((n, min(step, width - low)), np.float32)
        matrix[member[part], column[part] - low] = 1
        out += matrix[rows] @ matrix.T
    return out.astype(np.int64)


def join_apart(ids: np.ndarray, roots: np.ndarray, bounds: np.ndarray, grams: np.ndarray, least: Fraction, other: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the components of a bucket as all its similar pairs do. other: whether a class is of the second piece; then only pairs across pieces count."""
    size = np.diff(bounds)
    names, label = np.unique(roots, return_inverse=True)
    rest = np.flatnonzero(label != np.argmax(np.bincount(label)))  # every pair of components has a member here, but for the largest alone
    links = []
    for at in range(0, len(rest), 256):
        rows = rest[at : at + 256]
        both = shared_counts(bounds, grams, rows)
        ok = both * least.denominator >= (size[rows][:, None] + size[None, :] - both) * least.numerator
        if other is not None:
            ok &= other[rows][:, None] != other[None, :]
        for i, near in zip(rows.tolist(), ok, strict=True):
            met = np.flatnonzero(near & (label != label[i]))
            for group, first in zip(*np.unique(label[met], return_index=True), strict=True):
                links.append((int(ids[i]), int(ids[met[first]])))
                label[label == group] = label[i]
    return links


def _rest(apart: DataFrame, src: DataFrame, classes: DataFrame, least: Fraction) -> DataFrame:
    """The links of what is still apart, bucket by bucket."""
    sets = _sets_of(apart.select("class"), src, classes)
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    mine = F.pmod(F.xxhash64("class"), pieces).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), pieces - 1), lambda j: F.struct(F.least(mine, j).alias("x"), F.greatest(mine, j).alias("y")))
    dealt = apart.select("key", "class", "root", mine.alias("piece"), F.explode(pairs).alias("p")).select("key", "class", "root", "piece", "p.x", "p.y")

    def run(table):
        grams = table.column("grams").combine_chunks()
        bounds, x = grams.offsets.to_numpy().astype(np.int64), table.column("x")[0].as_py()
        flat = grams.values.to_numpy()[bounds[0] : bounds[-1]]
        other = table.column("piece").to_numpy() != x if x != table.column("y")[0].as_py() else None
        found = join_apart(table.column("class").to_numpy(), table.column("root").to_numpy(), bounds - bounds[0], flat, least, other)
        a, b = zip(*found, strict=True) if found else ((), ())
        T.trim()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return shared.saved(dealt.join(sets, "class").groupBy("key", "x", "y").applyInArrow(run, "a long, b long"), "near")


def _fits(x: str, y: str, least: Fraction):
    """Whether sets of these sizes can be similar enough."""
    return F.least(x, y) * least.denominator >= F.greatest(x, y) * least.numerator


def _by_fingerprint(src: DataFrame, classes: DataFrame, least: Fraction, distance: int) -> DataFrame:
    """Links between classes whose fingerprints differ in `distance` or fewer bits."""
    full = classes.where("size > 0").select("class", "size", F.col("print").alias("fp"))
    heads = shared.saved(full.groupBy("fp").agg(F.min(F.struct("class", "size")).alias("head")), "heads")
    met = simhash.links(heads.select("fp"), distance).toDF("fp", "other")
    both = met.unionByName(met.select(F.col("other").alias("fp"), F.col("fp").alias("other")))
    step = F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))).alias("bits"), "other")
    nearest = both.groupBy("fp").agg(F.array(F.min(step), F.min(F.when(F.col("other") < F.col("fp"), step))).alias("steps"))
    nearest = shared.saved(nearest.select("fp", F.explode(F.array_distinct(F.array_compact("steps"))).alias("step")).select("fp", "step.other"), "nearest")
    across = nearest.join(heads, "fp").select("other", F.col("head").alias("x")).join(heads.withColumnRenamed("fp", "other"), "other").select("x", F.col("head").alias("y"))
    within = full.join(heads, "fp").where(F.col("class") != F.col("head.class")).select(F.col("head").alias("x"), F.struct("class", "size").alias("y"))
    pairs = across.unionByName(within).where(_fits("x.size", "y.size", least))
    return _verified(pairs.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")), src, classes, least)


def _by_hub(apart: DataFrame, order, src: DataFrame, classes: DataFrame, least: Fraction) -> DataFrame:
    """Links of the classes of each bucket to the first one by `order`, where they are of another component."""
    hubs = shared.saved(apart.groupBy("key").agg(F.min(F.struct(order.alias("h"), "class", "size", "root")).alias("hub")), "hubs")
    pairs = apart.join(hubs, "key").where((F.col("root") != F.col("hub.root")) & _fits("size", "hub.size", least))
    return _verified(pairs.select(F.least("class", "hub.class").alias("a"), F.greatest("class", "hub.class").alias("b")), src, classes, least)


def _by_keys(found: DataFrame, src: DataFrame, classes: DataFrame, least: Fraction) -> DataFrame:
    """The links found, and those that join what shares a key and is similar but still apart."""
    each = shared.saved(classes.select("class", "size", F.explode("keys").alias("key")), "keys")
    full = shared.saved(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "full")
    met = shared.saved(each.join(full, "key"), "met")
    found = found.unionByName(_by_hub(_apart(met, found), F.col("class"), src, classes, least))
    found = found.unionByName(_by_hub(_apart(met.where("n > 2"), found), F.xxhash64("class", "key"), src, classes, least))
    return found.unionByName(_rest(_apart(met.where("n > 2"), found), src, classes, least))


def links(src: DataFrame, classes: DataFrame, least: str = LEAST, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of classes that link, enough of them to join each component."""
    bound = Fraction(least)
    return _by_keys(_by_fingerprint(src, classes, bound, distance), src, classes, bound)


def cluster(docs: DataFrame, least: str = LEAST, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """A row for each document: the least id of its component, its class and the hash of its text."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("text_hash"))
    src = src.withColumn("key_id", F.coalesce("doc_id", F.lit(-(2**63))))
    each = shared.saved(src.select("doc_id", "text", "text_hash").mapInArrow(T.tidied(_prints), "doc_id long, text_hash long, class long, size long, print long, keys array<long>"), "prints")
    at = F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.col("text_hash").alias("hash"))).alias("at")
    classes = shared.saved(each.groupBy("class").agg(F.min("doc_id").alias("first"), at, F.any_value("size").alias("size"), F.any_value("print").alias("print"), F.any_value("keys").alias("keys")), "classes")
    roots = components(links(src, classes, least, distance))
    rooted = classes.join(roots, classes["class"] == roots.node, "left").select("class", F.coalesce("root", "class").alias("root"), "first")
    least_id = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = shared.saved(rooted.join(least_id, "root").select(F.col("class").alias("of"), "component_id"), "named")
    return each.join(named, each["class"] == named.of).select("doc_id", "component_id", F.col("class").alias("fp"), "text_hash")


def representatives(docs: DataFrame, least: str = LEAST, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One document of each component, with all its columns, chosen as in `simhash`."""
    return simhash.chosen(docs, cluster(docs, least, id_col, text_col, distance), id_col, text_col)
