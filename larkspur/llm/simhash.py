"""SimHash near-duplicates by the generalised pigeonhole principle.

Each document gets a 64-bit fingerprint of its word shingles. Documents with equal
fingerprints are one class, represented once. Classes link at `distance` or fewer
differing bits; the result is each document's connected component.

Candidates: the bits are split into m parts, correlated bits together, with
thresholds t_i (-1: part unused) that add up to distance - m + 1. If two
fingerprints differ in at most t_i bits in no part i, they differ in more than
`distance` bits altogether. So each class probes, in part i, all values within
t_i bits of its own, and what it meets there is verified over all bits. m and the
thresholds minimise, by dynamic programming, the estimated number of probes and
candidates; the estimate comes from how often each bit is set in all classes.

Reducers own ranges of the hashed (part, value) space and compare the classes at
home in a bucket with all that probe it. A bucket with many homes gives only as many
links as join its members (a spanning forest), and one with very many is cut
into pairs of chunks for other tasks: no pairs of a dense group are listed.

Null and empty texts have fingerprint zero and link like any other. A null id
is never the least of its component unless all are null. Rows with equal ids are
judged one by one. A very long text is hashed whole, by itself. Other columns, whatever
their names, are ignored by `cluster` and kept by `representatives`. An empty table
gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import blocks as B
from larkspur.llm import shared
from larkspur.llm import textkit as T
from larkspur.llm.components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Homes beyond which a bucket gives a spanning forest, and homes and members of one task's share of it.
FEW_HOMES, HOMES, MEMBERS = 32, 4096, 8192
#: Probes that one reducer compares.
REDUCER_PROBES = 400_000
_ONE = np.uint64(1)


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    w = T.words(texts, lower=True, hashed=False)
    rows = T.joined(w, np.ones(len(w.starts), bool))
    flat = b" ".join(rows)
    size = w.ends - w.starts + 1
    at = np.cumsum(size) - size + np.repeat(np.cumsum([not r for r in rows]) - [not r for r in rows], w.per_doc)
    n = w.per_doc
    count = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(w.first[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    last = start + np.repeat(np.minimum(n, shingle), count) - 1
    digest, view = xxhash.xxh64_intdigest, memoryview(flat)
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(at[start].tolist(), (at[last] + size[last] - 1).tolist(), strict=True)), np.uint64, len(start))
    return majority(hashes, bounds)


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each span of hashes, the bits set in over half of them."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    count = np.diff(bounds)
    full = np.flatnonzero(count)
    step = 1 << 18
    for group in np.split(full, np.flatnonzero(np.diff(bounds[full] // step)) + 1) if len(full) else []:
        part = hashes[bounds[group[0]] : bounds[group[-1] + 1]]
        bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, bounds[group] - bounds[group[0]], axis=0, dtype=np.int32)
        out[group] = np.packbits(2 * ones > count[group, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


# --- parts and thresholds


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each pair of bits how many have both set (4096 sums)."""

    def run(batches):
        total, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            x = batch.column("fp").to_numpy().view(np.uint64)
            bits = ((x[:, None] >> np.arange(64, dtype=np.uint64)) & _ONE).astype(np.float32)
            for at in range(0, len(x), 1 << 16):
                total += (bits[at : at + (1 << 16)].T @ bits[at : at + (1 << 16)]).astype(np.int64)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097, dtype=np.int32)), pa.array(np.append(total.ravel(), n))], names=["pair", "n"])

    rows = prints.select("fp").mapInArrow(T.tidied(run), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(4097, np.int64)
    for r in rows:
        sums[r.pair] = r.n
    return int(sums[4096]), sums[:4096].reshape(64, 64)


def split_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of even size; each starts at the least unused bit and takes those most correlated with it."""
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    corr = np.abs(both / max(1, n) - np.outer(p, p)) / np.where(spread > 0, spread, 1)
    left, parts = [*range(64)], []
    for i in range(m):
        size = len(left) // (m - i)
        part = [left.pop(0)]
        while len(part) < size:
            best = max(left, key=lambda b: (round(float(corr[b, part].mean()), 6), -b))
            part.append(best)
            left.remove(best)
        parts.append(sorted(part))
    return parts


def balls(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(radius + 1))


def plan(n: int, both: np.ndarray, distance: int = DISTANCE) -> tuple[list[list[int]], list[int]]:
    """The parts and thresholds of least estimated work: probes, and candidates to verify."""
    p = np.diag(both) / max(1, n)
    differ = 2 * p * (1 - p)  # chance that two classes differ in a bit
    best = None
    for m in range(1, distance + 2):
        parts = split_bits(n, both, m)
        budget = distance - m + 1
        work = []
        for part in parts:
            chance = np.zeros(len(part) + 1)
            chance[0] = 1
            for b in part:
                chance[1:] = chance[1:] * (1 - differ[b]) + chance[:-1] * differ[b]
                chance[0] *= 1 - differ[b]
            near = np.cumsum(chance)
            work.append({-1: 0.0} | {t: n * balls(len(part), t) + 0.1 * n * n * near[t] for t in range(min(distance, len(part)) + 1)})
        # cheapest thresholds of the first i parts that add up to s
        table = {0: (0.0, [])}
        for costs in work:
            step: dict[int, tuple[float, list[int]]] = {}
            for (s, (c, ts)), (t, w) in itertools.product(table.items(), costs.items()):
                if s + t not in step or c + w < step[s + t][0]:
                    step[s + t] = (c + w, [*ts, t])
            table = step
        if budget in table and (best is None or table[budget][0] < best[0]):
            best = (*table[budget], parts)
    return best[2], best[1]


def masks(part: list[int], radius: int) -> np.ndarray:
    """Flips of up to `radius` bits of the part; the first is none."""
    return np.array([sum(1 << b for b in flip) for k in range(radius + 1) for flip in itertools.combinations(part, k)], np.uint64)


# --- links


def near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def forest(homes: np.ndarray, members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join what the links of homes to members join, one less than joined things."""
    labels = np.arange(len(members))
    links = []
    for h in homes:
        adjacent = np.flatnonzero(near(members, h, distance))
        groups, of = np.unique(labels[adjacent], return_index=True)
        links += [(int(h), int(members[adjacent[i]])) for i in of if members[adjacent[i]] != h]
        if len(groups) > 1:
            labels[np.isin(labels, groups[1:])] = groups[0]
    return links


def bucket_links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[tuple[int, np.ndarray, np.ndarray]]]:
    """Links within buckets, and the shares of buckets too large for one task."""
    order = np.lexsort((fp, ~home, key))
    key, fp, home = key[order], fp[order], home[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    homes = np.add.reduceat(home.astype(np.int64), first) if len(first) else first
    found, shares = [], []
    small = (homes > 0) & (homes <= FEW_HOMES) & (size > 1)
    for j in range(int(homes[small].max()) if small.any() else 0):
        of = small & (homes > j)
        n = size[of] - j - 1  # members after the j-th home: earlier homes have met it
        at = np.repeat(first[of] + j + 1 - (np.cumsum(n) - n), n) + np.arange(n.sum())
        anchor = np.repeat(fp[first[of] + j], n)
        ok = near(anchor, fp[at], distance) & (anchor != fp[at])
        found.append(np.stack([anchor[ok], fp[at][ok]], axis=1))
    for i in np.flatnonzero(homes > FEW_HOMES):
        mine = np.unique(fp[first[i] : first[i] + size[i]])
        at_home = fp[first[i] : first[i] + homes[i]]
        if len(at_home) <= HOMES and len(mine) <= MEMBERS:
            found.append(np.array(forest(at_home, mine, distance), np.uint64).reshape(-1, 2))
        else:
            shares += [(len(shares), at_home[a : a + HOMES], mine[b : b + MEMBERS]) for a in range(0, len(at_home), HOMES) for b in range(0, len(mine), MEMBERS)]
    return found, shares


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that link; all of a dense group's, or enough of them to join it."""
    n, both = bit_counts(prints)
    parts, radii = plan(n, both, distance)
    used = [(i, masks(p, t)) for i, (p, t) in enumerate(zip(parts, radii, strict=True)) if t >= 0]
    whole = [np.uint64(sum(1 << b for b in p)) for p in parts]
    probes = n * sum(len(m) for _, m in used)
    reducers = max(1, math.ceil(probes / REDUCER_PROBES))
    step = max(1, REDUCER_PROBES // sum(len(m) for _, m in used))

    def probe(batches):
        for batch in batches:
            every = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(every), step):
                fp = every[at : at + step]
                keys = [T.mix((fp[:, None] & whole[i] ^ flips) ^ T.mix(np.full(1, i + 1, np.uint64))).ravel() for i, flips in used]
                homes = [np.broadcast_to(np.arange(len(flips)) == 0, (len(fp), len(flips))).ravel() for _, flips in used]
                values = [np.repeat(fp, len(flips)) for _, flips in used]
                key, home, value = np.concatenate(keys), np.concatenate(homes), np.concatenate(values)
                order = np.argsort(key)
                out = B.outbox(0, reducers, key[order], value[order], home[order])
                yield from out.to_batches()

    def compare(table):
        key, fp, home, _ = B.inbox(table, "<u8", "?")
        found, shares = bucket_links(key, fp, home, distance)
        pairs = np.concatenate([*found, np.zeros((len(shares), 2), np.uint64)]).view(np.int64)
        return pa.table(
            [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *(pa.array([None] * (len(pairs) - len(shares)) + x, t) for x, t in (([table.column("reducer")[0].as_py() << 24 | s[0] for s in shares], pa.int64()), ([s[1].tobytes() for s in shares], pa.binary()), ([s[2].tobytes() for s in shares], pa.binary())))],
            names=["a", "b", "share", "homes", "members"],
        )

    def part_of(batches):
        for batch in batches:
            for homes, members in zip(batch.column("homes").to_pylist(), batch.column("members").to_pylist(), strict=True):
                pairs = np.array(forest(np.frombuffer(homes, np.uint64), np.frombuffer(members, np.uint64), distance), np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    met = prints.select("fp").mapInArrow(T.tidied(probe), B.letters(2)).groupBy("reducer").applyInArrow(compare, "a long, b long, share long, homes binary, members binary")
    met = shared.saved(met, "near")
    rest = met.where("share IS NOT NULL").repartition("share").select("homes", "members").mapInArrow(T.tidied(part_of), "a long, b long")
    return met.where("share IS NULL").select("a", "b").unionByName(rest)


def cluster(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its fingerprint (as a long, and in hex) and the least id of its component."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("text_hash"))

    def run(batches):
        for part, texts in T.chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(texts, shingle).view(np.int64)), part.column("text_hash")], names=["doc_id", "fp", "text_hash"])

    each = shared.saved(src.mapInArrow(T.tidied(run), "doc_id long, fp long, text_hash long"), "prints")
    classes = shared.saved(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes, distance))
    rooted = classes.join(roots, classes.fp == roots.node).select("fp", "root", "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(least, "root").select(F.col("fp").alias("of"), F.col("component_id"))
    # written first, so that both sides of the last join are shuffled for it and large classes are split
    named = shared.saved(classes.join(of, classes.fp == of.of, "left").select(F.col("fp").alias("class"), F.coalesce("component_id", "first").alias("component_id")), "named")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return each.join(named, each.fp == named["class"]).select("doc_id", hexed.alias("fingerprint"), "component_id", "fp", "text_hash")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, with all its columns: that with the least id. Rows with one id count as one document, of which one stays; those without an id are told apart by their fingerprints."""
    return chosen(docs, cluster(docs, id_col=id_col, text_col=text_col, **options), id_col, text_col)


def chosen(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The representatives of the components in `found` (doc_id, component_id, fp, text_hash)."""
    of, text, copies = shared.unused(docs.columns, "of", "of_text", "copies")
    own = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("fp")).alias("nameless"))
    first = own.agg(F.min("text_hash").alias(text), F.count("*").alias(copies)).select(F.col("doc_id").alias(of), text, copies)
    first = shared.saved(first, "first")
    out = docs.join(first, docs[id_col].cast("long").eqNullSafe(first[of]) & (F.xxhash64(docs[text_col]) == first[text]))
    if first.where(F.col(copies) > 1).head(1):
        out = out.where(F.col(copies) == 1).unionByName(out.where(F.col(copies) > 1).dropDuplicates([of, text]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
