"""Benchmark decontamination by winnowing.

Fingerprints are the least hashes of `gram` words among the `window - gram + 1`
neighbours of every `window` words. Two texts that share `window` words share the
least hash of that run, so no such span is missed. Fingerprints of documents and
of benchmark items are joined; each hit is extended to the full window, which
counts only if all of its words are those of an item's window. Items with fewer
words than a window are one window of their own length.

The benchmark's windows are sent to every task if there are at most `max_broadcast`
of them; that is counted first. Of a larger benchmark each block of documents (see
blocks.py) gets the windows of the fingerprints that it holds, with the same result:
it sends each of its fingerprints once, so a phrase that stands in every document is
one entry for each block.

Null or empty texts have no words: no hits, no windows. Rows without item_id are
left out. Repeated items and repeated documents are judged row by row; an item_id
counts once. An empty benchmark gives n_hit 0 everywhere, an empty table no rows. A very
long text is judged whole. Other columns, whatever their names, are ignored by `flag`
and passed through by `clean`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import blocks as B
from larkspur.llm import shared
from larkspur.llm import textkit as T

WINDOW, GRAM = 10, 5
#: Windows that are sent to every task, 50 to 60 bytes each in the driver and in a task.
MAX_BROADCAST_WINDOWS = 1_000_000


def _parsed(texts: list[bytes]) -> T.Words:
    return T.words(texts, T.ALNUM, lower=True)


def fingerprints(w: T.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each full window, and its least gram hash."""
    h, _ = T.windows(w, gram)
    least = T.sliding_min(h, window - gram + 1)
    at = np.flatnonzero(w.doc[: len(least)] == w.doc[window - 1 :]) if len(least) else np.zeros(0, np.int64)
    return at, least[at]


def item_windows(w: T.Words, window: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(item row, length, window hash, fingerprint); a short window is its own fingerprint."""
    at, least = fingerprints(w, window, gram)
    full, _ = T.windows(w, window)
    yield from zip(w.doc[at].tolist(), [window] * len(at), full[at].tolist(), least.tolist(), strict=True)
    for i in np.flatnonzero((w.per_doc > 0) & (w.per_doc < window)):
        n = int(w.per_doc[i])
        h = int(T.windows(T.Words(w.buf, *(x[w.first[i] : w.first[i + 1]] for x in (w.starts, w.ends, w.doc)), np.array([0, n]), w.hashes[w.first[i] : w.first[i + 1]]), n)[0][0])
        yield int(i), n, h, h


class Index:
    """Windows of items by length, with the items of each."""

    def __init__(self, rows: pa.Table):
        """rows: item, len, win, fp"""
        names = rows.column("item").combine_chunks().dictionary_encode()
        self.items = names.dictionary.to_pylist()
        number, length = names.indices.to_numpy(), rows.column("len").to_numpy()
        win, fp = (rows.column(c).to_numpy().view(np.uint64) for c in ("win", "fp"))
        self.prints = T.Members(np.unique(fp))
        self.by_length = {}
        for n in np.unique(length).tolist():
            mine = np.flatnonzero(length == n)
            mine = mine[np.lexsort((number[mine], win[mine]))]
            keys, first = np.unique(win[mine], return_index=True)
            self.by_length[n] = (T.Members(keys), np.append(first, len(mine)), number[mine].astype(np.int64))


def hits(w: T.Words, index: Index, window: int, gram: int) -> tuple[np.ndarray, list[set[str]]]:
    """Mask of the words inside an occurring window, and each document's items."""
    mask = np.zeros(len(w.starts), bool)
    found: list[set[str]] = [set() for _ in range(len(w.first) - 1)]
    for n, (members, first, items) in index.by_length.items():
        if n == window:
            at, least = fingerprints(w, window, gram)
            at = at[index.prints.find(least) >= 0]
            h = _some(w, at, n)
        else:
            h, within = T.windows(w, n)
            at = np.flatnonzero(within)
            h = h[at]
        place = members.find(h)
        at, place = at[place >= 0], place[place >= 0]
        if len(at):
            mask |= T.cover(len(mask), at, n)
            for d, p in np.unique(np.stack([w.doc[at].astype(np.int64), place], axis=1), axis=0).tolist():
                found[d].update(index.items[i] for i in items[first[p] : first[p + 1]])
    return mask, found


def _some(w: T.Words, at: np.ndarray, n: int) -> np.ndarray:
    """Window hashes at some starts only."""
    spread = at[:, None] + np.arange(n)
    flat = T.Words(w.buf, spread.ravel(), spread.ravel(), np.repeat(np.arange(len(at)), n), np.arange(0, n * len(at) + 1, n), w.hashes[spread.ravel()])
    return T.windows(flat, n)[0][::n]


def _rows(part: pa.RecordBatch, w: T.Words, mask: np.ndarray, found: list[set[str]], extra: list[pa.Array]) -> pa.RecordBatch:
    n_hit = T.sums(mask, w.first)
    digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in found]
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(w.per_doc), pa.array(n_hit), pa.array([len(x) for x in found], pa.int64()), pa.array(digest), pa.array(n_hit > 0), pa.array([sorted(x) for x in found], pa.list_(pa.string())), *extra],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", *["row"] * len(extra)],
    )


def _out(kind: str) -> str:
    return f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>"


def benchmark_windows(bench: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row for each window of each item: item, len, win, fp."""
    src = bench.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for part, texts in T.chunks(batches):
            rows = [*item_windows(_parsed(texts), window, gram)]
            i, n, h, f = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(i, pa.int64())), pa.array(n, pa.int32()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (h, f))], names=["item", "len", "win", "fp"])

    return src.mapInArrow(T.tidied(run), "item string, len int, win long, fp long").distinct()


def _small(wins: DataFrame, bound: int):
    """The index of at most `bound` windows as a broadcast, else None. They are counted before any reaches the driver."""
    if wins.count() > bound:
        return None
    return wins.sparkSession.sparkContext.broadcast(Index(wins.toArrow()))


def flag(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM, max_broadcast: int = MAX_BROADCAST_WINDOWS, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = T.BLOCK_BYTES) -> DataFrame:
    """A row for each document: words, hit words, the items whose windows occur."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    wins = benchmark_windows(bench, window, gram)
    index = _small(wins, max_broadcast)
    if index is None:
        return _flag_by_blocks(src, wins, window, gram, kind, block_bytes)

    def run(batches):
        for part, texts in T.chunks(batches):
            w = _parsed(texts)
            yield _rows(part, w, *hits(w, index.value, window, gram), [])

    return src.mapInArrow(T.tidied(run), _out(kind))


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM, max_broadcast: int = MAX_BROADCAST_WINDOWS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The documents without any benchmark window, with all columns. Up to the bound each task drops them as it reads."""
    wins = benchmark_windows(bench, window, gram, id_col=id_col)
    index = _small(wins, max_broadcast)
    if index is None:
        name = next(f"text_{i}" for i in range(len(docs.columns) + 1) if f"text_{i}" not in docs.columns)
        keyed = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).dropDuplicates(["h", "text"])
        bad = flag(keyed, bench, window, gram, max_broadcast, id_col="h").where("contaminated").select(F.col("doc_id").alias(name)).distinct()
        bad = shared.saved(bad, "contaminated")
        return docs.join(bad, F.xxhash64(docs[text_col]) == bad[name], "left_anti")
    src = docs.withColumn(text_col, F.col(text_col).cast("string"))

    def run(batches):
        for part, texts in T.chunks(batches, text_col):
            w = _parsed(texts)
            mask, _ = hits(w, index.value, window, gram)
            yield part.filter(pa.array(T.sums(mask, w.first) == 0))

    return src.mapInArrow(T.tidied(run), src.schema)


def _flag_by_blocks(src: DataFrame, wins: DataFrame, window: int, gram: int, kind: str, block_bytes: int) -> DataFrame:
    """The same for a benchmark of any size. Lengths of short windows are at most window - 1, so their list is small."""
    lengths = [r.len for r in wins.where(F.col("len") < window).select("len").distinct().collect()]
    block_bytes, count = B.sizes(src, block_bytes)
    blocks = B.packed(src, count, "doc_id", "text", block_bytes)

    def ask(table):
        block, _, texts = B.unpacked(table)
        prints = []
        for _, some in B.pieces(texts):
            w = _parsed(some)
            keys = [fingerprints(w, window, gram)[1]]
            for n in lengths:
                h, within = T.windows(w, n)
                keys.append(h[within])
            prints.append(np.unique(np.concatenate(keys)))
        return B.outbox(block, count, np.unique(np.concatenate(prints)))

    def answer(table, owned):
        """To each block, the benchmark's windows whose fingerprints it has."""
        fps = owned.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(fps, kind="stable")
        owned, fps = owned.take(pa.array(order)).select(["item", "len", "win", "fp"]), fps[order]
        to, told = [], []
        for block, raw in zip(table.column("block").to_pylist(), table.column("keys").to_pylist(), strict=True):
            low, high = (np.searchsorted(fps, B.unpack_keys(raw), side) for side in ("left", "right"))
            size = high - low
            rows = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
            if len(rows):
                to.append(block)
                told.append(_sealed(owned.take(pa.array(rows))))
        return pa.table([pa.array(to, pa.int64()), pa.array(told, pa.binary())], names=["block", "windows"])

    def result(table, mail):
        _, names, texts = B.unpacked(table)
        told = [_opened(x) for x in mail.column("windows").to_pylist()] if mail.num_rows else []
        index = Index(pa.concat_tables(told) if told else _NO_WINDOWS)
        out = []
        for at, some in B.pieces(texts):
            w = _parsed(some)
            part = pa.RecordBatch.from_arrays([names.slice(at, len(some))], names=["doc_id"])
            out.append(_rows(part, w, *hits(w, index, window, gram), []))
        return pa.Table.from_batches(out)

    asked = B.spread(blocks.groupBy("slot", "block").applyInArrow(B.tidy(ask), B.letters(0)), count, "reducer")
    owner = F.floor(F.shiftright(F.shiftrightunsigned("fp", 32) * F.lit(count), 32)).cast("int")
    owned = B.spread(wins.select("item", "len", "win", "fp", owner.alias("reducer")), count, "reducer")
    answers = asked.groupBy("slot", "reducer").cogroup(owned.groupBy("slot", "reducer")).applyInArrow(B.tidy(answer), "block long, windows binary")
    return blocks.groupBy("slot", "block").cogroup(B.spread(answers, count, "block").groupBy("slot", "block")).applyInArrow(B.tidy(result), _out(kind))


_NO_WINDOWS = pa.table({"item": pa.array([], pa.string()), "len": pa.array([], pa.int32()), "win": pa.array([], pa.int64()), "fp": pa.array([], pa.int64())})


def _sealed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _opened(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all().cast(_NO_WINDOWS.schema)
