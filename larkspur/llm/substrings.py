"""Exact substring dedup: word windows that also start in an earlier document.

Level by level: windows that repeat at one length alone are extended to twice that
length (the last step stops at `window` words), until the window is reached or no
candidate survives. A window of 13 words is asked for at 4 words, then at 7 where both
its halves repeat, then at 13 where both halves of 7 repeat. Each level is exact: no
window is sampled, and one that repeats is never lost, as all its parts repeat too.

A word is removed if a window over it has words that also start a window in a
document with a smaller id; windows are judged on the input. Windows in the same
document (or in rows with the same id) don't count against each other; a null id
counts as the least. Null and empty texts have no words. A very long text is a block
of its own and judged whole. Other columns, whatever their names, are ignored. The
result has a row for each input row, in no order; an empty table gives no rows.

Blocks of documents exchange hashes with reducers, see blocks.py: a passage or a
document that stands in a third of all rows is one entry in each block. With each
level a block sends itself a note, a bit for each word, of which windows it asked for.
Windows are compared by 64-bit hashes at every level: a word is removed by error only
if two windows collide at the last one whose halves both repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import blocks as B
from larkspur.llm import textkit as T

WINDOW, FIRST = 13, 4
_LETTERS = B.letters(2) + ", note binary"
_ANSWERS = "block long, reducer int, bits binary, least binary"


def levels(window: int, first: int = FIRST) -> list[int]:
    """Lengths from the first level to the window, each at most twice the one before."""
    out = [window]
    while out[0] > first:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _hashes(texts: list[bytes]) -> T.Words:
    """Hashes and documents of all words of a block; the words themselves are left out."""
    parts = []
    for at, some in B.pieces(texts):
        w = T.words(some)
        parts.append((w.hashes, w.doc + np.int32(at)))
    h, doc = (np.concatenate([*(p[i] for p in parts), np.zeros(0, t)]) for i, t in ((0, np.uint64), (1, np.int32)))
    return T.Words(np.zeros(0, np.uint8), h, h, doc, np.zeros(1, np.int64), h)


def _windows(w: T.Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows at every word, and which lie within one document."""
    h, within = T.windows(w, length)
    return h, np.flatnonzero(within)


def _note(at: np.ndarray, n: int) -> bytes:
    mask = np.zeros(n, bool)
    mask[at] = True
    return B.squeeze(np.packbits(mask))


def _asked(w: T.Words, length: int, mail: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the level before: the windows asked for, the number of each one's key, and the answers in the order of keys."""
    h, at = _windows(w, length)
    rows = mail.column("reducer").to_numpy() >= 0
    for raw in mail.filter(pa.array(~rows)).column("bits").to_pylist():
        at = np.flatnonzero(np.unpackbits(B.unsqueeze(raw, "u1"), count=len(w.hashes)))
    unique, _, number = B.numbered(h[at])
    return at, number, B.answered(mail.filter(pa.array(rows)), "bits", "?", len(unique))


def _ask(block: int, count: int, h: np.ndarray, docs: np.ndarray, last: bool, note: bytes | None) -> pa.Table:
    """Letters for windows with hashes h in documents docs. Before the last level they tell whether several documents of the block hold a key, on the last the least and how far the greatest is from it."""
    order, first, keys = B.sorted_unique(h)
    docs = docs[order]
    low, high = (f.reduceat(docs, first) if len(first) else docs for f in (np.minimum, np.maximum))
    values = (low, high - low) if last else (low != high, np.zeros(len(low), "u1"))
    out = B.outbox(block, count, keys, *values)
    out = out.append_column("note", pa.nulls(out.num_rows, pa.binary()))
    if note is not None:
        row = [[block % count], [block], [None], [None], [None], [note]]
        out = pa.concat_tables([out, pa.table([pa.array(x, f.type) for x, f in zip(row, out.schema, strict=True)], schema=out.schema)])
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = T.BLOCK_BYTES, first: int = FIRST) -> DataFrame:
    """A row for each document: n_words, n_removed, kept_sha256, and kept_text if asked for."""
    lengths = levels(window, first)
    block_bytes, count = B.sizes(docs.select(id_col, text_col), block_bytes)
    blocks = B.packed(docs.withColumn(id_col, F.col(id_col).cast("long")), count, id_col, text_col, block_bytes)

    def start(table):
        block, names, texts = B.unpacked(table)
        w = _hashes(texts)
        h, at = _windows(w, lengths[0])
        return _ask(block, count, h[at], B.ids(names)[w.doc[at]], len(lengths) == 1, None)

    def candidates(level):
        def run(table, mail):
            block, names, texts = B.unpacked(table)
            if not mail.num_rows:
                return _ask(block, count, np.zeros(0, np.uint64), np.zeros(0, np.int64), level == len(lengths) - 1, None)
            w, half, length = _hashes(texts), lengths[level - 1], lengths[level]
            at, number, hit = _asked(w, half, mail)
            again = np.zeros(len(w.hashes), bool)
            again[at[hit[number]]] = True
            h, whole = _windows(w, length)
            at = whole[again[whole] & again[whole + (length - half)]]
            return _ask(block, count, h[at], B.ids(names)[w.doc[at]], level == len(lengths) - 1, _note(at, len(w.hashes)))

        return run

    def combine(last):
        def run(table):
            notes = table.filter(table.column("note").is_valid())
            table = table.filter(table.column("note").is_null())
            key, low, more, bounds = B.inbox(table, *(("<i8", "<i8") if last else ("?", "u1")))
            order, at, _ = B.sorted_unique(key)
            size = np.diff(np.append(at, len(key)))
            least = np.zeros(len(key), np.int64)
            if last:
                high = low + more
                least[order] = np.repeat(np.minimum.reduceat(low[order], at), size) if len(at) else 0
                hit = high > least
            else:
                hit = np.zeros(len(key), bool)
                hit[order] = np.repeat((size > 1) | (np.add.reduceat(low[order].astype(np.int64), at) > 0), size) if len(at) else False
            spans = [slice(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            none, sent = [None] * notes.num_rows, [-1] * notes.num_rows
            cols = [
                pa.array(table.column("block").to_pylist() + notes.column("block").to_pylist(), pa.int64()),
                pa.array(table.column("reducer").to_pylist() + sent, pa.int32()),
                pa.array([B.squeeze(hit[s]) for s in spans] + notes.column("note").to_pylist(), pa.binary()),
                pa.array([B.squeeze(least[s][hit[s]]) if last else None for s in spans] + none, pa.binary()),
            ]
            return pa.table(cols, names=["block", "reducer", "bits", "least"])

        return run

    def results(table, mail):
        block, names, texts = B.unpacked(table)
        bad = np.zeros(0, np.int64)
        if mail.num_rows:
            w = _hashes(texts)
            at, number, hit = _asked(w, lengths[-1], mail)
            least = np.zeros(len(hit), np.int64)
            least[hit] = B.answered(mail.filter(pa.array(mail.column("reducer").to_numpy() >= 0)), "least", "<i8", int(hit.sum()))
            mine = B.ids(names)[w.doc[at]]
            bad = at[hit[number] & (least[number] < mine)]
        out, before = [], 0
        for place, some in B.pieces(texts):
            w = T.words(some)
            here = bad[(bad >= before) & (bad < before + len(w.starts))] - before
            before += len(w.starts)
            gone = T.cover(len(w.starts), here, window)
            kept = T.joined(w, ~gone)
            cols = [names.slice(place, len(some)), pa.array(w.per_doc), pa.array(T.sums(gone, w.first)), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            out.append(pa.table([*cols, *([pa.array([x.decode() for x in kept])] if with_text else [])], names=[f.split()[0] for f in result.split(", ")]))
        return pa.concat_tables(out)

    result = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    asked = blocks.groupBy("slot", "block").applyInArrow(B.tidy(start), _LETTERS)
    for level in range(len(lengths)):
        if level:
            asked = blocks.groupBy("slot", "block").cogroup(mail.groupBy("slot", "block")).applyInArrow(B.tidy(candidates(level)), _LETTERS)
        answers = B.spread(asked, count, "reducer").groupBy("slot", "reducer").applyInArrow(B.tidy(combine(level == len(lengths) - 1)), _ANSWERS)
        mail = B.spread(answers, count, "block")
    return blocks.groupBy("slot", "block").cogroup(mail.groupBy("slot", "block")).applyInArrow(B.tidy(results), result)

