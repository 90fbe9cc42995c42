"""Vectorised words, hashes and shingles over Arrow batches of whole texts.

Texts of a batch are laid end to end in one byte buffer, a line feed after each,
so that numpy finds words, hashes them and forms word windows for thousands of
documents at a time. Nothing here truncates a text: a document larger than the
chunk size becomes a chunk of its own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
#: Text after which a worker hands freed memory back.
TRIM_BYTES = 16 << 20
#: Bytes of text that one block of documents should hold.
BLOCK_BYTES = 8 << 20

_SPACE = np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
#: Byte classes of the two kinds of words: between white space, and of letters and digits.
SPACED, ALNUM = _SPACE, _ALNUM

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> list[bytes]:
    """The texts of a column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most `limit` bytes of text (or one document) each."""
    seen = 0
    for batch in batches:
        texts = column_bytes(batch.column(text))
        ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
        at = 0
        while at < len(texts):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at), texts[at:to]
            seen += int(ends[to - 1] - base)
            if seen > TRIM_BYTES:
                trim()
                seen = 0
            at = to


@functools.cache
def _heap():
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def tidied(run):
    """A function of batches, after which a worker hands back the memory it took."""

    def whole(batches):
        yield from run(batches)
        trim()

    return whole


def trim() -> None:
    """Hand freed memory back to the system: a Python worker outlives its task and would hold on to it."""
    pa.default_memory_pool().release_unused()
    if _heap():
        _heap()(0)


@dataclass
class Words:
    """Words of a chunk: bytes, [start, end) of each, its document, and `first`, the first word of each document (one more at the end)."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hashes: np.ndarray | None = None

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)


def lay(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a line feed after each, and where each text starts (one more at the end)."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=bounds[1:])
    return (_LOWER[buf] if lower else buf), bounds


def words(texts: list[bytes], kind: np.ndarray = SPACED, lower: bool = False, hashed: bool = True) -> Words:
    buf, bounds = lay(texts, lower)
    inside = kind[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]  # the last byte is a line feed, so every word ends
    first = np.searchsorted(starts, bounds)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
    out = Words(buf, starts, ends, doc, first)
    if hashed:
        out.hashes = hash_spans(buf, starts, ends)
    return out


#: Masks that keep the first 0 to 8 bytes of a little-endian number.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same in any chunk and process. Spans are read eight bytes at a time."""
    width = buf.dtype.itemsize
    raw = np.concatenate([np.ascontiguousarray(buf).view(np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    at, left = starts * width, (ends - starts) * width
    h = left.astype(np.uint64) * _STEP
    live = None
    while True:
        value = eight[at] & _KEEP[np.minimum(left, 8)]
        acc = ((h if live is None else h[live]) ^ value) * _BYTE
        acc ^= acc >> np.uint64(29)
        if live is None:
            h = acc
        else:
            h[live] = acc
        more = np.flatnonzero(left > 8)
        if not len(more):
            return mix(h)
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words, by first word, and the mask of those within one document."""
    n = len(w.starts) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = (h ^ w.hashes[j : j + n]) * _BYTE
        h ^= h >> np.uint64(32)
    return mix(h), w.doc[:n] == w.doc[size - 1 :]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    if len(x) < width:
        return x[:0]
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def cover(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Mask of the positions within [start, start + size) of any start."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + size, n), -1)
    return np.cumsum(delta[:-1]) > 0


def sums(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the mask between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def joined(w: Words, keep: np.ndarray) -> list[bytes]:
    """The kept words of each document, one space between them."""
    buf = w.buf.copy()
    buf[w.ends] = 0x20
    delta = np.zeros(len(buf) + 2, np.int8)
    starts, ends = w.starts[keep], w.ends[keep]
    delta[starts] += 1
    delta[ends + 1] -= 1
    inside = np.cumsum(delta[:-2], dtype=np.int8).view(bool)
    flat = buf[inside].tobytes()
    size = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    kept = np.concatenate([[0], np.cumsum(keep)])
    bounds = size[kept[w.first]]
    return [flat[a : b - 1] if b > a else b"" for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


class Members:
    """Membership in a sorted table of hashes, most misses settled by one look at a bit table."""

    def __init__(self, table: np.ndarray):
        self.table = table
        bits = max(16, int(np.ceil(np.log2(max(1, len(table)) * 16))))
        self.shift = np.uint64(64 - bits)
        self.bits = np.zeros(1 << bits, bool)
        self.bits[table >> self.shift] = True

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        maybe = np.flatnonzero(self.bits[keys >> self.shift])
        if len(maybe):
            out[maybe] = lookup(self.table, keys[maybe])
        return out
