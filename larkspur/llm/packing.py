"""Packing of token ids into sequences by bounded-space best fit.

Each task reads its documents once and holds at most `open_windows` open
sequences. A document longer than `size` ids is cut: its full multiples are sequences
of their own. Its rest, or a shorter document, stays whole and goes to the open
sequence with the least room that still takes it. If none does, a new one is opened;
if that would be one too many, the fullest is emitted first, as it is. The sequences
still open when a task ends (at most `open_windows`, whatever the size of its input)
keep their ids; they are merged in rounds of `FAN_IN` tasks, piece by piece and the
longest first, each round leaving at most `open_windows` for the next, until one
group is left. So a document has as few pieces as its length allows, and what is
padded is the room of the emitted sequences (figures in the README).

Null text is the end id alone. Equal documents are packed row by row. A very long
text is cut like any other. Other columns, whatever their names, are ignored. An empty
table gives no pieces. Every id lies in exactly one piece; a piece's `start` counts
its document's ids before it, `offset` the ids before it in its sequence.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import shared
from larkspur.llm import textkit as T
from larkspur.llm.tokens import CHUNK, encoder

SIZE, OPEN_WINDOWS, FAN_IN = 1024, 32, 256
_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task", "ids"]
_LEVEL, _GROUP = 56, 24


class Packer:
    """Open sequences of pieces (doc, start, ids, doc_tokens), at most `slots` if given; finished ones are in `done`."""

    def __init__(self, size: int, slots: int | None, first_id: int):
        self.size, self.slots, self.next_id = size, slots, first_id
        self.rooms: list[tuple[int, int]] = []  # (room, sequence), ascending
        self.pieces: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        size = self.size
        while len(ids) >= 4 * size:
            self._finish(self._open([(doc, start, ids[: 4 * size], total)]))
            start, ids = start + size, ids[4 * size :]
        if not ids:
            return
        n, piece = len(ids) // 4, (doc, start, ids, total)
        at = bisect_left(self.rooms, (n, -1))
        if at < len(self.rooms):
            room, number = self.rooms.pop(at)
            self.pieces[number].append(piece)
        else:
            if self.slots and len(self.rooms) == self.slots:
                self._finish(self.rooms.pop(0)[1])
            room, number = size, self._open([piece])
        if room == n:
            self._finish(number)
        else:
            insort(self.rooms, (room - n, number))

    def keep(self, slots: int) -> None:
        """Emit the fullest of the open sequences until at most `slots` are left."""
        while len(self.rooms) > slots:
            self._finish(self.rooms.pop(0)[1])

    def _open(self, pieces: list[tuple]) -> int:
        number, self.next_id = self.next_id, self.next_id + 1
        self.pieces[number] = pieces
        return number

    def _finish(self, number: int) -> None:
        self.done += self._rows(number, None)

    def _rows(self, number: int, task: int | None) -> list[tuple]:
        rows, offset = [], 0
        for doc, start, ids, total in self.pieces.pop(number):
            n = len(ids) // 4
            rows.append((doc, start, n, zlib.crc32(ids), total, number, offset, task, None if task is None else ids))
            offset += n
        return rows

    def rest(self, task: int) -> list[tuple]:
        """The pieces of the sequences that are still open."""
        return [row for number in sorted(self.pieces) for row in self._rows(number, task)]


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * 7, pa.binary()]
    cols = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=_COLUMNS)


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, open_windows: int = OPEN_WINDOWS, end_id: int = 0, fan_in: int = FAN_IN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, task long, ids binary"
    end = np.array([end_id], "<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        coder, task = encoder(tokenizer), TaskContext.get().partitionId()
        packer, part = Packer(size, open_windows, task << _GROUP), None
        for part, texts in T.chunks(batches, limit=CHUNK):
            for doc, ids in zip(part.column("doc_id").to_pylist(), coder.encode([x.decode() for x in texts]), strict=True):
                packer.add(doc, 0, ids + end, len(ids) // 4 + 1)
            yield _batch(packer.done, part.schema.field("doc_id").type)
            packer.done = []
        if part is not None:
            yield _batch(packer.rest(task), part.schema.field("doc_id").type)

    done = shared.saved(src.mapInArrow(T.tidied(first), schema), "packed")
    tasks = (done.agg(F.max("task")).head()[0] or 0) + 1
    parts, level, open_ = [done.where("task IS NULL")], 0, done.where("task IS NOT NULL")
    while True:
        level, groups, last = level + 1, -(-tasks // fan_in), tasks <= fan_in
        merged = open_.withColumn("g", F.floor(F.col("task") / fan_in)).groupBy("g").applyInArrow(_merger(size, open_windows, level, last), schema)
        if last:
            return _union([*parts, merged]).drop("task", "ids")
        merged = shared.saved(merged, "packed")
        parts.append(merged.where("task IS NULL"))
        open_, tasks = merged.where("task IS NOT NULL"), groups


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _merger(size: int, open_windows: int, level: int, last: bool):
    """Packs the pieces of a group of tasks' open sequences anew, the longest first; at most `open_windows` sequences stay open."""

    def run(key, table):
        g = key[0].as_py()
        rows = table.select(_COLUMNS).sort_by([("length", "descending"), ("task", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        packer = Packer(size, None, level << _LEVEL | g << _GROUP)
        for batch in rows.to_batches(max_chunksize=10_000):
            for r in batch.to_pylist():
                packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
        packer.keep(0 if last else open_windows)
        return pa.Table.from_batches([_batch(packer.done + packer.rest(g), table.schema.field("doc_id").type)])

    return run
