"""Blocks of documents that ask and answer questions about keys of the whole corpus.

Each task packs the documents it reads into blocks of a bounded amount of text, one
compressed row for each, so no source, id or group of copies gathers anywhere. A block
sends each of its keys (hashes of words or windows) once, as sorted packed arrays:
however often a passage occurs, a block contributes one entry for it. A reducer owns a
range of the hash space, combines what the blocks sent, and answers each letter in the
order of its keys, so answers carry no keys. All of it is ordinary shuffled rows, so
lost executors are recomputed; neither keys nor answers pass the driver.

There are as many reducers as blocks, but never so many that the letters of a full
block hold few keys (`sizes`), so a block writes a bounded number of letters. On
very large inputs raise `block_bytes` with the memory of the executors: the number of
letters a block may write grows with it.

Blocks follow the order of rows within a partition. A partition that is read again must
give its rows in the same order, as files do; write other frames first. An answer that
doesn't fit the block's keys is an error, never a wrong result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import shared
from larkspur.llm import textkit as T

#: Bytes of text for each byte of compressed files. Only the number of reducers depends on it.
EXPANSION = 3
#: Bytes of a block for each letter it may write: some 50 keys of three-word windows.
LETTER_BYTES = 512
LEAST_BYTES = 1 << 20
PARTITIONS = 20_000
#: Multiples of it lie evenly between whole numbers.
_GOLDEN = (5**0.5 - 1) / 2


def sizes(docs: DataFrame, block_bytes: int = T.BLOCK_BYTES) -> tuple[int, int]:
    """(bytes of a block, reducers). Small inputs are cut finer, for all cores; the hash space is cut into as many ranges as the files should fill blocks, up to the bound of letters. Neither changes a result."""
    size = shared.input_bytes(docs) * EXPANSION
    if size >= 1 << 60:  # not from files
        return block_bytes, max(1, min(docs.sparkSession.sparkContext.defaultParallelism, block_bytes // LETTER_BYTES))
    block_bytes = min(block_bytes, max(LEAST_BYTES, size // (2 * docs.sparkSession.sparkContext.defaultParallelism)))
    return block_bytes, max(1, min(math.ceil(size / block_bytes), block_bytes // LETTER_BYTES))


def packed(docs: DataFrame, count: int, id_col: str, text_col: str, block_bytes: int = T.BLOCK_BYTES) -> DataFrame:
    """(block, docs): the ids and texts of a block's documents, compressed. A null text is empty."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for part, texts in T.chunks(batches, limit=min(T.CHUNK_BYTES, block_bytes)):
            more = sum(map(len, texts))
            if held and size + more > block_bytes:
                yield _block(number, held)
                number, held, size = number + 1, [], 0
            held.append(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.large_binary())], names=["doc_id", "text"]))
            size += more
        if held:
            yield _block(number, held)

    return spread(src.mapInArrow(T.tidied(run), "block long, docs binary"), count, "block")


def spread(rows: DataFrame, count: int, key: str) -> DataFrame:
    """The rows with `slot`, the partition they are dealt to: in as many as there are reducers, up to what a driver schedules well, so that a task's share doesn't grow with the input. Reducers and blocks are dealt evenly, not by a hash."""
    parts = min(count, PARTITIONS)
    if key == "block":  # a task's number and the block's within it
        x = (F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit(0xFFFFFFFF)) * 1_000_003) * _GOLDEN
        slot = F.floor((x - F.floor(x)) * parts)
    else:
        slot = F.col(key) % parts
    return rows.withColumn("slot", slot.cast("int")).repartitionById(parts, F.col("slot"))


def _block(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held[0].schema) as out:
        for batch in held:
            out.write_batch(batch)
    raw = zstandard.ZstdCompressor(3).compress(sink.getvalue())
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([raw], pa.binary())], names=["block", "docs"])


def tidy(f):
    """The function of one or two tables, after which a worker hands back the memory it took."""

    def one(table):
        out = f(table)
        T.trim()
        return out

    def two(left, right):
        out = f(left, right)
        T.trim()
        return out

    return one if f.__code__.co_argcount == 1 else two


def unpacked(table: pa.Table) -> tuple[int, pa.Array, list[bytes]]:
    """The block's number, its document ids and its texts."""
    block, raw = table.column("block")[0].as_py(), table.column("docs")[0].as_py()
    held = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(raw)).read_all()
    return block, held.column("doc_id").combine_chunks(), held.column("text").to_pylist()


def pieces(texts: list[bytes], limit: int = T.CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of a block's texts of at most `limit` bytes (or one text), with the place of the first."""
    at, size = 0, 0
    for i, x in enumerate(texts):
        if i > at and size + len(x) > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(x)
    if texts:
        yield at, texts[at:]


def sorted_unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts the keys, where each distinct key starts in it, and the distinct keys."""
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return order, first, ranked[first]


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, one place of each, and for each key its number among them."""
    order, first, unique = sorted_unique(keys)
    mark = np.zeros(len(keys), np.int32)
    mark[first[1:]] = 1
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(mark, dtype=np.int32)
    return unique, order[first], number


def ids(column: pa.Array) -> np.ndarray:
    """Document ids; null counts as the least."""
    return column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def squeeze(x: np.ndarray) -> bytes:
    """An array, all first bytes before all second bytes, compressed: high bytes are mostly alike."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return zstandard.ZstdCompressor(1).compress(planes.tobytes())


def unsqueeze(raw: bytes, kind: str) -> np.ndarray:
    dtype = np.dtype(kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(raw, "<u8"), dtype=np.uint64)


def outbox(block: int, count: int, keys: np.ndarray, *values: np.ndarray) -> pa.Table:
    """Rows (reducer, block, keys, values ...) for sorted keys, to the reducers that own some."""
    owner = ((keys >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(keys) else np.zeros(0, np.int64)
    spans = [*zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=False)]
    cols = [[pack_keys(keys[a:b]) for a, b in spans], *([squeeze(x[a:b]) for a, b in spans] for x in values)]
    return pa.table([pa.array(owner[first].astype(np.int32)), pa.array([block] * len(spans), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], names=["reducer", "block", "keys", *(f"v{i}" for i in range(len(values)))])


def inbox(table: pa.Table, *kinds: str) -> tuple[np.ndarray, ...]:
    """The arrays of all letters, one after another, and where each letter starts (one more at the end)."""
    keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    values = [np.concatenate([*(unsqueeze(x, k) for x in table.column(f"v{i}").to_pylist()), np.zeros(0, k)]) for i, k in enumerate(kinds)]
    return (np.concatenate([*keys, np.zeros(0, np.uint64)]), *values, np.cumsum([0, *map(len, keys)]))


def letters(values: int) -> str:
    return "reducer int, block long, keys binary" + "".join(f", v{i} binary" for i in range(values))


def answered(mail: pa.Table, column: str, kind: str, size: int | None = None) -> np.ndarray:
    """What the reducers answered, in the order of the block's keys, of which there are `size`."""
    order = np.argsort(mail.column("reducer").to_numpy()) if mail.num_rows else []
    raw = mail.column(column).to_pylist() if mail.num_rows else []
    out = np.concatenate([*(unsqueeze(raw[i], kind) for i in order), np.zeros(0, kind)])
    if size is not None and len(out) != size:
        raise RuntimeError("a block was cut in another way than before: write the documents as a table first")
    return out
