"""Token ids in shards of raw payload, with a minimal perfect hash index for keyed access.

Documents are range-partitioned and sorted by key. Each task encodes its texts,
appends the end id, and lays the ids end to end in shards of at most `shard_ids`
ids (or one document). A shard is one row of a table of Parquet files, which any
Hadoop file system holds and whose commit protocol leaves no half-written shard
when an executor is lost:

    shard long        ascending with the keys; the range partition in the upper 32 bits
    before long       ids of earlier shards in its range partition
    first_key, last_key   the range of its keys
    n_docs, n_ids, id_bytes long
    keys array        its documents in order
    index binary      minimal perfect hash, then by slot: fingerprint, first id, number of ids
    payload binary    the ids, little-endian, 2 or 4 bytes each

The hash is a cascade of bit arrays: a key is settled at the first level where it
alone falls on its bit; its slot is the number of set bits before that one. A key
that isn't in the shard lands on a slot whose stored 32-bit fingerprint differs.

Equal keys stay apart by their occurrence, in the order of their texts; a key that stands
in very many rows is spread over range partitions by its texts. Keys are told from null,
and if two keys of a shard have one hash, its hash is built again with another seed.

Null text is empty: only the end id. Null keys come first. A very long text is a shard of
its own. Other columns, whatever their names, are ignored. An empty table gives no shard.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import shared
from larkspur.llm import textkit as T
from larkspur.llm.tokens import CHUNK, encoder

SHARD_IDS = 2 << 20
GAMMA = 2.0
#: Characters of a text by which rows of one key are dealt to partitions; their order within the key is by whole texts.
PREFIX = 64
#: Ranges of keys that one fetch asks the Parquet reader for.
SPANS = 200
#: A row is a whole shard, so the writer looks at its buffers after every row.
_PARQUET = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "compression": "zstd"}


def key_hashes(keys: list, occurrence: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits of each key and its occurrence. Text keys and null are marked, so that no key is another's spelling."""
    raw = [b"n" if k is None else b"k" + str(k).encode("utf-8", "surrogatepass") for k in keys]
    buf, bounds = T.lay(raw)
    return T.mix(T.hash_spans(buf, bounds[:-1], bounds[1:] - 1) + T.mix(occurrence.astype(np.uint64) ^ np.uint64(seed << 40)))


class PerfectHash:
    """Slots 0 to n - 1 of n distinct hashes."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.base = np.concatenate([[0], np.cumsum([int(x.sum()) for x in levels])]).astype(np.int64)
        self.rank = [np.concatenate([[0], np.cumsum(x)])[:-1] for x in levels]

    @staticmethod
    def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return (T.mix(h ^ T.mix(np.full(len(h), level + 1, np.uint64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two hashes are equal")
        left, levels = hashes, []
        while len(left):
            size = max(8, int(GAMMA * len(left)))
            at = cls._place(left, len(levels), size)
            n = np.bincount(at, minlength=size)
            levels.append(n == 1)
            left = left[n[at] != 1]
        return cls(levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """-1 where no level settles the hash."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for k, bits in enumerate(self.levels):
            at = self._place(hashes[open_], k, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.base[k] + self.rank[k][at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<Q", len(x)) for x in self.levels) + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> tuple[PerfectHash, int]:
        (n,) = struct.unpack_from("<I", raw)
        sizes, at, levels = struct.unpack_from(f"<{n}Q", raw, 4), 4 + 8 * n, []
        for size in sizes:
            end = at + (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw[at:end], np.uint8), count=size).astype(bool))
            at = end
        return cls(levels), at


class ShardIndex:
    """The index of a shard: key to first id and number of ids, in constant time."""

    def __init__(self, raw: bytes):
        (self.seed,) = struct.unpack_from("<I", raw)
        raw = raw[4:]
        self.hash, at = PerfectHash.load(raw)
        n = int(self.hash.base[-1])
        self.prints = np.frombuffer(raw, "<u4", n, at)
        self.first = np.frombuffer(raw, "<u8", n, at + 4 * n)
        self.count = np.frombuffer(raw, "<u8", n, at + 12 * n)

    @staticmethod
    def dump(hashes: np.ndarray, first: np.ndarray, count: np.ndarray, seed: int = 0) -> bytes:
        found = PerfectHash.build(hashes)
        order = np.argsort(found.slots(hashes))
        return struct.pack("<I", seed) + found.dump() + (hashes[order] >> np.uint64(32)).astype("<u4").tobytes() + first[order].astype("<u8").tobytes() + count[order].astype("<u8").tobytes()

    @classmethod
    def of_keys(cls, keys: list, occurrence: np.ndarray, first: np.ndarray, count: np.ndarray) -> bytes:
        for seed in range(64):
            try:
                return cls.dump(key_hashes(keys, occurrence, seed), first, count, seed)
            except ValueError:
                continue
        raise ValueError("a key stands twice with one occurrence")

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 if its key isn't here."""
        slot = self.hash.slots(hashes)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == (hashes[ok] >> np.uint64(32)).astype(np.uint32)
        return np.where(ok, slot, -1)


def _shard(number: int, before: int, keys: list, nth: list[int], ids: list[bytes], width: int) -> dict:
    count = np.array([len(x) // 4 for x in ids], np.int64)
    first = np.cumsum(count) - count
    payload = np.frombuffer(b"".join(ids), "<u4")
    return {
        "shard": number, "before": before, "first_key": keys[0], "last_key": keys[-1], "n_docs": len(keys), "n_ids": int(count.sum()), "id_bytes": width, "keys": keys, "nth": nth,
        "index": ShardIndex.of_keys(keys, np.array(nth), first, count), "payload": (payload if width == 4 else payload.astype("<u2")).tobytes(),
    }


def shards(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each shard, over all documents in ascending order of their key."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # a key of very many rows is cut by the beginnings of their texts
    ordered = src.repartitionByRange("doc_id", F.left("text", F.lit(PREFIX))).sortWithinPartitions("doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"shard long, before long, first_key {kind}, last_key {kind}, n_docs long, n_ids long, id_bytes long, keys array<{kind}>, nth array<long>, index binary, payload binary"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        coder = encoder(tokenizer)
        width = 2 if coder.tokenizer.get_vocab_size() <= 1 << 16 else 4
        number, size, before = TaskContext.get().partitionId() << 32, 0, 0
        keys, nth, ids, last, again = [], [], [], object(), 0
        for part, texts in T.chunks(batches, limit=CHUNK):
            for key, raw in zip(part.column("doc_id").to_pylist(), coder.encode([x.decode() for x in texts]), strict=True):
                if ids and size + len(raw) // 4 + 1 > shard_ids:
                    yield _batch(_shard(number, before, keys, nth, ids, width), part.schema.field("doc_id").type)
                    number, before, size, keys, nth, ids, last = number + 1, before + size, 0, [], [], [], object()
                again = again + 1 if key == last else 0
                last = key
                keys.append(key)
                nth.append(again)
                ids.append(raw + end)
                size += len(raw) // 4 + 1
        if ids:
            yield _batch(_shard(number, before, keys, nth, ids, width), part.schema.field("doc_id").type)

    return ordered.mapInArrow(T.tidied(run), schema)


def _batch(row: dict, kind: pa.DataType) -> pa.RecordBatch:
    types = {"first_key": kind, "last_key": kind, "keys": pa.list_(kind), "nth": pa.list_(pa.int64()), "index": pa.binary(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], types.get(k, pa.int64())) for k, v in row.items()], names=[*row])


def write(docs: DataFrame, path: str, tokenizer: str, **options) -> str:
    shards(docs, tokenizer, **options).write.options(**_PARQUET).parquet(path)
    return path


def decode(payload: bytes, width: int) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if width == 2 else "<u4")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each stored document, in the place its key has by the index: start, n_tokens, ids_crc32 and found (its fingerprint agrees)."""
    stored = spark.read.parquet(path)
    kind = stored.schema["first_key"].dataType.simpleString()
    # one sum for each range partition that was written: as many as the session had shuffle partitions
    sums = stored.groupBy(F.shiftright("shard", 32).alias("part")).agg(F.sum("n_ids").alias("n")).collect()
    base, so_far = {}, 0
    for r in sorted(sums, key=lambda r: r.part):
        base[r.part] = so_far
        so_far += r.n
    known = spark.sparkContext.broadcast(base)
    placed = stored.select("shard", "id_bytes", "keys", "nth", "index", "payload", "before")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard, width, keys, nth, index, payload, before = (batch.column(k)[i] for k in range(7))
                start = known.value[shard.as_py() >> 32] + before.as_py()
                names, ids, index = keys.as_py(), decode(payload.as_py(), width.as_py()), ShardIndex(index.as_py())
                slot = index.find(key_hashes(names, np.array(nth.as_py()), index.seed))
                first, count = index.first[slot].astype(np.int64), index.count[slot].astype(np.int64)
                crc = [zlib.crc32(ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(first.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(start + first), pa.array(count), pa.array(crc, pa.int64()), pa.array(slot >= 0)], names=["doc_id", "start", "n_tokens", "ids_crc32", "found"])

    return placed.mapInArrow(T.tidied(run), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, found boolean")


def fetch(spark: SparkSession, path: str, keys: list) -> DataFrame:
    """(doc_id, ids): a row for each stored document with one of these keys, null among them if asked for.

    The keys' ranges, at most `SPANS`, reach the Parquet reader, so other shards aren't read; in a shard, each key within its range
    is one look-up for each document it has there.
    """
    stored = spark.read.parquet(path)
    kind = stored.schema["first_key"].dataType.simpleString()
    wanted = sorted({k for k in keys if k is not None})
    step = max(1, -(-len(wanted) // SPANS))
    near = F.lit(False)
    for run_of in (wanted[i : i + step] for i in range(0, len(wanted), step)):
        near = near | ((F.col("first_key").isNull() | (F.col("first_key") <= F.lit(run_of[-1]))) & (F.col("last_key") >= F.lit(run_of[0])))
    nameless = None in keys
    if nameless:
        near = near | F.col("first_key").isNull()

    def run(batches):
        for batch in batches:
            kinds = batch.schema.field("first_key").type
            for i in range(batch.num_rows):
                low, high, width, raw, payload = (batch.column(k)[i].as_py() for k in ("first_key", "last_key", "id_bytes", "index", "payload"))
                index, ids = ShardIndex(raw), decode(payload, width)
                left = [] if high is None else wanted[0 if low is None else bisect_left(wanted, low) : bisect_right(wanted, high)]
                left = [*left, *([None] if nameless and low is None else [])]
                names, found, n = [], [], 0
                while left:
                    slot = index.find(key_hashes(left, np.full(len(left), n, np.int64), index.seed))
                    left, slot, n = [k for k, s in zip(left, slot, strict=True) if s >= 0], slot[slot >= 0], n + 1
                    names += left
                    found += [ids[index.first[s] : index.first[s] + index.count[s]].tolist() for s in slot]
                yield pa.RecordBatch.from_arrays([pa.array(names, kinds), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return stored.where(near).select("first_key", "last_key", "id_bytes", "index", "payload").mapInArrow(T.tidied(run), f"doc_id {kind}, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write all documents to a fresh store in the shared folder and read them back."""
    spark = docs.sparkSession
    return read(spark, write(docs, shared.fresh(spark, "tokens"), tokenizer, **options))
