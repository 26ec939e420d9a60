"""Which hashes occur more than once over a whole corpus, answered to the rows that asked.

Rows of (hash, place) would make a shuffle of tens of bytes per entry, so entries travel as packed blocks:

1. a map task splits its input into chunks of bounded size and sends, for each chunk and hash range ("bucket"),
   one row with packed hashes and packed references to places inside the chunk, and one skeleton row that
   says what the references mean. A hash that occurs twice within a chunk is already known to be repeated; only
   one entry goes out for it, so a hash that a third of all rows hold costs each bucket one entry a chunk;
2. grouped by bucket, hashes are sorted and the references of repeated ones go back, grouped by chunk;
3. grouped by chunk, the skeleton turns references into results.

Buckets follow ``spark.sql.shuffle.partitions``; a chunk has about ``CHUNK_BYTES`` of text. Rows name their bucket by a key that Spark's own
hash puts into the bucket's partition, so each partition gets as many buckets as any other. Chunk ids come from the
partition and ordinal, so a task that is run again gives the same ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from veriledger.llm.workers import lean

CHUNK_BYTES = 2 << 20
BUCKETS_EACH = 2
ASK, SKELETON, ANSWER = 0, 1, 2
SCHEMA = "bucket int, chunk long, kind int, h binary, r binary, t binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("h", pa.binary()), ("r", pa.binary()), ("t", pa.binary())])
LOW40 = np.uint64((1 << 40) - 1)


def _partition_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Where hash partitioning into n parts puts 32-bit integers: Murmur3 with the seed 42."""
    k = keys.astype(np.uint32) * np.uint32(0xCC9E2D51)
    k = (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)
    h = np.uint32(42) ^ k
    h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(by)
    return (h ^ h >> np.uint32(16)).astype(np.int32).astype(np.int64) % n


def bucket_keys(spark: SparkSession, each: int = BUCKETS_EACH) -> np.ndarray:
    """Each bucket's key, ascending: so many for each shuffle partition."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = 32 * each * n
    while True:
        keys = np.arange(size, dtype=np.int32)
        part = _partition_of(keys, n)
        order = np.argsort(part, kind="stable")
        nth = np.arange(size) - np.searchsorted(part[order], part[order])
        chosen = order[nth < each]
        if len(chosen) == n * each:
            return np.sort(keys[chosen])
        size *= 2


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Ascending with the hash, so sorted hashes have their buckets in one piece each."""
    return (((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def pack(hashes: np.ndarray, width: int) -> bytes:
    """The low width bytes of each."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.reshape(-1).view("<u8").astype(np.uint64) if len(raw) else np.zeros(0, np.uint64)


def none_of(dtype: str) -> int:
    """The reference that asks on nobody's behalf."""
    return int(np.iinfo(dtype).max)


class Chunks:
    """Ordinals of a task's chunks."""

    def __init__(self):
        context = TaskContext.get()
        self.base, self.next = (context.partitionId() if context else 0) << 32, 0

    def new(self) -> int:
        self.next += 1
        return self.base | (self.next - 1)


def asks(chunk: int, hashes: np.ndarray, refs: np.ndarray, keys: np.ndarray, width: int, ref: str, skeleton: bytes) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows of one chunk, and which entries (in the order of hashes) are repeated inside it.

    hashes need to be sorted. skeleton gets these entries' marks through its maker, so it is added by finish().
    """
    n = len(hashes)
    same = np.zeros(n, bool)
    if n:
        equal = hashes[1:] == hashes[:-1]
        same[1:] |= equal
        same[:-1] |= equal
        first = np.ones(n, bool)
        first[1:] = ~equal
        sent = refs.astype(ref)
        sent[same] = none_of(ref)
        hashes, sent = hashes[first], sent[first]
    of = bucket_of(hashes, len(keys))
    cuts = np.searchsorted(of, np.arange(len(keys) + 1))
    rows = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
    h = [pack(hashes[cuts[b] : cuts[b + 1]], width) for b in rows]
    r = [sent[cuts[b] : cuts[b + 1]].tobytes() for b in rows]
    k = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([*keys[rows].tolist(), int(keys[chunk % len(keys)])], pa.int32()), pa.array([chunk] * (k + 1), pa.int64()), pa.array([ASK] * k + [SKELETON], pa.int32()), pa.array([*h, None], pa.binary()), pa.array([*r, None], pa.binary()), pa.array([None] * k + [skeleton], pa.binary())],
        schema=_ARROW,
    ), same


def _column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def answer(asked: DataFrame, *, width: int, ref: str, with_hashes: bool = False) -> DataFrame:
    """Skeletons as they are, and for each chunk and bucket the references (and hashes) that are repeated anywhere."""

    def one(table: pa.Table) -> pa.Table:
        kinds = np.asarray(_column(table, "kind"))
        asking = table.filter(pa.array(kinds == ASK))
        out = [table.filter(pa.array(kinds != ASK))]
        if len(asking):
            hs = [unpack(x, width) for x in _column(asking, "h")]
            h = np.concatenate(hs)
            r = np.concatenate([np.frombuffer(x, ref) for x in _column(asking, "r")])
            of = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
            order = np.argsort(h, kind="stable")
            equal = h[order][1:] == h[order][:-1]
            twice = np.zeros(len(h), bool)
            twice[1:] |= equal
            twice[:-1] |= equal
            chosen = order[twice]
            chosen = np.sort(chosen[r[chosen] != none_of(ref)])
            cuts = np.searchsorted(of[chosen], np.arange(len(hs) + 1))
            some = [i for i in range(len(hs)) if cuts[i] < cuts[i + 1]]
            chunks, bucket = _column(asking, "chunk"), _column(asking, "bucket")
            parts = [chosen[cuts[i] : cuts[i + 1]] for i in some]
            out.append(pa.table([
                pa.array([bucket[i] for i in some], pa.int32()), pa.array([chunks[i] for i in some], pa.int64()), pa.array([ANSWER] * len(some), pa.int32()),
                pa.array([pack(h[p], width) if with_hashes else None for p in parts], pa.binary()), pa.array([r[p].tobytes() for p in parts], pa.binary()), pa.array([None] * len(some), pa.binary()),
            ], schema=_ARROW))
        return pa.concat_tables([t.cast(_ARROW) for t in out])

    return asked.groupBy("bucket").applyInArrow(lean(one), SCHEMA)


def assemble(answered: DataFrame, build, schema: str) -> DataFrame:
    """build(skeleton, [(bucket, hashes blob, references blob)]) -> Arrow table, for each chunk."""

    def one(table: pa.Table) -> pa.Table:
        kinds = _column(table, "kind")
        skeleton = table.column("t")[kinds.index(SKELETON)].as_py()
        rows = [(b, h, r) for k, b, h, r in zip(kinds, _column(table, "bucket"), _column(table, "h"), _column(table, "r"), strict=True) if k == ANSWER]
        return build(skeleton, rows)

    return answered.groupBy("chunk").applyInArrow(lean(one), schema)
