"""Best-fit packing of token sequences through length patterns.

Only the histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus) reaches the driver. Patterns of two or three
lengths that fill a sequence exactly are enumerated, non-negative least squares fits how often to repeat each so that the
histogram is used up, counts are rounded down, and this repeats on what is left. The residue is packed by best fit, longest first, again on the
histogram. The resulting plan says for each length which ranks go to which sequence and offset; pieces get their rank within
their length from their task's own counts and the sums over earlier tasks, so no piece is moved to be counted.

Defined results: null and empty texts are one piece with the end id alone; a text of more than capacity ids is cut so that only its
first piece can be shorter; repeated rows are pieces of their own; an empty table gives none.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriledger.llm import kernels as K
from veriledger.llm.storage import materialise, small_batches
from veriledger.llm.tokenise import Tokeniser
from veriledger.llm.workers import lean

CAPACITY, END_ID = 2048, 0
ROUNDS, MOST_PATTERNS, STEPS = 6, 8000, 150
#: Bytes of text that are tokenised at once.
STEP = 1 << 19


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_of(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part and rank (of the piece in its task, among those of its length), and token_ids."""
    small_batches(docs.sparkSession)
    path = path or vocabulary()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long" + ", token_ids array<int>" * with_ids

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokeniser = Tokeniser(path)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows, data, offsets in K.steps(batch, limit=STEP):
                found, first = tokeniser.encode(data, offsets)
                n = len(offsets) - 1
                ids = np.full(len(found) + n, END_ID, np.uint32)
                inside = np.ones(len(ids), bool)
                first = first + np.arange(n + 1)
                inside[first[1:] - 1] = False
                ids[inside] = found
                total = np.diff(first)
                count = -(-total // capacity)
                doc = np.repeat(np.arange(n), count)
                piece = K.ranges(np.zeros(n, np.int64), count)
                shorter = total - (count - 1) * capacity
                start = np.where(piece == 0, 0, shorter[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, shorter[doc], capacity)
                order = np.argsort(length, kind="stable")
                sorted_ = length[order]
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.searchsorted(sorted_, sorted_) + seen[sorted_]
                seen += np.bincount(length, minlength=capacity + 1)
                at = first[doc] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [rows.column(0).cast(pa.int64()).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part)), pa.array(rank)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *["token_ids"] * with_ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), schema)


def patterns(left: np.ndarray, capacity: int, most: int) -> np.ndarray:
    """Patterns (a >= b >= c, c may be 0) of lengths that are left, a + b + c = capacity: those that could be repeated most, spread over the lengths."""
    lengths = np.flatnonzero(left[: capacity + 1] > 0)
    lengths = lengths[lengths > 0]
    twos = np.stack([lengths, capacity - lengths, np.zeros_like(lengths)], 1)
    twos = twos[(twos[:, 0] >= twos[:, 1]) & (twos[:, 1] > 0)]
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    keep = a >= b
    a, b = a[keep], b[keep]
    c = capacity - a - b
    keep = (c > 0) & (c <= b)
    found = np.concatenate([twos, np.stack([a[keep], b[keep], c[keep]], 1)])
    weight = left.astype(np.float64).copy()
    weight[0] = np.inf
    found = found[(weight[found] > 0).all(1)]
    if len(found) > most:
        share = np.minimum.reduce(weight[found], axis=1)
        # lengths that are in many patterns would crowd out the rest: a fixed shuffle breaks ties and spreads
        spread = K.mix(np.arange(len(found), dtype=np.uint64)).astype(np.float64) / 2**64
        found = found[np.argsort(-share * (0.2 + spread), kind="stable")[:most]]
    return found


def fit(found: np.ndarray, left: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeats x that bring the patterns' lengths closest to the histogram, by accelerated projected gradient steps."""
    target = left.astype(np.float64).copy()
    target[0] = 0
    used = found > 0

    def forward(x):
        out = np.bincount(found.ravel(), (np.broadcast_to(x[:, None], found.shape) * used).ravel(), len(target))
        out[0] = 0
        return out

    def backward(r):
        return (r[found] * used).sum(1)

    v = np.ones(len(found))
    for _ in range(12):
        v = backward(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / (np.linalg.norm(backward(forward(v))) * 1.05)
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * backward(forward(y) - target))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and repeats that use up the histogram: longest first, each into the fullest sequence that has room."""
    room: list[list] = [[] for _ in range(capacity + 1)]
    has = np.zeros(capacity + 1, bool)

    def put(space, pattern, n):
        room[space].append((pattern, n))
        has[space] = True

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(has[length:])
            if len(fits):
                space = length + int(fits[0])
                pattern, m = room[space].pop()
                has[space] = bool(room[space])
                k = min(n, m)
                if m > k:
                    put(space, pattern, m - k)
                put(space - length, (*pattern, length), k)
                n -= k
            else:
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, (length,) * each, n // each)
                if n % each:
                    put(capacity - n % each * length, (length,) * (n % each), 1)
                n = 0
    return [x for groups in room for x in groups]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), which use every piece once."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    for _ in range(ROUNDS):
        found = patterns(left, capacity, MOST_PATTERNS)
        if not len(found):
            break
        x = np.floor(fit(found, left) + 1e-6)
        order = [i for i in np.argsort(-x, kind="stable").tolist() if x[i] >= 1]
        placed = 0
        for i in order:
            pattern = tuple(v for v in found[i].tolist() if v)
            k = min(int(x[i]), *(int(left[v]) // pattern.count(v) for v in set(pattern)))
            if k:
                for v in pattern:
                    left[v] -= k
                out.append((pattern, k))
                placed += k
        if not placed:
            break
    return out + best_fit(left, capacity)


class Places:
    """Which ranks of each length go where."""

    def __init__(self, chosen: list[tuple[tuple[int, ...], int]], capacity: int):
        rank = [0] * (capacity + 1)
        rows = []
        sequence = 0
        for pattern, n in chosen:
            offset = 0
            for length in pattern:
                rows.append((length, rank[length], sequence, offset))
                rank[length] += n
                offset += length
            sequence += n
        self.n_sequences = sequence
        rows.sort()
        self.key = np.array([r[0] << 48 | r[1] for r in rows], np.int64)
        self.rank, self.sequence, self.offset = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 48 | rank, "right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with length, part and rank; written once before) and sequence_id and offset."""
    spark = pieces.sparkSession
    counts = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    sent = spark.sparkContext.broadcast(Places(plan(histogram, capacity), capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def dense(table: pa.Table) -> pa.Table:
        by_length = np.zeros(capacity + 1, np.int64)
        by_length[table.column("length").to_numpy()] = table.column("before").to_numpy()
        return pa.table([table.column("part")[:1], pa.array([by_length], pa.list_(pa.int64()))], names=["part", "_before"])

    # one row a task: how many pieces of each length the tasks before it have
    offsets = materialise(before.groupBy("part").applyInArrow(lean(dense), "part long, _before array<long>"))
    ranked = pieces.join(offsets, "part").withColumn("_rank", F.col("rank") + F.get("_before", F.col("length").cast("int"))).drop("_before", "part", "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "_rank") + ", sequence_id long, offset long"
    names = [c for c in ranked.columns if c != "_rank"]

    def run(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            sequence, offset = sent.value.of(get("length").to_numpy(), get("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*map(get, names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(lean(run), schema)


def pack_documents(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, (token_ids,) sequence_id, offset."""
    return pack(materialise(pieces_of(docs, path=path, capacity=capacity, with_ids=with_ids)), capacity=capacity)


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op3_pattern_packing": op3_pattern_packing}
