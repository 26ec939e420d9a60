"""Removal of byte strings that occur more than once, by suffix arrays.

A string of ``length`` bytes is removed wherever it occurs if it starts at two or more places of the corpus.

1. Anchors: of every run of ``window`` consecutive grams of ``length - window + 1`` bytes, the one with the smallest hash (rightmost of
   equals). Two equal strings of the given length have the same anchor at the same place, and the bytes around an anchor that can belong to
   such a string are its context: up to window - 1 on either side.
2. Each anchor's hash is asked for over the corpus (exchange.py). Held once: nothing repeats here.
3. The contexts of all other anchors are gathered, with the anchor as a single symbol of its own and bytes that stand or
   fall together as one symbol. Of equal contexts of an anchor two stand for all. They are joined to a text, its suffixes are sorted by linear grouping
   (gsaca.py), and what neighbours in the suffix array have in common, the anchor included, repeats. Contexts whose best matches on both sides together are too
   short leave before.

Defined results: null text is empty; texts shorter than length keep all bytes; strings are judged on the input; a repeated row
counts as another occurrence; kept bytes may end within a character; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledger.llm import exchange as X
from veriledger.llm import kernels as K
from veriledger.llm.gsaca import suffix_array
from veriledger.llm.small_ints import ints, small_ints
from veriledger.llm.storage import materialise, small_batches
from veriledger.llm.substrings import KEY, load, row_keys, save, with_row_key
from veriledger.llm.workers import lean

LENGTH, WINDOW = 200, 61
#: Buckets of contexts for each shuffle partition: contexts are far larger than hashes.
CONTEXT_BUCKETS = 8
#: Contexts that one suffix array holds; a group of more is taken apart.
MOST_CONTEXTS = 1500
SIDE = WINDOW - 1
STEP = 1 << 20


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each width consecutive keys."""
    out, done = keys, 1
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def anchors(prefix: np.ndarray, offsets: np.ndarray, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors over the chunk, and their hashes."""
    gram = length - window + 1
    n = len(prefix) - gram
    at = K.ranges(offsets[:-1], np.maximum(offsets[1:] - length + 1, offsets[:-1]))
    if n <= 0 or not len(at):
        return np.zeros(0, np.int64), np.zeros(0, K.U64)
    _, down = K._BYTES.to(len(prefix))
    hashes = K.mix((prefix[gram:] - prefix[:-gram]) * down[:n] + K.U64(gram))
    low = np.uint64(0xFFFFFFFF)
    keys = (hashes & ~low) | (low - np.arange(n, dtype=np.uint64))
    best = sliding_min(keys, window)[at]
    best = best[np.concatenate(([True], best[1:] != best[:-1]))]
    places = np.unique((low - (best & low)).astype(np.int64))
    return places, hashes[places]


def sides(places: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of context left and right of anchors in documents that span [low, high)."""
    return np.minimum(window - 1, places - low), np.minimum(window - 1, high - places - (length - window + 1))


def spans_of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (begin, end) of the union, overlapping and touching ones as one. starts need to ascend."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    reach = np.maximum.accumulate(ends)
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    begin = np.flatnonzero(new)
    return np.stack([starts[begin], reach[np.append(begin[1:], len(starts)) - 1]], 1)


def _table(rows: list[tuple]) -> pa.Table:
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["bucket", "chunk", "kind", "h", "r", "t"])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return _table(rows).combine_chunks().to_batches()[0]


def _rows(table: pa.Table) -> list[tuple]:
    return list(zip(*(table.column(c).to_pylist() for c in ("bucket", "chunk", "kind", "h", "r", "t")), strict=True))


def _ask_anchors(keys: np.ndarray):
    n_buckets = len(keys)

    def run(batches):
        chunks = X.Chunks()
        for batch in batches:
            for part, data, offsets in K.steps(batch, limit=STEP):
                chunk = chunks.new()
                prefix = K.prefix_hash(data)
                places, g = anchors(prefix, offsets)
                distinct, first, where, n = np.unique(g, return_index=True, return_inverse=True, return_counts=True)
                # numbered by where they come first
                by_place = np.argsort(first, kind="stable")
                number = np.empty(len(distinct), np.int64)
                number[by_place] = np.arange(len(distinct))
                own = number[where]
                g, first, n = distinct[by_place], first[by_place], n[by_place]
                bucket = X.bucket_of(g, n_buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                out = []
                for b in range(n_buckets):
                    s = order[cuts[b] : cuts[b + 1]]
                    if len(s):
                        out.append((int(keys[b]), chunk, X.ASK, X.pack(g[s], 5), (n[s] > 1).astype(np.uint8).tobytes(), None))
                again = np.ones(len(places), bool)
                again[first] = False
                skeleton = save(
                    **row_keys(part), offsets=offsets, gaps=np.frombuffer(small_ints(np.diff(places, prepend=0)), np.uint8),
                    bucket=bucket.astype(np.uint8 if n_buckets <= 256 else np.uint32), keys=keys, again=np.packbits(again), refs=own[again].astype(np.int32),
                )
                yield _batch([*out, (int(keys[chunk % n_buckets]), chunk, X.SKELETON, None, None, skeleton)])

    return run


def _judge(table: pa.Table) -> pa.Table:
    """Which anchors are held more than once."""
    rows = _rows(table)
    asked = [r for r in rows if r[2] == X.ASK]
    out = [r for r in rows if r[2] == X.SKELETON]
    if asked:
        gs = [X.unpack(r[3], 5) for r in asked]
        distinct, where, n = np.unique(np.concatenate(gs), return_inverse=True, return_counts=True)
        many = np.concatenate([np.frombuffer(r[4], np.uint8) for r in asked])
        said = (n + np.bincount(where, many, len(distinct)) > 1).astype(np.uint8)[where]
        cuts = np.concatenate(([0], np.cumsum([len(x) for x in gs])))
        out += [(r[0], r[1], X.ANSWER, None, said[cuts[i] : cuts[i + 1]].tobytes(), None) for i, r in enumerate(asked)]
    return _table(out)


OPEN = "did long, rk long, open binary"


def _places(table: pa.Table) -> pa.Table:
    """Of each document its repeated anchors, if it has some."""
    rows = _rows(table)
    s = load(next(r[5] for r in rows if r[2] == X.SKELETON))
    said = np.zeros(len(s["bucket"]), bool)
    for b, _, kind, _, answer, _ in rows:
        if kind == X.ANSWER:
            said[s["bucket"] == np.searchsorted(s["keys"], b)] = np.frombuffer(answer, np.uint8) > 0
    places = np.cumsum(ints(s["gaps"].tobytes()))
    again = np.unpackbits(s["again"], count=len(places)).astype(bool)
    own = np.zeros(len(places), np.int64)
    own[~again] = np.arange(len(said))
    own[again] = s["refs"]
    places = places[said[own]] if len(own) else places
    offsets = s["offsets"]
    cuts = np.searchsorted(places, offsets)
    some = np.flatnonzero(cuts[1:] > cuts[:-1])
    blobs = [(places[cuts[d] : cuts[d + 1]] - offsets[d]).astype("<u4").tobytes() for d in some.tolist()]
    return pa.table([pa.array(s["did"][some], pa.int64()), pa.array(s["rk"][some], pa.int64()), pa.array(blobs, pa.binary())], names=[*KEY, "open"])


def _ask_contexts(keys: np.ndarray):
    n_buckets = len(keys)
    gram = LENGTH - WINDOW + 1

    def run(batches):
        chunks = X.Chunks()
        for batch in batches:
            for part, data, offsets in K.steps(batch, limit=STEP):
                chunk = chunks.new()
                prefix = K.prefix_hash(data)
                blobs = part.column(part.schema.get_field_index("open")).to_pylist()
                own = [np.frombuffer(b, "<u4").astype(np.int64) + offsets[d] for d, b in enumerate(blobs)]
                places = np.concatenate(own)
                doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
                left, right = sides(places, offsets[doc], offsets[doc + 1])
                g = K.span_hash(prefix, places, places + gram)
                context = K.mix(K.span_hash(prefix, places - left, places + gram + right) + left.astype(K.U64) + g)
                _, first, where, n = np.unique(context, return_index=True, return_inverse=True, return_counts=True)
                order = np.argsort(g[first], kind="stable")
                number = np.empty(len(first), np.int64)
                number[order] = np.arange(len(first))
                first, n = first[order], n[order]
                around = np.zeros((len(first), 2 * SIDE), np.uint8)
                column = np.arange(SIDE)
                l, r, p = left[first], right[first], places[first]
                at = p[:, None] - SIDE + column
                around[:, :SIDE] = np.where(column >= SIDE - l[:, None], data[np.clip(at, 0, len(data) - 1)], 0)
                at = p[:, None] + gram + column
                around[:, SIDE:] = np.where(column < r[:, None], data[np.clip(at, 0, len(data) - 1)], 0)
                notes = np.stack([l, r, n > 1], 1).astype(np.uint8)
                g = g[first]
                cuts = np.searchsorted(X.bucket_of(g, n_buckets), np.arange(n_buckets + 1))
                out = []
                for b in range(n_buckets):
                    s = slice(cuts[b], cuts[b + 1])
                    if s.start < s.stop:
                        out.append((int(keys[b]), chunk, X.ASK, X.pack(g[s], 8), notes[s].tobytes(), around[s].tobytes()))
                skeleton = save(**row_keys(part), doc=doc.astype(np.int32), places=(places - offsets[doc]).astype("<u4"), own=number[where].astype(np.int32))
                yield _batch([*out, (int(keys[chunk % n_buckets]), chunk, X.SKELETON, None, None, skeleton)])

    return run


def _shared(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by group and bytes, how many leading bytes each row shares with the next one, and whether that is of its group."""
    order = np.lexsort((np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), group))
    shared = np.empty(max(0, len(order) - 1), np.int64)
    for at in range(0, len(shared), 100_000):
        r = rows[order[at : at + 100_001]]
        shared[at : at + 100_000] = np.cumprod(r[1:] == r[:-1], axis=1, dtype=np.uint8).sum(1)
    return order, shared, group[order][1:] == group[order][:-1]


def _best(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How many leading bytes each row has in common with another of its group at most."""
    order, shared, inside = _shared(rows, group)
    shared = shared * inside
    out = np.zeros(len(rows), np.int64)
    out[order[1:]] = shared
    out[order[:-1]] = np.maximum(out[order[:-1]], shared)
    return out


def _cuts(rows: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Sorted group * 64 + n for all n > 0 such that two rows of the group part after n bytes, or a document ends there."""
    order, shared, inside = _shared(rows, group)
    short = size < rows.shape[1]
    found = np.concatenate([group[order][1:][inside] * 64 + shared[inside], group[short] * 64 + size[short]])
    return np.unique(found[found % 64 > 0])


def repeated_windows(around: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For contexts, the offsets (bits) of windows that another one of the same group has too. group ascends."""
    return _windows(np.ascontiguousarray(around[:, :SIDE][:, ::-1]), np.ascontiguousarray(around[:, SIDE:]), left, right, group)


def _windows(before: np.ndarray, after: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Bit o: the o nearest bytes after, and all but o of those before, are the same in another row of the group.

    A group of more than MOST_CONTEXTS rows is taken apart by what its windows have in common: those of the lower half of the
    offsets share the nearest bytes before, those of the upper half the nearest bytes after.
    """
    n, side = before.shape
    bits = np.zeros(n, np.uint64)
    if n < 2:
        return bits
    if side == 0:
        bits[np.bincount(group)[group] > 1] = 1
        return bits
    chosen = np.flatnonzero((_best(before, group) + _best(after, group) >= side) & (left + right >= side))
    if len(chosen):  # those alone in their group now have no partner
        size = np.bincount(group[chosen], minlength=group.max() + 1)[group[chosen]]
        large, chosen = chosen[size > MOST_CONTEXTS], chosen[(size > 1) & (size <= MOST_CONTEXTS)]
        if len(large):
            half = (side - 1) // 2
            for lower in (True, False):
                common = side - half if lower else half + 1
                own = large[(left if lower else right)[large] >= common]
                near = K.row_hashes((before if lower else after)[own, :common])
                key = np.unique(K.mix(near + group[own].astype(np.uint64) * K.U64(0x9E3779B97F4A7C15)), return_inverse=True)[1]
                order = np.argsort(key, kind="stable")
                own, key = own[order], key[order]
                if lower:
                    parts = before[own, common:], after[own, :half], left[own] - common, np.minimum(right[own], half)
                else:
                    rest = side - common
                    parts = before[own, :rest], after[own, common:], np.minimum(left[own], rest), right[own] - common
                bits[own] |= _windows(*parts, key) << np.uint64(0 if lower else common)
    begin = 0
    while begin < len(chosen):
        end = min(begin + MOST_CONTEXTS, len(chosen))
        while end < len(chosen) and group[chosen[end - 1]] == group[chosen[end]]:  # whole groups only
            end -= 1
        own = chosen[begin:end]
        bits[own] |= _sorted_windows(before[own], after[own], left[own], right[own], np.unique(group[own], return_inverse=True)[1])
        begin = end
    return bits


def _sorted_windows(before: np.ndarray, after: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Through the suffix array of all contexts, written from the outside in and out again with the anchor in between.

    Bytes between two places at which rows of a group part stand or fall together, so they are one symbol: that of all
    bytes from the anchor to the farther place. before: bytes left of the anchor, nearest first; after: bytes right of it.
    """
    n, side = before.shape
    text, cut_at, lengths = [], [], []
    for rows, size in ((before, left), (after, right)):
        cuts = _cuts(rows, size, group)
        low, high = np.searchsorted(cuts, group * 64), np.searchsorted(cuts, group * 64 + size, "right")
        context = np.repeat(np.arange(n), high - low)
        at = K.ranges(low, high)
        value = cuts[at] % 64
        prefix = K.prefix_hash(rows.ravel())
        text.append(K.span_hash(prefix, context * side, context * side + value))
        cut_at.append(value)
        lengths.append(high - low)
    n_left, n_right = lengths
    width = n_left + n_right + 2
    begin = np.concatenate(([0], np.cumsum(width)))
    flat, bytes_at = np.zeros(begin[-1], np.uint64), np.zeros(begin[-1], np.int64)
    anchor = begin[:-1] + n_left
    # nearest symbols are next to the anchor on both sides
    inner = np.arange(len(cut_at[0])) - np.repeat(np.concatenate(([0], np.cumsum(n_left)[:-1])), n_left)
    place = np.repeat(anchor, n_left) - 1 - inner
    flat[place], bytes_at[place] = K.mix(text[0] + K.U64(1)), cut_at[0]
    outer = np.arange(len(cut_at[1])) - np.repeat(np.concatenate(([0], np.cumsum(n_right)[:-1])), n_right)
    place = np.repeat(anchor, n_right) + 1 + outer
    flat[place], bytes_at[place] = K.mix(text[1] + K.U64(2)), cut_at[1]
    flat[anchor] = K.mix(group.astype(np.uint64) + K.U64(3 << 32))
    symbols = np.unique(flat, return_inverse=True)[1]
    order = suffix_array(symbols)
    context = np.repeat(np.arange(n), width)
    # suffixes that start left of the anchor or at it, beside a neighbour whose anchor is as near
    to_anchor = anchor[context] - np.arange(len(flat))
    a, b = order[:-1], order[1:]
    fine = (to_anchor[a] >= 0) & (to_anchor[a] == to_anchor[b]) & (group[context[a]] == group[context[b]])
    a, b = a[fine], b[fine]
    common = np.zeros(len(a), np.int64)
    most = np.minimum(to_anchor[a] + 1 + n_right[context[a]], to_anchor[b] + 1 + n_right[context[b]])
    open_ = np.arange(len(a))
    step = 0
    while len(open_):
        open_ = open_[most[open_] > step]
        open_ = open_[symbols[a[open_] + step] == symbols[b[open_] + step]]
        common[open_] = step = step + 1
    beyond = common - to_anchor[a] - 1
    a, b, beyond = a[beyond >= 0], b[beyond >= 0], beyond[beyond >= 0]
    bits = np.zeros(n, np.uint64)
    for start in (a, b):
        own = context[start]
        l = np.where(to_anchor[start] > 0, bytes_at[start], 0)
        r = np.where(beyond > 0, bytes_at[anchor[own] + beyond], 0)
        low, high = side - l, r
        some = low <= high
        mask = ((K.U64(1) << (high[some] + 1).astype(np.uint64)) - K.U64(1)) & ~((K.U64(1) << low[some].astype(np.uint64)) - K.U64(1))
        np.bitwise_or.at(bits, own[some], mask)
    return bits


def _solve(table: pa.Table) -> pa.Table:
    rows = _rows(table)
    asked = [r for r in rows if r[2] == X.ASK]
    out = [r for r in rows if r[2] == X.SKELETON]
    if asked:
        gs = [X.unpack(r[3], 8) for r in asked]
        ends = np.cumsum([len(x) for x in gs])
        g = np.concatenate(gs)
        notes = np.concatenate([np.frombuffer(r[4], np.uint8).reshape(-1, 3) for r in asked])
        around = np.concatenate([np.frombuffer(r[5], np.uint8).reshape(-1, 2 * SIDE) for r in asked])
        print_ = K.mix(K.row_hashes(around) + K.mix(g + notes[:, 0].astype(K.U64) * K.U64(256) + notes[:, 1].astype(K.U64)))
        _, first, where, n = np.unique(print_, return_index=True, return_inverse=True, return_counts=True)
        twice = n + np.bincount(where, notes[:, 2], len(first)) > 1
        # an equal context elsewhere stands beside this one
        both = np.concatenate([first, first[twice]])
        order = np.argsort(g[both], kind="stable")
        group = np.unique(g[both[order]], return_inverse=True)[1]
        left, right = notes[both, 0].astype(np.int64), notes[both, 1].astype(np.int64)
        bits = np.empty(len(both), np.uint64)
        bits[order] = repeated_windows(around[both[order]], left[order], right[order], group)
        said = bits[where]
        out += [(r[0], r[1], X.ANSWER, None, said[a:b].tobytes(), None) for r, a, b in zip(asked, [0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    return _table(out)


def _found(table: pa.Table) -> pa.Table:
    rows = _rows(table)
    s = load(next(r[5] for r in rows if r[2] == X.SKELETON))
    answers = sorted((r[0], r[4]) for r in rows if r[2] == X.ANSWER)
    bits = np.concatenate([np.frombuffer(a, np.uint64) for _, a in answers]) if answers else np.zeros(0, np.uint64)
    each = bits[s["own"]]
    shift = np.arange(WINDOW, dtype=np.uint64)
    some, spans = [], []
    cuts = np.searchsorted(s["doc"], np.arange(len(s["rk"]) + 1))
    for d in np.unique(s["doc"][each > 0]).tolist():
        a, b = cuts[d], cuts[d + 1]
        row, offset = np.nonzero((each[a:b, None] >> shift) & np.uint64(1))
        starts = np.unique(s["places"][a:b].astype(np.int64)[row] - SIDE + offset)
        some.append(d)
        spans.append(spans_of(starts, starts + LENGTH).astype("<u4").tobytes())
    return pa.table([pa.array(s["did"][some], pa.int64()), pa.array(s["rk"][some], pa.int64()), pa.array(spans, pa.binary())], names=[*KEY, "found"])


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(did, rk, found): byte spans to remove, for each key that has some; keyed from with_row_key()."""
    keys = X.bucket_keys(keyed.sparkSession)
    asked = keyed.select("text", *KEY).mapInArrow(lean(_ask_anchors(keys)), X.SCHEMA)
    judged = asked.groupBy("bucket").applyInArrow(lean(_judge), X.SCHEMA).groupBy("chunk").applyInArrow(lean(_places), OPEN)
    waiting = materialise(judged.groupBy(*KEY).agg(F.max("open").alias("open")))
    # each copy of a row is an occurrence of its own, as in the tables
    # merged, so that rows come in the order of their key and a task that runs again numbers its chunks as before
    texts = keyed.join(waiting.hint("merge"), KEY).select("text", *KEY, "open")
    contexts = texts.mapInArrow(lean(_ask_contexts(X.bucket_keys(keyed.sparkSession, CONTEXT_BUCKETS))), X.SCHEMA)
    found = contexts.groupBy("bucket").applyInArrow(lean(_solve), X.SCHEMA).groupBy("chunk").applyInArrow(lean(_found), "did long, rk long, found binary")
    return found.groupBy(*KEY).agg(F.max("found").alias("found"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, removed (maximal removed runs of bytes as begin, end) and kept (the remaining bytes)."""
    small_batches(docs.sparkSession)
    keyed = with_row_key(docs)
    spans = materialise(repeated_spans(keyed))
    runs = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for batch in batches:
            for part, data, offsets in K.steps(batch):
                removed: list[list] = []
                gone = np.zeros(len(data) + 1, np.int64)
                for d, found in enumerate(part.column(2).to_pylist()):
                    own = np.frombuffer(found or b"", "<u4").astype(np.int64).reshape(-1, 2)
                    removed.append([{"begin": a, "end": b} for a, b in own.tolist()])
                    gone[own[:, 0] + offsets[d]] += 1
                    np.add.at(gone, own[:, 1] + offsets[d], -1)
                keep = np.cumsum(gone[:-1]) == 0
                at = np.concatenate(([0], np.cumsum(keep)))[offsets].astype(np.int32)
                kept = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data[keep].tobytes())])
                yield pa.RecordBatch.from_arrays([K.long_of(part.column(0)), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, runs), kept], ["doc_id", "n_bytes", "removed", "kept"])

    joined = keyed.join(spans.hint("shuffle_hash"), KEY, "left").select("doc_id", "text", "found")
    return joined.mapInArrow(lean(cut), "doc_id long, n_bytes long, removed array<struct<begin:long,end:long>>, kept binary")


def op4_suffix_grouping_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return kept.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op4_suffix_grouping_dedup": op4_suffix_grouping_dedup}
SQL = {
    "op4_suffix_grouping_dedup": """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT k, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM d, LATERAL (SELECT unnest(range(0, length(h) // 2 - 199)) AS i) WHERE length(h) // 2 >= 200),
t AS (SELECT k, i FROM g WHERE m IN (SELECT m FROM g GROUP BY m HAVING count(*) > 1)),
s AS (SELECT k, i, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + 200 THEN 0 ELSE 1 END AS first FROM t),
r AS (SELECT k, i, sum(first) OVER (PARTITION BY k ORDER BY i) AS run FROM s),
x AS (SELECT k, run, min(i) AS b, max(i) + 200 AS e FROM r GROUP BY k, run),
y AS (SELECT k, count(*) AS n, sum(e - b) AS gone, list(b ORDER BY b) AS bs, list(e ORDER BY b) AS es FROM x GROUP BY k),
z AS (SELECT d.k, array_to_string(list_transform(range(1, n + 2), lambda j: substr(h, 2 * (CASE WHEN j = 1 THEN 0 ELSE es[j - 1] END) + 1,
  2 * ((CASE WHEN j > n THEN length(h) // 2 ELSE bs[j] END) - (CASE WHEN j = 1 THEN 0 ELSE es[j - 1] END)))), '') AS kept FROM d JOIN y USING (k))
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN y USING (k) LEFT JOIN z USING (k)"""
}
