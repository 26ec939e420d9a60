"""BPE encoding and decoding of whole texts through a table of distinct words.

Tasks cut texts into words (the pre-tokens of a byte-level vocabulary) and note for each text where its words stand in the list of distinct words of its part
(some millions of words of one task). Those lists, not the texts, are dealt by hash: each distinct word of the corpus meets in one place and is encoded once,
and every part gets the ids of its words back, in order. What was noted then turns into ids, by position. The notes lie in a table that is bucketed by
part, so they are not shuffled; what moves is one entry for each distinct word of a part, however often texts repeat it, so a hot word is no hot key.

Decoding maps ids to pieces through the vocabulary's id-to-piece table. That table is as long as the vocabulary, whatever the corpus, so its join is a lookup in each task.

Defined results: null and empty texts have no ids and decode to an empty text; a special token's string in a text is its id, as in the library; bytes that are no UTF-8 decode to
replacement characters; ids outside the vocabulary are left out; null ids decode to an empty text; repeated rows and equal or null doc_ids are rows of their own; other columns are not read;
an empty table gives no rows. A word may be as long as a text.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledger.llm import kernels as K
from veriledger.llm.exchange import bucket_of
from veriledger.llm.packing import vocabulary
from veriledger.llm.small_ints import ints, small_ints
from veriledger.llm.storage import materialise, scope, small_batches
from veriledger.llm.tokenise import Tokeniser, byte_of
from veriledger.llm.workers import lean, release
from veriledger.storage import materialise_bucketed

#: Words of a part, and bytes of text that are cut at once.
PART_WORDS, STEP = 6_000_000, 2 << 20
#: Bytes of distinct words (summed over parts) that a task of the encoding takes.
BUCKET_BYTES = 4 << 20
#: A vocabulary beyond this is not sent to workers.
MOST_PIECES = 4_000_000
#: Numbers turned into ids at once.
GATHER = 1_000_000


def _planes(numbers: np.ndarray, width: int) -> bytes:
    """The lowest bytes of all numbers, then the next ones: small numbers leave runs of zeros."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()


def _numbers(blob: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(width, -1)
    return sum(planes[i].astype(np.int64) << (8 * i) for i in range(width))


class Cutter(Tokeniser):
    """Cuts texts into words; a special token is a word."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that depend on what is around them are not supported")
        self.special_ids = {t["content"].encode(): t["id"] for t in added}
        self.any_special = re.compile(b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start byte of each word, and each text's first word (n + 1 entries)."""
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        size = 1 + (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000)
        byte_at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(size, out=byte_at[1:])
        edges, inside = offsets[:-1], np.zeros(0, np.int64)
        if any(s in raw for s in self.special):
            spans = [(a + m.start(), a + m.end()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.any_special.finditer(raw[a:b])]
            begin, end = np.array(spans, np.int64).reshape(-1, 2).T
            edges = np.unique(np.concatenate([edges, begin, end]))
            inside = K.ranges(begin + 1, end)
        starts = byte_at[self.starts(points, np.searchsorted(byte_at, edges))]
        if len(inside):
            starts = starts[~np.isin(starts, inside)]
        return starts, np.searchsorted(starts, offsets)

    def ids_of(self, word: bytes) -> list[int]:
        special = self.special_ids.get(word)
        return self.pieces._encode_single_piece(word) if special is None else [special]


@functools.cache
def cutter_of(path: str) -> Cutter:
    """One of each vocabulary in a worker."""
    return Cutter(path)


def _part_rows(part: int, kept: list, words: list[bytes], counts: np.ndarray, key: pa.DataType):
    """Batches of a part's documents, their words by rank (frequent ones first), and of its words in the order of their hashes with the rank of each."""
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))
    names = ["part", "doc_id", "at", "words", "lengths", "places"]
    none = lambda n: pa.nulls(n, pa.binary())
    for ids, where, first in kept:
        at = rank[where]
        width = max(1, (int(at.max()).bit_length() + 7) // 8) if len(at) else 1
        blobs = [bytes([width]) + _planes(at[a:b], width) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        n = len(blobs)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), ids, pa.array(blobs, pa.binary()), none(n), none(n), none(n)], names)
    lengths = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(lengths)
    order = np.argsort(K.word_hashes(data, ends - lengths, ends), kind="stable")
    blob = b"".join([words[i] for i in order.tolist()])
    yield pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.nulls(1, key), none(1), pa.array([blob], pa.binary()), pa.array([small_ints(lengths[order])], pa.binary()), pa.array([_planes(rank[order], 4)], pa.binary())], names
    )


def parts_of(docs: DataFrame, path: str, *, part_words: int = PART_WORDS) -> DataFrame:
    """Rows of documents (part, doc_id, at) and one row of each part's distinct words (part, words, lengths, places)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        cutter, context = cutter_of(path), TaskContext.get()
        task, epoch = context.partitionId() if context else 0, 0
        known, words, counts, kept, held = {}, [], np.zeros(0, np.int64), [], 0
        key = None
        for batch in batches:
            key = batch.column(0).type
            for rows, data, offsets in K.steps(batch, limit=STEP):
                starts, first = cutter.cut(data, offsets)
                ends = np.append(starts[1:], len(data))
                hashes = K.word_hashes(data, starts, ends)
                distinct, sample, where, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                raw, own = data.tobytes(), []
                for h, a, b in zip(distinct.tolist(), starts[sample].tolist(), ends[sample].tolist(), strict=True):
                    i = known.get(h)
                    if i is None:
                        i = known[h] = len(words)
                        words.append(raw[a:b])
                    own.append(i)
                own = np.array(own, np.int64)
                counts = np.concatenate([counts, np.zeros(len(words) - len(counts), np.int64)])
                counts[own] += n
                kept.append((rows.column(0), own[where].astype(np.int32) if len(own) else np.zeros(0, np.int32), first))
                held += len(starts)
                if held >= part_words:
                    yield from _part_rows(task << 24 | epoch, kept, words, counts, key)
                    known, words, counts, kept, held, epoch = {}, [], np.zeros(0, np.int64), [], 0, epoch + 1
        if kept:
            yield from _part_rows(task << 24 | epoch, kept, words, counts, key)

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"part long, doc_id {kind}, at binary, words binary, lengths binary, places binary")


def encoded_words(parts: DataFrame, path: str, *, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(part, bucket, counts, ids): of a part's words with hashes in a bucket's range, in order, the number of ids and the ids. Each distinct word is encoded once.

    A part sends one row for each bucket that it has words of, so rows never outnumber its distinct words. Buckets are as many as the words' bytes need.
    """
    lists = parts.where("words IS NOT NULL").select("part", "words", "lengths")
    spark = parts.sparkSession
    total = lists.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).collect()[0][0]
    n = max(-(-total // bucket_bytes), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def deal(batches):
        for batch in batches:
            for part, blob, sizes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lengths = ints(sizes)
                ends = np.cumsum(lengths)
                bucket = bucket_of(K.word_hashes(np.frombuffer(blob, np.uint8), ends - lengths, ends), n)
                found, first = np.unique(bucket, return_index=True)
                edge = np.append(first, len(bucket))
                at = np.concatenate(([0], ends))[edge]
                own = [[blob[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], [small_ints(lengths[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), part)), *(pa.array(x, pa.binary()) for x in own)], ["bucket", "part", "words", "lengths"])

    def encode(table: pa.Table) -> pa.Table:
        cutter, known, out = cutter_of(path), {}, ([], [])
        for blob, sizes in zip(table.column("words").to_pylist(), table.column("lengths").to_pylist(), strict=True):
            ids, counts, at = [], [], 0
            for length in ints(sizes).tolist():
                word = blob[at : at + length]
                at += length
                own = known.get(word)
                if own is None:
                    own = known[word] = cutter.ids_of(word)
                ids += own
                counts.append(len(own))
            out[0].append(small_ints(np.array(counts, np.int64)))
            out[1].append(np.array(ids, "<u4").tobytes())
        return pa.table([table.column("part"), table.column("bucket"), *(pa.array(x, pa.binary()) for x in out)], names=["part", "bucket", "counts", "ids"])

    dealt = lists.mapInArrow(lean(deal), "bucket long, part long, words binary, lengths binary")
    return dealt.groupBy("bucket").applyInArrow(lean(encode), "part long, bucket long, counts binary, ids binary")


def encode(docs: DataFrame, *, path: str | None = None, part_words: int = PART_WORDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, token_ids array<int>) of every row of docs (doc_id of any type, text), equal to the ids of the tokenizers library without special tokens around them."""
    path = path or vocabulary()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialise_bucketed(parts_of(docs, path, part_words=part_words), n, "part")
    answers = materialise(encoded_words(parts, path, bucket_bytes=bucket_bytes))
    kind = parts.schema["doc_id"].dataType.simpleString()

    def by_position(noted: pa.Table, found: pa.Table) -> pa.Table:
        is_list = np.array(noted.column("places").is_valid())
        docs_, lists = noted.filter(pa.array(~is_list)), noted.filter(pa.array(is_list))
        found = found.sort_by("bucket")
        counts = np.concatenate([np.zeros(0, np.int64), *map(ints, found.column("counts").to_pylist())])
        pool = np.frombuffer(b"".join(found.column("ids").to_pylist()), "<u4").astype(np.int32)
        places = _numbers(lists.column("places")[0].as_py(), 4)
        first, width = np.empty(len(counts), np.int64), np.empty(len(counts), np.int64)
        first[places], width[places] = np.cumsum(counts) - counts, counts
        batches, a = [], 0
        blobs, keys = docs_.column("at").to_pylist(), docs_.column("doc_id").combine_chunks()
        while a < len(blobs):
            b, held = a, 0
            while b < len(blobs) and held < GATHER:
                held += len(blobs[b])
                b += 1
            at = [_numbers(x[1:], x[0]) for x in blobs[a:b]]
            n_words = np.array([len(x) for x in at])
            at = np.concatenate(at)
            ids = pool[K.ranges(first[at], first[at] + width[at])]
            total = np.concatenate(([0], np.cumsum(width[at])))[np.concatenate(([0], np.cumsum(n_words)))]
            batches.append(pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(ids))], ["doc_id", "token_ids"]))
            a = b
        release()
        return pa.Table.from_batches(batches)

    return parts.drop("words", "lengths").groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(by_position, f"doc_id {kind}, token_ids array<int>")


def pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The id-to-piece table: bytes of all pieces, and where the piece of each id starts and ends (nothing for unknown ids)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    of = byte_of()
    named = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
    if max(named, default=0) > MOST_PIECES:
        raise ValueError(f"a vocabulary of more than {MOST_PIECES} ids is not sent to workers")
    raw = [b""] * (max(named, default=-1) + 1)
    for i, t in named.items():
        raw[i] = bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], ends[:-1])) if len(raw) else ends, ends


def decode(encoded: DataFrame, *, path: str | None = None, ids: str = "token_ids") -> DataFrame:
    """encoded with decoded: the text of its ids, special tokens included."""
    spark = encoded.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(pieces(path or vocabulary()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields) + ", decoded string"

    def run(batches):
        data, first, last = sent.value
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            n = np.array(lists.value_lengths().fill_null(0), np.int64)
            flat = np.array(lists.flatten().fill_null(-1), np.int64)
            edges = np.concatenate(([0], np.cumsum(n)))
            texts, a = [], 0
            while a < len(n):
                b = max(a + 1, int(np.searchsorted(edges, edges[a] + GATHER, "right")) - 1)
                own = flat[edges[a] : edges[b]]
                known = (own >= 0) & (own < len(first))
                at = np.where(known, own, 0)
                start, end = (first[at], np.where(known, last[at], first[at])) if len(first) else (at, at)
                raw = data[K.ranges(start, end)].tobytes()
                cut = np.concatenate(([0], np.cumsum(end - start)))[edges[a : b + 1] - edges[a]].tolist()
                texts += [raw[x:y].decode("utf-8", "replace") for x, y in zip(cut[:-1], cut[1:], strict=True)]
                a = b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(lean(run), schema)


def op11_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scope(spark) as kept:
        done = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
        decimal = F.array_join(F.col("token_ids").cast("array<string>"), ",")
        kept.append(materialise(done.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))))
    return kept[0]


QUERIES = {"op11_distinct_word_bpe": op11_distinct_word_bpe}
