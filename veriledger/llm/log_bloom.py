"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of word pairs over all training rows are quantised to levels, each a fourth root of two above the one before (counts up to
5 have a level of their own), and the n-gram is put into a Bloom filter once for each level up to its own. Asking level after level until one is
not there gives the level back, with one-sided errors. The filter is cut into ranges of the n-gram hash. Each range is
as long as its counted insertions need, so every word and every pair goes in whatever the corpus. The first level takes log2(V) + SPARE probes: of the V words that might follow one, those that
do not are then almost never taken for seen, and probabilities sum to 1 for any V; the levels above take PROBES. A range
is filled and asked in the task that counts it: chunks of text send their n-grams to the ranges and get levels back, so no
filter is broadcast or collected.

A level stands for the mean count of the n-grams that the filter gives it, so levels' counts add up to the corpus's. The probability of a word w after v is
(c(v w) + MU * p(w)) / (c(v) + MU), with p(w) = (c(w) + 1) / (N + V + 1) over known words, and one unknown word: p sums to 1. c(w) and c(v w) come from the filter.

Exact word counts, for the base score and for c(v), come from the same counting, answered with the levels as in exchange.py.

Defined results: null text is empty: one end token. Words are told apart by 64-bit hashes. Repeated rows count again as
training text and get equal results. With no training rows all counts are 0. A text of any length is one document. An empty table gives none.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledger.llm import exchange as X
from veriledger.llm import kernels as K
from veriledger.llm.langid import fold
from veriledger.llm.small_ints import ints, small_ints
from veriledger.llm.storage import materialise, small_batches
from veriledger.llm.substrings import load, save
from veriledger.llm.workers import lean

#: MU: of 1 to 2000, the one with the best held-out probability on the test tables was 500.
PROBES, SPARE, MU = 6, 4, 500.0
#: The least count of each level from 1.
LEAST = np.unique(np.ceil(2.0 ** (np.arange(4 * 60) / 4) - 1e-9).astype(np.int64))
END = np.uint64(0x5BD1E995C2B2AE3D)
PAIRS, SUMS = 3, 4
#: Longer chunks than elsewhere: a word goes out once for each chunk.
CHUNK_BYTES = 4 << 20
SCHEMA = X.SCHEMA


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's words and one end, and each document's first token."""
    data = K.lower(data)
    starts, ends, firsts = K.words(data, offsets)
    hashes = K.word_hashes(data, starts, ends)
    n = len(offsets) - 1
    first = firsts + np.arange(n + 1)
    out = np.full(len(hashes) + n, END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[first[1:] - 1] = False
    out[inside] = hashes
    return out, first


def pairs(tokens_: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before; a document's first follows an end."""
    before = np.empty_like(tokens_)
    before[1:], before[:1] = tokens_[:-1], END
    before[first[:-1]] = END
    return K.mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens_), before


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEAST, counts, "right")


def sums_of(levels: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many n-grams have each level, and their counts: two rows of 256."""
    return np.stack([np.bincount(levels, minlength=256), np.bincount(levels, counts, 256).astype(np.int64)])


def means_of(sums: np.ndarray) -> np.ndarray:
    """The count that each level stands for: its mean, or its least where no counted n-gram has it."""
    least = np.concatenate(([0], LEAST, np.full(255 - len(LEAST), LEAST[-1]))).astype(np.float64)
    out = np.where(sums[0] > 0, sums[1] / np.maximum(sums[0], 1), least)
    out[0] = 0
    return out


def halves(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    a = K.mix(keys + np.uint64(level * 0xA0761D6478BD642F % 2**64))
    return a, K.mix(a) | np.uint64(1)


def first_probes(n_words: int) -> int:
    """Probes of the first level where so many words are known."""
    return max(PROBES, math.ceil(math.log2(n_words + 2)) + SPARE)


def places(keys: np.ndarray, level: int, bits: int, probes: int):
    a, b = halves(keys, level)
    for i in range(probes):
        yield ((a + np.uint64(i) * b) % np.uint64(bits)).astype(np.int64)


def bits_for(word_counts: np.ndarray, pair_counts: np.ndarray, first: int) -> int:
    """The length of a range with room for all of its insertions, first probes for each n-gram's first level."""
    n = len(word_counts) + len(pair_counts)
    above = int(levels_of(word_counts).sum()) + int(levels_of(pair_counts).sum()) - n
    return max(64, math.ceil((n * first + above * PROBES) / 0.69))


def fill(words: np.ndarray, word_counts: np.ndarray, pair_keys: np.ndarray, pair_counts: np.ndarray, bits: int, first: int) -> np.ndarray:
    """One range of the filter. All counts are above 0."""
    word_levels, pair_levels = levels_of(word_counts), levels_of(pair_counts)
    out = np.zeros(bits, bool)
    for keys, levels in ((words, word_levels), (pair_keys, pair_levels)):
        for level in range(1, int(levels.max(initial=0)) + 1):
            some = keys[levels >= level]
            for at in places(some, level, bits, first if level == 1 else PROBES):
                out[at] = True
    return np.packbits(out, bitorder="little")


class Filter:
    def __init__(self, data: np.ndarray, bits: int, most: int, first: int):
        """data: the bits of one range, of which there are bits; most: the largest level in it; first: probes of the first level."""
        self.data, self.bits, self.most, self.first = data, bits, most, first

    def levels(self, keys: np.ndarray) -> np.ndarray:
        levels = np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        for level in range(1, self.most + 1):
            a, b = halves(keys[open_], level)
            for i in range(self.first if level == 1 else PROBES):
                at = ((a + np.uint64(i) * b) % np.uint64(self.bits)).astype(np.int64)
                there = (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                open_, a, b = open_[there], a[there], b[there]
            if not len(open_):
                break
            levels[open_] = level
        return levels


def _pair_key(hashes: np.ndarray) -> np.ndarray:
    """Pairs travel as 32 bits and their bucket."""
    return (hashes & np.uint64(0xFFFFFFFF)) | np.uint64(1) << np.uint64(40)


def _ask(bucket_keys: np.ndarray):
    n_buckets = len(bucket_keys)

    def run(batches):
        chunks = X.Chunks()
        for batch in batches:
            for part, data, offsets in K.steps(batch, limit=CHUNK_BYTES):
                chunk = chunks.new()
                t, first = tokens(data, offsets)
                n_docs = len(offsets) - 1
                doc = np.repeat(np.arange(n_docs), np.diff(first))
                held = np.asarray(part.column(2).to_numpy(zero_copy_only=False), bool)
                training = ~held[doc]
                words, where = np.unique(t, return_inverse=True)
                counts = np.bincount(where[training], minlength=len(words))
                # frequent words get small numbers
                order = np.argsort(-np.bincount(where, minlength=len(words)), kind="stable")
                rank = np.empty(len(words), np.int64)
                rank[order] = np.arange(len(words))
                number, ids = rank[where], part.column(0)
                skeleton = save(
                    ids=K.long_of(ids).fill_null(0).to_numpy(zero_copy_only=False), null=np.asarray(ids.is_null()), held=held, n=np.diff(first), words=words[order],
                    numbers=np.frombuffer(zlib.compress(np.minimum(number, 65535).astype("<u2").tobytes(), 1), np.uint8), wide=number[number >= 65535],
                )
                p, _ = pairs(t, first)
                pair, pair_where = np.unique(p, return_inverse=True)
                pair_counts = np.bincount(pair_where[training], minlength=len(pair))
                rows: dict[str, list] = {c: [] for c in ("bucket", "kind", "h", "r", "t")}
                for kind, keys, n, width in ((X.ASK, words, counts, 8), (PAIRS, pair, pair_counts, 4)):
                    cuts = np.searchsorted(X.bucket_of(keys, n_buckets), np.arange(n_buckets + 1))
                    for b in range(n_buckets):
                        if cuts[b] < cuts[b + 1]:
                            s = slice(cuts[b], cuts[b + 1])
                            for name, value in (("bucket", int(bucket_keys[b])), ("kind", kind), ("h", X.pack(keys[s], width)), ("r", small_ints(n[s])), ("t", None)):
                                rows[name].append(value)
                for name, value in (("bucket", int(bucket_keys[chunk % n_buckets])), ("kind", X.SKELETON), ("h", None), ("r", None), ("t", skeleton)):
                    rows[name].append(value)
                k = len(rows["kind"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["bucket"], pa.int32()), pa.array([chunk] * k, pa.int64()), pa.array(rows["kind"], pa.int32()), *[pa.array(rows[c], pa.binary()) for c in ("h", "r", "t")]],
                    ["bucket", "chunk", "kind", "h", "r", "t"],
                )

    return run


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(where, np.concatenate(counts), len(distinct)).astype(np.int64), where


def _count(n_ranges: int):
    """Of one range: words are spread evenly over ranges by their hashes, so its own times n_ranges are those of the corpus."""

    def one(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("bucket", "chunk", "kind", "h", "r")), strict=True))
        asked, paired = ([r for r in rows if r[2] == kind] for kind in (X.ASK, PAIRS))
        keys, pair_keys = [X.unpack(r[3], 8) for r in asked], [_pair_key(X.unpack(r[3], 4)) for r in paired]
        words, counts, where = _sums(keys, [ints(r[4]) for r in asked])
        pair, pair_counts, pair_where = _sums(pair_keys, [ints(r[4]) for r in paired])
        out: list[tuple] = []
        if asked or paired:
            known, known_pair = counts > 0, pair_counts > 0
            first = first_probes(int(known.sum()) * n_ranges)
            bits = bits_for(counts[known], pair_counts[known_pair], first)
            most = int(levels_of(np.array([counts.max(initial=0), pair_counts.max(initial=0)])).max())
            own = Filter(fill(words[known], counts[known], pair[known_pair], pair_counts[known_pair], bits, first), bits, most, first)
            levels, pair_levels = own.levels(words), own.levels(pair)
            bucket = rows[0][0]
            out.append((bucket, -1, SUMS, None, save(n=counts.sum(), v=known.sum(), words=sums_of(levels[known], counts[known]), pairs=sums_of(pair_levels[known_pair], pair_counts[known_pair])), None))
            levels, pair_levels = levels.astype(np.uint8), pair_levels.astype(np.uint8)
            # for each chunk the levels of its words and of its pairs, and the exact counts of its words
            told = {r[1]: [b"", b"", b""] for r in [*asked, *paired]}
            at = 0
            for r, k in zip(asked, keys, strict=True):
                mine = where[at : at + len(k)]
                told[r[1]][0], told[r[1]][2] = levels[mine].tobytes(), small_ints(counts[mine])
                at += len(k)
            at = 0
            for r, k in zip(paired, pair_keys, strict=True):
                told[r[1]][1] = pair_levels[pair_where[at : at + len(k)]].tobytes()
                at += len(k)
            out += [(bucket, chunk, X.ANSWER, a + b, c or small_ints(counts[:0]), None) for chunk, (a, b, c) in told.items()]
        answers = pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "kind", "h", "r", "t"])
        kept = table.filter(pa.array([r[2] == X.SKELETON for r in rows], pa.bool_()))
        return pa.concat_tables([kept.cast(answers.schema), answers])

    return one


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(n: int, v: int, word_mean: np.ndarray, pair_mean: np.ndarray, mu: float):
    """Both scores of a chunk's documents; n tokens and v words were counted, and levels stand for these counts."""

    def build(skeleton: bytes, rows: list) -> pa.Table:
        s = load(skeleton)
        rows = sorted(rows)
        by_word = [ints(r) for _, _, r in rows]
        word_levels = [np.frombuffer(h, np.uint8)[: len(c)] for (_, h, _), c in zip(rows, by_word, strict=True)]
        pair_levels = np.concatenate([np.frombuffer(h, np.uint8)[len(c) :] for (_, h, _), c in zip(rows, by_word, strict=True)])
        words, first = s["words"], np.concatenate(([0], np.cumsum(s["n"])))
        counts, c_words = np.empty(len(words), np.int64), np.empty(len(words))
        order = np.argsort(words)
        counts[order], c_words[order] = np.concatenate(by_word), word_mean[np.concatenate(word_levels)]
        number = np.frombuffer(zlib.decompress(s["numbers"].tobytes()), "<u2").astype(np.int64)
        number[number == 65535] = s["wide"]
        n_docs = len(s["ids"])
        doc = np.repeat(np.arange(n_docs), s["n"])
        p, before = pairs(words[number], first)
        pair, at, where = np.unique(p, return_index=True, return_inverse=True)
        c_before = np.where(before[at] == END, counts[number[first[1] - 1]], counts[number[at - 1]]).astype(np.float64)
        p_word = (c_words[number[at]] + 1) / (n + v + 1)
        p_pair = np.log10((np.minimum(pair_mean[pair_levels], c_before) + mu * p_word) / (c_before + mu))
        base = np.log10((counts + 1.0) / (n + v + 1.0))[number]
        return pa.table([
            pa.array(s["ids"], pa.int64(), mask=s["null"]), pa.array(s["held"], pa.bool_()), pa.array(s["n"], pa.int64()), pa.array(np.bincount(doc, counts[number] > 0, n_docs).astype(np.int64), pa.int64()),
            pa.array(np.full(n_docs, n), pa.int64()), pa.array(np.bincount(doc, base, n_docs), pa.float64()), pa.array(np.bincount(doc, p_pair[where], n_docs), pa.float64()),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return build


def score(docs: DataFrame, *, mu: float = MU) -> DataFrame:
    """Tokens and scores of every row of docs (doc_id, text, held_out) by the counts of the rows that are not held_out."""
    keys = X.bucket_keys(docs.sparkSession)
    asked = docs.select("doc_id", "text", "held_out").mapInArrow(lean(_ask(keys)), SCHEMA)
    answered = materialise(asked.groupBy("bucket").applyInArrow(lean(_count(len(keys))), SCHEMA))
    sums = [load(bytes(r[0])) for r in answered.where(F.col("kind") == SUMS).select("r").toLocalIterator()]
    n, v = (sum(int(x[c]) for x in sums) for c in ("n", "v"))
    word_mean, pair_mean = (means_of(sum((x[c] for x in sums), np.zeros((2, 256), np.int64))) for c in ("words", "pairs"))
    return X.assemble(answered.where(F.col("kind").isin(X.SKELETON, X.ANSWER)), _scored(n, v, word_mean, pair_mean, mu), SCORES)


def op6_log_frequency_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs.select("doc_id", "text", F.coalesce(fold("doc_id", 7) == 2, F.lit(False)).alias("held_out")))


QUERIES = {"op6_log_frequency_bloom": op6_log_frequency_bloom}
