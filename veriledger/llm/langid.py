"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (1 to 3 letters, words padded with a space), most frequent
first. A document's own profile is compared with each by the out-of-place distance: the sum over its n-grams of how far each
stands from its rank in the language's profile, or the profile's length where it is not in there.

Profiles are counted over all labelled training documents, whole texts, in one additive aggregation; only the top of each
language comes to the driver, so what is broadcast is bounded by ``profile_size`` entries a language.

Defined results: null text, or text without any letter, is ``und`` with score 0. Ties between languages go to the first by name,
ties between n-grams to the smaller code. Rows with null lang teach nothing. With no training rows every text is ``und``.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriledger.llm import kernels as K
from veriledger.llm.storage import small_batches
from veriledger.llm.workers import lean

PROFILE_SIZE = 400
#: Letters up to which n-grams are counted in tables, and characters that are counted at once.
MOST_LETTERS, STEP = 160, 1 << 19
_LETTER: np.ndarray | None = None
_SHIFT = np.int64(21)


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _LETTER


def codes(text: str) -> np.ndarray:
    """All 1- to 3-grams of the text's words, lower-cased and padded with a space, each packed into 63 bits."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    line = np.full(len(points) + 2, 32, np.int64)
    line[1:-1] = np.where(letter, points, 32)
    keep = np.ones(len(line), bool)
    keep[1:] = (line[1:] != 32) | (line[:-1] != 32)
    line = line[keep]
    word = line != 32
    pairs = (line[:-1] << _SHIFT) | line[1:]
    threes = (pairs[:-1] << _SHIFT) | line[2:]
    return np.concatenate((line[word], pairs, threes[word[1:-1]]))


def ranked(grams: np.ndarray, size: int) -> np.ndarray:
    """The most frequent grams, most frequent first, ties by code."""
    distinct, n = np.unique(grams, return_counts=True)
    return distinct[np.argsort(-n, kind="stable")[:size]]


class Profiles:
    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        """rows: (language, n-gram, rank from 0)"""
        self.size, self.names = size, sorted({r[0] for r in rows})
        known = sorted({r[1] for r in rows})
        self.grams = np.array(known, np.int64)
        self.rank = np.full((len(self.names), len(known) + 1), -1, np.int64)
        place = {g: i for i, g in enumerate(known)}
        for lang, gram, rank in rows:
            self.rank[self.names.index(lang), place[gram]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = codes(text) if text else np.zeros(0, np.int64)
        if not len(grams) or not self.names:
            return "und", 0.0
        own = ranked(grams, self.size)
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        ranks = self.rank[:, at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))))
        total = apart.sum(1)
        best = int(total.argmin())
        return self.names[best], float(1 - total[best] / (self.size * len(own)))


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a text, and how often each is there. The same as of codes(), through tables over the text's own letters where these are few."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    present = np.zeros(int(points.max()) + 1, bool) if len(points) else np.zeros(1, bool)
    present[points[letter]] = True
    alphabet = np.flatnonzero(present)
    k = len(alphabet) + 1
    if k == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if k > MOST_LETTERS:
        return np.unique(codes(text), return_counts=True)
    number = np.zeros(len(present), np.int32)  # 0 is the space between words
    number[alphabet] = np.arange(1, k)
    line = np.zeros(len(points) + 2, np.int32)
    line[1:-1] = np.where(letter, number[points], 0)
    keep = np.ones(len(line), bool)
    keep[1:] = (line[1:] != 0) | (line[:-1] != 0)
    line = line[keep]
    pairs = line[:-1] * np.int32(k) + line[1:]
    threes = (pairs[:-1] * np.int32(k) + line[2:])[line[1:-1] != 0]
    point = np.concatenate(([32], alphabet)).astype(np.int64)
    grams, n = [], []
    for width, found in ((1, line[line != 0]), (2, pairs), (3, threes)):
        count = np.bincount(found, minlength=1)
        there = np.flatnonzero(count)
        code = np.zeros(len(there), np.int64)
        for i in range(width):
            code = code << _SHIFT | point[there // k ** (width - 1 - i) % k]
        grams.append(code)
        n.append(count[there])
    return np.concatenate(grams), np.concatenate(n)


def _count(batches):
    """(lang, n-gram, count) of a partition's rows, flushed when the tables grow large."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush():
        for lang, (keys, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    def add(lang, texts):
        # line feeds are no letters, so no gram goes from one text to the next
        keys, n = counted("\n".join(texts))
        if lang in held:
            keys, where = np.unique(np.concatenate([held[lang][0], keys]), return_inverse=True)
            n = np.bincount(where, np.concatenate([held[lang][1], n]), len(keys)).astype(np.int64)
        held[lang] = keys, n

    for batch in batches:
        waiting: dict[str, list[str]] = {}
        size: dict[str, int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            waiting.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] > STEP:
                add(lang, waiting.pop(lang))
                size[lang] = 0
        for lang, texts in waiting.items():
            add(lang, texts)
        if sum(len(keys) for keys, _ in held.values()) > 500_000:
            yield from flush()
    yield from flush()


def learn(labelled: DataFrame, *, size: int = PROFILE_SIZE) -> Profiles:
    """Profiles from all rows with text and lang."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    counted = rows.mapInArrow(lean(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # ranked in salted parts first, so no task ranks all n-grams of a language
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("n"), "gram")) - 1
    parts = counted.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(64))).withColumn("rank", rank("part")).where(F.col("rank") < size)
    top = parts.withColumn("rank", rank()).where(F.col("rank") < size)
    return Profiles([(r[0], r[1], r[2]) for r in top.select("lang", "gram", "rank").collect()], size)


def identify(docs: DataFrame, profiles: Profiles, *, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns in keep (all by default), lang_pred and score (0 to 1: 1 for a text with the very profile of its language)."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = tuple(c for c in docs.columns if c not in ("lang_pred", "score")) if keep is None else keep
    sent = spark.sparkContext.broadcast(profiles)
    source = docs.select(*keep, F.col("text").alias("_judged"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", lang_pred string, score double"

    def run(batches):
        p = sent.value
        for batch in batches:
            said = [p.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return source.mapInArrow(lean(run), schema)


def fold(column: str, parts: int) -> F.Column:
    """crc32 of the column as text, modulo parts."""
    return F.crc32(F.col(column).cast("string")) % parts


def op5_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    profiles = learn(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op5_rank_order_language": op5_rank_order_language}
