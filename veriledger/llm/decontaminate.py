"""Benchmark decontamination by winnowing.

Of every run of ``window`` consecutive k-gram hashes the smallest is kept as a fingerprint, so any shared
span of ``window + k - 1`` words (here ``span``) has a fingerprint at the same place on both sides. Fingerprints
of documents are joined with those of the benchmark, and hits extended to whole shared spans.

The benchmark is taken in blocks of at most ``block_bytes`` of text; the index of one block is broadcast, which bounds
what is sent however large the benchmark is. Spans found against each block are merged by document.

Defined results: null or wordless text has no words and no hits; null benchmark texts match nothing; equal
rows get equal results; an empty table on either side gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledger.llm import kernels as K
from veriledger.llm.workers import lean

SPAN, KGRAM = 10, 5
BLOCK_BYTES = 16 << 20


def winnow(grams: np.ndarray, firsts: np.ndarray, window: int) -> np.ndarray:
    """Indices of the grams that are the (rightmost) smallest of some run of window grams of one document.

    firsts: each document's first gram. A document with fewer grams than window keeps its smallest.
    """
    if not len(grams):
        return np.zeros(0, np.int64)
    starts = K.ranges(firsts[:-1], np.maximum(firsts[1:] - window + 1, np.minimum(firsts[:-1] + 1, firsts[1:])))
    ends = np.minimum(starts + window, np.repeat(firsts[1:], np.maximum(firsts[1:] - window + 1, np.minimum(firsts[:-1] + 1, firsts[1:])) - firsts[:-1]))
    best = starts.copy()
    for step in range(1, window):
        at = np.minimum(starts + step, ends - 1)
        best = np.where(grams[at] <= grams[best], at, best)
    return np.unique(best)


def _words(data, offsets):
    data = K.lower(data)
    starts, ends, firsts = K.words(data, offsets, K.ALNUM)
    return K.word_hashes(data, starts, ends), firsts


def _grams(hashes, firsts, width):
    """Hashes of all windows of width words in one document, their first words, and each document's first of them."""
    at = K.window_starts(firsts, width)
    all_ = K.window_hashes(hashes, width)
    n = np.maximum(firsts[1:] - firsts[:-1] - width + 1, 0)
    return all_[at] if len(at) else np.zeros(0, K.U64), at, np.concatenate(([0], np.cumsum(n)))


class Index:
    """Fingerprints, whole windows and short items of one block of the benchmark."""

    def __init__(self, rows: list[tuple], span: int = SPAN, k: int = KGRAM):
        self.span, self.k = span, k
        rows = [(i, t) for i, t in rows if t is not None]
        hashes, firsts = _words(*K.strings(pa.array([t for _, t in rows], pa.string())))
        self.items = [str(i) for i, _ in rows]
        sizes = firsts[1:] - firsts[:-1]
        grams, _, at = _grams(hashes, firsts, k)
        self.prints = np.unique(grams[winnow(grams, at, span - k + 1)])
        table: dict[int, list] = {}
        for width in sorted({min(int(s), span) for s in sizes if s}):
            of = np.flatnonzero((sizes == width) if width < span else (sizes >= span))
            w = K.window_hashes(hashes, width)
            owners = np.repeat(of, sizes[of] - width + 1)
            found = w[K.ranges(firsts[of], firsts[of] + sizes[of] - width + 1)]
            order = np.argsort(found, kind="stable")
            table[width] = [found[order], owners[order]]
        self.windows = table


def _lookup(table, hashes):
    known = table[0]
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    return known[at] == hashes


def hits(index: Index, data: np.ndarray, offsets: np.ndarray):
    """Words by document, spans as (document, first word, end word), and (document, item) pairs."""
    hashes, firsts = _words(data, offsets)
    spans, pairs = [], []
    span, k = index.span, index.k
    for width, table in index.windows.items():
        at = K.window_starts(firsts, width)
        if not len(at):
            continue
        if width == span:
            grams, starts, of = _grams(hashes, firsts, k)
            chosen = winnow(grams, of, span - k + 1)
            chosen = chosen[_lookup([index.prints], grams[chosen])] if len(index.prints) else chosen[:0]
            # a window that shares a fingerprint starts at most span - k words before it
            near = np.zeros(len(hashes) + 1, bool)
            for back in range(span - k + 1):
                near[np.maximum(starts[chosen] - back, 0)] = True
            at = at[near[at]]
        found = K.window_hashes(hashes, width)[at]
        hit = _lookup(table, found)
        at, found = at[hit], found[hit]
        doc = np.searchsorted(firsts, at, "right") - 1
        spans.append(np.stack([doc, at, at + width], 1))
        low, high = np.searchsorted(table[0], found), np.searchsorted(table[0], found, "right")
        pairs.append(np.unique(np.stack([np.repeat(doc, high - low), table[1][K.ranges(low, high)]], 1), axis=0))
    none = np.zeros((0, 3), np.int64)
    return firsts, np.concatenate(spans) if spans else none, np.concatenate(pairs) if pairs else none[:, :2]


SPANS = "array<struct<begin:long,end:long>>"


def blocks(spark: SparkSession, benchmark: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """The benchmark's rows, streamed to the driver in blocks of at most limit bytes of text (or one row)."""
    rows, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        n = len(r[1] or "") * 4
        if rows and size + n > limit:
            yield rows
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += n
    yield rows


def find_hits(docs: DataFrame, benchmark: DataFrame, *, span: int = SPAN, k: int = KGRAM, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its columns in keep, doc_id, n_words, hit_spans (maximal runs of hit words), item_ids (as strings, sorted)."""
    spark = docs.sparkSession
    source = docs.select("doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")])
    parts = []
    for block in blocks(spark, benchmark, block_bytes):
        sent = spark.sparkContext.broadcast(Index(block, span, k))
        parts.append(_against(source, sent, keep))
    if len(parts) == 1:
        return parts[0]
    # more blocks: merge what each found by the document's row, told apart by a digest of all that the result depends on
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    key = ["doc_id", "n_words", "_digest", *[c for c in keep if c != "doc_id"]]
    merged = every.groupBy(*key).agg(
        F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        (F.count("*") / len(parts)).cast("int").alias("_copies"),
    )
    merged = merged.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copy", "_copies")
    return _union_spans(merged)


def _union_spans(df: DataFrame) -> DataFrame:
    """Overlapping or touching spans become one."""
    spans = F.array_sort("hit_spans")
    step = F.aggregate(
        spans, F.array().cast(SPANS),
        lambda a, s: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] >= s["begin"]),
                            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["begin"].alias("begin"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(a, F.array(s))),
    )
    return df.withColumn("hit_spans", F.when(F.size("hit_spans") > 0, step).otherwise(F.col("hit_spans")))


def _against(source: DataFrame, sent, keep) -> DataFrame:
    carried = [f for f in source.schema.fields if f.name in keep and f.name != "doc_id"]
    schema = "doc_id long, n_words long, hit_spans " + SPANS + ", item_ids array<string>, _digest long" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in carried)

    def run(batches):
        index = sent.value
        for batch in batches:
            for part, data, offsets in K.steps(batch):
                firsts, spans, pairs = hits(index, data, offsets)
                n = len(offsets) - 1
                found: list[list] = [[] for _ in range(n)]
                if len(spans):
                    order = np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))
                    for d, a, b in spans[order].tolist():
                        a, b, own = a - int(firsts[d]), b - int(firsts[d]), found[d]
                        if own and own[-1]["end"] >= a:
                            own[-1]["end"] = max(own[-1]["end"], b)
                        else:
                            own.append({"begin": a, "end": b})
                items: list[set] = [set() for _ in range(n)]
                for d, i in pairs.tolist():
                    items[d].add(index.items[i])
                prefix = K.prefix_hash(data)
                columns = [
                    K.long_of(part.column(0)), pa.array(firsts[1:] - firsts[:-1], pa.int64()),
                    pa.array(found, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(s) for s in items], pa.list_(pa.string())),
                    pa.array(K.span_hash(prefix, offsets[:-1], offsets[1:]).astype(np.int64)),
                    *[part.column(part.schema.get_field_index(f.name)) for f in carried],
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "hit_spans", "item_ids", "_digest", *[f.name for f in carried]])

    out = source.mapInArrow(lean(run), schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents without any hit, with their columns; null texts have no words and stay."""
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return find_hits(rows, benchmark, keep=("_row",), **options).where(F.size("hit_spans") == 0).select("_row.*")


def op10_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_hits(docs, bench)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


QUERIES = {"op10_winnowing_decontamination": op10_winnowing_decontamination}

_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op10_winnowing_decontamination": rf"""
WITH d AS (SELECT doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_SQL_WORDS}, []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS g
       FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM d, ns, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n),
h AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""
}
