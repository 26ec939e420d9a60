"""Removal of word passages that occur more than once, found through difference-cover anchors.

For a difference cover D modulo v, any two positions i, j have a shift s < v with both i + s and j + s in D
(modulo v). So if a window of ``width`` words occurs at i and at j, then the ``width - v + 1`` words from i + s are hashed
at both places although only |D| of every v positions are. Anchors that occur once are dropped; around the
others, whole windows are hashed and compared over the corpus, and words covered by repeated windows are removed.

Defined results: null text has no words and gives an empty kept text; texts shorter than a window keep all words;
a repeated row counts as another occurrence; equal rows get equal results; an empty table gives none.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledger.llm import exchange as X
from veriledger.llm import kernels as K
from veriledger.llm.storage import materialise, small_batches
from veriledger.llm.workers import lean

WIDTH = 35
#: Difference covers of about the square root of their period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def cover_for(width: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of at least two fifths of a window."""
    v = max(v for v in COVERS if v == 1 or width - v + 1 >= 0.4 * width)
    return v, COVERS[v]


def save(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


#: What tells rows apart: rows with an equal key have equal texts.
KEY = ["did", "rk"]
PLACES = "did long, rk long, places binary"


def _places(skeleton: bytes, rows: list) -> pa.Table:
    """Places (inside their document) that are repeated, for each document that has some."""
    s = load(skeleton)
    refs = np.unique(np.concatenate([s["local"], *[np.frombuffer(r, "<u4") for _, _, r in rows]]).astype(np.int64))
    cuts = np.searchsorted(refs, s["firsts"])
    some = np.flatnonzero(cuts[1:] > cuts[:-1])
    return pa.table([pa.array(s["did"][some], pa.int64()), pa.array(s["rk"][some], pa.int64()), pa.array([(refs[cuts[d] : cuts[d + 1]] - s["firsts"][d]).astype("<u4").tobytes() for d in some], pa.binary())], names=[*KEY, "places"])


def ask_places(chunks: X.Chunks, keys: np.ndarray, width: int, hashes: np.ndarray, places: np.ndarray, firsts: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
    """One chunk's question which of its places (positions over the chunk) have hashes that occur elsewhere."""
    order = np.argsort(hashes, kind="stable")
    hashes, places = hashes[order], places[order]
    batch, same = X.asks(chunks.new(), hashes, places, keys, width, "<u4", b"")
    skeleton = save(local=places[same].astype("<u4"), firsts=firsts, **row_keys(part))
    columns = batch.columns
    columns[5] = pa.array([*[None] * (batch.num_rows - 1), skeleton], pa.binary())
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def repeated_places(asked: DataFrame, width: int) -> DataFrame:
    """(did, rk, places): one row for each key; rows with an equal key have equal texts and so equal places."""
    found = X.assemble(X.answer(asked, width=width, ref="<u4"), _places, PLACES)
    return found.groupBy(*KEY).agg(F.max("places").alias("places"))


def with_row_key(docs: DataFrame) -> DataFrame:
    """doc_id, text, and as a key doc_id without nulls (did) and a digest of the text (rk): results depend on the text alone, so rows with an equal key share theirs."""
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("rk"))


def row_keys(part: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in KEY}


def windows_repeated(docs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """(did, rk, places): starts of the windows of width words that occur more than once; docs from with_row_key()."""
    period, cover = cover_for(width)
    anchor = width - period + 1
    at_cover = np.zeros(period, bool)
    at_cover[list(cover)] = True
    keys = X.bucket_keys(docs.sparkSession)

    def anchors(batches):
        chunks = X.Chunks()
        for batch in batches:
            for part, data, offsets in K.steps(batch, limit=X.CHUNK_BYTES):
                starts, ends, firsts = K.words(data, offsets)
                hashes = K.word_hashes(data, starts, ends)
                firsts_long = np.where(np.diff(firsts) >= width, firsts[1:], firsts[:-1])  # no window fits in a shorter text
                low, high = firsts[:-1], np.maximum(firsts_long - anchor + 1, firsts[:-1])
                at = K.ranges(low, high)
                inside = at - np.repeat(low, np.maximum(high - low, 0))
                at = at[at_cover[inside % period]]
                found = K.window_hashes(hashes, anchor)
                yield ask_places(chunks, keys, 5, found[at] if len(at) else np.zeros(0, K.U64), at, firsts, part)

    marked = repeated_places(docs.select("text", *KEY).mapInArrow(lean(anchors), X.SCHEMA), 5)

    def windows(batches):
        chunks = X.Chunks()
        for batch in batches:
            for part, data, offsets in K.steps(batch, limit=X.CHUNK_BYTES):
                starts, ends, firsts = K.words(data, offsets)
                near = np.zeros(len(starts) + 1, bool)
                for d, blob in enumerate(part.column(3).to_pylist()):
                    if blob:
                        p = np.frombuffer(blob, "<u4").astype(np.int64) + firsts[d]
                        near[firsts[d] : firsts[d + 1]] = K.covered(np.maximum(p - firsts[d] - period + 1, 0), np.minimum(period, p - firsts[d] + 1), int(firsts[d + 1] - firsts[d]))
                at = K.window_starts(firsts, width)
                at = at[near[at]]
                found = K.window_hashes(K.word_hashes(data, starts, ends), width)
                yield ask_places(chunks, keys, 8, found[at] if len(at) else np.zeros(0, K.U64), at, firsts, part)

    # merged, so that rows come in the order of their key and a task that runs again numbers its chunks as before
    candidates = docs.join(marked.hint("merge"), KEY).select("text", *KEY, "places")
    return repeated_places(candidates.mapInArrow(lean(windows), X.SCHEMA), 8)


def remove_repeats(docs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, removed (maximal runs of removed words as begin, end), kept_text (kept words, joined by a space)."""
    small_batches(docs.sparkSession)
    keyed = with_row_key(docs)
    places = materialise(windows_repeated(keyed, width=width))
    schema = "doc_id long, n_words long, removed array<struct<begin:long,end:long>>, kept_text string"
    runs = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def keep(batches):
        for batch in batches:
            for part, data, offsets in K.steps(batch):
                starts, ends, firsts = K.words(data, offsets)
                gone = np.zeros(len(starts), bool)
                removed: list[list] = []
                for d, blob in enumerate(part.column(2).to_pylist()):
                    own: list = []
                    if blob:
                        a, b = int(firsts[d]), int(firsts[d + 1])
                        gone[a:b] = K.covered(np.frombuffer(blob, "<u4").astype(np.int64), width, b - a)
                        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone[a:b], [False])).astype(np.int8)))
                        own = [{"begin": x, "end": y} for x, y in edges.reshape(-1, 2).tolist()]
                    removed.append(own)
                yield pa.RecordBatch.from_arrays(
                    [K.long_of(part.column(0)), pa.array(np.diff(firsts), pa.int64()), pa.array(removed, runs), joined(data, starts, ends, firsts, ~gone)],
                    ["doc_id", "n_words", "removed", "kept_text"],
                )

    return keyed.join(places.hint("shuffle_hash"), KEY, "left").select("doc_id", "text", "places").mapInArrow(lean(keep), schema)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Each document's kept words, joined by one space."""
    kept = np.flatnonzero(keep)
    cuts = np.searchsorted(kept, firsts)
    space = np.ones(len(kept), np.int64)
    last = cuts[1:][cuts[1:] > cuts[:-1]] - 1
    space[last] = 0
    a, b = starts[kept], ends[kept] + space
    padded = np.append(data, np.uint8(32))
    out = padded[K.ranges(a, b)]
    ends_out = np.cumsum(b - a)
    out[(ends_out - 1)[space == 1]] = 32
    offsets = np.concatenate(([0], ends_out))[cuts].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(firsts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def op7_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return kept.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


QUERIES = {"op7_difference_cover_dedup": op7_difference_cover_dedup}
SQL = {
    "op7_difference_cover_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT k, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS i) WHERE len(w) >= 35),
t AS (SELECT k, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
r AS (SELECT DISTINCT k, unnest(range(i, i + 35)) AS p FROM t),
a AS (SELECT k, list(p) AS gone, count(*) AS n FROM r GROUP BY k),
x AS (SELECT d.k, p, d.w[p] AS word FROM d JOIN a USING (k), LATERAL (SELECT unnest(range(1, len(d.w) + 1)) AS p)),
y AS (SELECT x.k, string_agg(word, ' ' ORDER BY x.p) AS s FROM x ANTI JOIN r ON x.k = r.k AND x.p = r.p GROUP BY x.k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(a.n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN a.k IS NULL THEN array_to_string(d.w, ' ') ELSE coalesce(y.s, '') END) AS kept_sha256
FROM d LEFT JOIN a USING (k) LEFT JOIN y USING (k)"""
}
