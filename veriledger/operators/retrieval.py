"""Nearest provisions by cosine, and the grounding of flagged accounts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledger.errors import IndexError_, RetrievalError
from veriledger.operators import cells
from veriledger.operators.cells import unit
from veriledger.sources.corpus import Corpus, embedding_text
from veriledger.storage import materialise

TOP_K = 3
DIMENSIONS = 256
#: Rows (or queries) that one comparison holds, and numbers of a side that is broadcast whole: a rule corpus of a few thousand provisions.
BLOCK, MOST_SENT = 1024, 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashing_embedder(dimensions: int = DIMENSIONS) -> Callable[[Column], Column]:
    """Hashed word counts at unit length: an embedder that needs no model. A model's goes in its place as another function of text.

    A word's place and sign come from its MD5. Words: digits, letters A-Z in lower case, and all beyond ASCII.
    """

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        import hashlib
        import re

        fold, word = str.maketrans(_UPPER, _LOWER), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

        def one(text):
            v = np.zeros(dimensions)
            for w in word.findall((text or "").translate(fold)):
                h = hashlib.md5(w.encode()).hexdigest()
                v[int(h[:8], 16) % dimensions] += 1 if h[8] < "8" else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return texts.map(one)

    return embed


def index(corpus: Corpus, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """The provisions with their vectors, written once."""
    embed = embed or hashing_embedder()
    return materialise(corpus.provisions.withColumn("vector", embed(embedding_text(F.col("title"), F.col("text"), F.col("keywords")))))


def _best(q: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best of rows for each of q, best first, ties to the smaller id. A block of both at once."""
    all_s, all_i = [], []
    for a in range(0, len(q), BLOCK):
        own = q[a : a + BLOCK]
        kept_s, kept_i = np.zeros((len(own), 0)), np.zeros((len(own), 0), np.int64)
        for b in range(0, len(ids), BLOCK):
            s = own @ rows[b : b + BLOCK].T
            s = np.round(s, digits) + 0.0 if digits is not None else s
            s = np.concatenate([kept_s, s], 1)
            i = np.concatenate([kept_i, np.broadcast_to(ids[b : b + BLOCK], (len(own), len(ids[b : b + BLOCK])))], 1)
            order = np.lexsort((i, -s), axis=1)[:, :k]
            kept_s, kept_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        all_s.append(kept_s)
        all_i.append(kept_i)
    return np.concatenate(all_s), np.concatenate(all_i)


def _rows_of(query_ids, scores: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    n = scores.shape[1]
    return pd.DataFrame({"query_id": np.repeat(np.asarray(query_ids), n), "row_id": ids.ravel(), "score": scores.ravel()})


def nearest(queries: DataFrame, rows: DataFrame, k: int = TOP_K, *, digits: int | None = None, most_sent: int = MOST_SENT, large_block: int = cells.LARGE_BLOCK) -> DataFrame:
    """(query_id, row_id, score, rank): for each query the k rows with the highest cosine, ties to the smaller row_id.

    queries: query_id (of any type), vector; rows: row_id (long), vector. Rows of up to most_sent numbers (a rule corpus) are counted, then sent to all tasks, and
    queries stay where they are. Otherwise rows are put into cells, and only cells that can hold one of the k are scored. digits: scores are rounded before they are ranked.
    Null vectors are left out on both sides.
    """
    if k <= 0:
        raise IndexError_("top_k must be positive")
    spark = rows.sparkSession
    queries, rows = queries.where("vector IS NOT NULL").select("query_id", "vector"), rows.where("vector IS NOT NULL").select(F.col("row_id").cast("long").alias("row_id"), "vector")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, row_id long, score double"
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("numbers")).collect()[0]
    if not size["n"]:
        return spark.createDataFrame([], schema + ", rank int")
    if size["numbers"] <= most_sent:
        held = rows.orderBy("row_id").collect()
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in held], np.int64), unit([r[1] for r in held])))

        def against(batches):
            ids, matrix = sent.value
            for pdf in batches:
                for a in range(0, len(pdf), BLOCK):
                    part = pdf.iloc[a : a + BLOCK]
                    scores, found = _best(unit(part["vector"]), ids, matrix, k, digits)
                    yield _rows_of(part["query_id"], scores, found).assign(rank=np.tile(np.arange(1, scores.shape[1] + 1, dtype=np.int32), len(part)))

        return queries.mapInPandas(against, schema + ", rank int")
    return cells.search(queries, cells.build(rows), k, digits=digits, large_block=large_block)


def search(indexed: DataFrame, text: str, *, top_k: int = TOP_K, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """The provisions nearest to one text, with score and rank."""
    if not text or not text.strip():
        raise IndexError_("the query is blank")
    spark = indexed.sparkSession
    query = spark.createDataFrame([(0, text)], "query_id long, text string").select("query_id", (embed or hashing_embedder())(F.col("text")).alias("vector"))
    found = nearest(query, indexed.select(F.col("ordinal").alias("row_id"), "vector"), top_k)
    return found.join(indexed, F.col("row_id") == F.col("ordinal")).select("citation_id", "title", "text", "keywords", "source_file", "score", "rank").orderBy("rank")


def query_text(account: Column, reasons: Column) -> Column:
    return F.concat(F.lit("Account "), account.cast("string"), F.lit(" flagged for suspicious money laundering typology. Structural signals observed: "), F.concat_ws("; ", reasons), F.lit("."))


def ground(decided: DataFrame, corpus: Corpus, indexed: DataFrame, *, top_k: int = TOP_K, embed: Callable[[Column], Column] | None = None, strict: bool = False, digits: int | None = None) -> DataFrame:
    """(account_id, query_text, provisions by rank, corpus_is_verified_real_text) for FLAGGED accounts only.

    decided: account_id, verdict, triggered_reasons. strict: a SAFE account is an error, raised before the index is used.
    """
    if strict and not decided.where("verdict <> 'FLAGGED'").isEmpty():
        raise RetrievalError("grounding is for flagged accounts only")
    text = query_text(F.col("account_id"), F.col("triggered_reasons"))
    asked = decided.where("verdict = 'FLAGGED'").select("account_id", text.alias("query_text"))
    asked = materialise(asked.withColumn("query_id", F.col("account_id")).withColumn("vector", (embed or hashing_embedder())(F.col("query_text"))))
    found = nearest(asked, indexed.select(F.col("ordinal").alias("row_id"), "vector"), top_k, digits=digits)
    named = found.join(indexed.drop("vector"), F.col("row_id") == F.col("ordinal"))
    item = F.struct("rank", "citation_id", "title", "text", F.col("score").alias("similarity_score"), "source_file")
    lists = named.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("provisions"))
    return asked.select("account_id", "query_text", "query_id").join(lists, "query_id").select("account_id", "query_text", "provisions", F.lit(corpus.verified).alias("corpus_is_verified_real_text"))
