"""A training corpus from the documents table: language, near duplicates, benchmark passages, personal data, sequences.

Each stage gets what the one before kept, written as Parquet and read again; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledger.llm import decontaminate, langid, ngram_join, packing, pseudonyms
from veriledger.llm.storage import discard, materialise, scope

#: A text that is this far from every language's profile is not taken for a text in one of them.
LEAST_LANGUAGE_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts that are near no language; lang becomes the language found.

    Profiles are learnt from the rows with a lang; where there is none, nothing can be judged and all texts with letters stay.
    """
    profiles = langid.learn(docs)
    judged = langid.identify(docs.withColumn("_own", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("text", "_own"), profiles, keep=("_own",))
    if not profiles.names:
        return judged.where(F.col("_own.text").rlike(r"\p{L}")).select("_own.*")
    kept = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(f"_own.`{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest doc_id stays."""
    return ngram_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms for personal data; n_chars follows the text."""
    done = pseudonyms.pseudonymise(docs, key=pseudonyms.session_key(spark)).select(*docs.columns)
    return done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast("long")) if "n_chars" in docs.columns else done


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids and their place in sequences of 2048."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("pii_pseudonyms", personal_data),
    ("best_fit_packing", sequences),
]

#: Profiles, pseudonyms and the packing plan are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with scope(spark) as kept:
            kept.append(materialise(stage(spark, docs, sf_dir)))
        discard(docs)
        docs = kept[0]
    return docs
