"""The whole run: verdicts, grounding of the flagged, records, and the audit chain."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriledger.operators import audit_chain, retrieval
from veriledger.operators.verdicts import Thresholds, verdict_of, verdicts
from veriledger.sources.corpus import Corpus
from veriledger.storage import materialise

METRICS = ("account_id", "local_clustering_coefficient", "shared_device_account_count", "max_multi_hop_velocity_hops", "min_hop_interval_seconds")


def records(decided: DataFrame, grounded: DataFrame) -> DataFrame:
    """One record for each account; provisions, the verified flag and a warning only where grounding took place."""
    shown = F.transform("provisions", lambda p: F.struct(p["citation_id"].alias("citation_id"), p["title"].alias("title"), p["similarity_score"].alias("similarity_score"), p["source_file"].alias("source_file")))
    joined = decided.join(grounded.drop("query_text"), "account_id", "left")
    return joined.select(
        F.col("account_id").cast("string").alias("account_id"), "verdict", "triggered_reasons", F.struct(*[F.col(m) for m in METRICS]).alias("metrics"),
        shown.alias("regulatory_provisions"), "corpus_is_verified_real_text", audit_chain.warning(F.col("corpus_is_verified_real_text")).alias(audit_chain.WARNING_KEY),
    )


def dossiers(ledger, corpus: Corpus, *, indexed: DataFrame | None = None, thresholds: Thresholds | None = None, top_k: int = retrieval.TOP_K, account_id=None, embed=None, digits: int | None = None) -> DataFrame:
    """Records of all accounts, or of one. Only flagged accounts reach the search."""
    decided = verdicts(ledger, thresholds, texts=True) if account_id is None else verdict_of(ledger, account_id, thresholds, texts=True)
    decided = materialise(decided)
    found = retrieval.ground(decided, corpus, indexed if indexed is not None else retrieval.index(corpus, embed), top_k=top_k, embed=embed, digits=digits)
    return records(decided, found)


def run(ledger, corpus: Corpus, log: str, *, created_at: str | None = None, **options) -> DataFrame:
    """dossiers(), appended to the audit log in the order of account ids; returns the log's new lines."""
    now = created_at or dt.datetime.now(dt.timezone.utc).isoformat()
    return audit_chain.append(audit_chain.with_parts(dossiers(ledger, corpus, **options)), log, order=["account_id"], created_at=now)
