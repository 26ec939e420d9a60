"""Transfers as a stream: each micro-batch extends the ledger, scores the accounts it can have changed, and extends the audit chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriledger.operators import audit_chain
from veriledger.operators.signals import MAX_HOPS
from veriledger.operators.verdicts import Thresholds, verdicts
from veriledger.plans.dossier import METRICS
from veriledger.sources.ledger import Ledger, last_write_wins
from veriledger.storage import materialise


def touched(transfers: DataFrame, new: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(account_id) within so many transfers of a new one, in either direction: all whose signals can change."""
    near = new.select(F.explode(F.array("src", "dst")).alias("account_id")).distinct()
    edges = transfers.select("src", "dst").union(transfers.select("dst", "src")).toDF("a", "b").distinct()
    for _ in range(hops):
        near = near.union(edges.join(near, F.col("a") == F.col("account_id")).select(F.col("b").alias("account_id"))).distinct()
    return near


def windowed_volume(stream: DataFrame, *, window: str = "2 hours", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Transfers and amounts by account and window of event time; rows later than the watermark are left out."""
    span = F.window("executed_at", window, slide) if slide else F.window("executed_at", window)
    return stream.withWatermark("executed_at", late).groupBy(span, F.col("src").alias("account_id")).agg(F.count("*").alias("n_transfers"), F.sum("amount").alias("amount"))


def score_stream(stream: DataFrame, accounts: DataFrame, ledger_path: str, log_path: str, *, thresholds: Thresholds | None = None, checkpoint: str, trigger: dict | None = None):
    """Starts the query. stream: rows as in TRANSFERS; ledger_path: where transfers are kept; log_path: the audit log.

    Each batch writes to its own folder, so a batch that runs again replaces its rows, and the log skips batches that it has.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{ledger_path}/batch={number}")
        known = spark.read.parquet(ledger_path)
        transfers = last_write_wins(known.select("src", "dst", "amount", "executed_at", "channel", "batch"), "batch").drop("batch")
        ledger = Ledger(accounts, transfers)
        changed = materialise(touched(transfers, known.where(F.col("batch") == number)))
        decided = verdicts(ledger, thresholds, texts=True, only=changed)
        none = F.lit(None)
        recorded = decided.select(
            "account_id", "verdict", "triggered_reasons", F.struct(*[F.col(m) for m in METRICS]).alias("metrics"), none.cast("array<string>").alias("regulatory_provisions"),
            none.cast("boolean").alias("corpus_is_verified_real_text"), none.cast("string").alias(audit_chain.WARNING_KEY),
        )
        stamp = f"batch-{number}"
        if audit_chain.has_run(spark, log_path, stamp):
            return
        audit_chain.append(audit_chain.with_parts(recorded), log_path, order=["account_id"], created_at=stamp)

    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

