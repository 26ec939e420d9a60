"""Adversarial findings, their JSON sink, and the scorecard of an evaluation."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledger import errors
from veriledger.operators import evaluation, validation
from veriledger.operators.verdicts import Thresholds, device_or_fast_chain, verdict_of, verdicts
from veriledger.sources import ledger as ledgers

TYPED = tuple(n for n, c in vars(errors).items() if isinstance(c, type) and issubclass(c, errors.VeriledgerError))


def hub_finding(spark: SparkSession, account: str = "ACC-ADV-LAYER-000") -> DataFrame:
    """How the rule does on a layering account that rotates its device behind a hub; the alternative rule beside it."""
    hub = ledgers.hub_ledger(spark)
    both = verdicts(hub).join(verdicts(hub, rule=device_or_fast_chain).select("account_id", F.col("verdict").alias("alternative_verdict")), "account_id")
    missed = F.col("verdict") == "SAFE"
    return both.where(F.col("account_id") == account).select(
        F.col("account_id").alias("target_account_id"), F.col("verdict").alias("firewall_verdict"), "alternative_verdict", "shared_device_account_count", "max_multi_hop_velocity_hops", missed.alias("is_false_negative"),
        F.lit("A laundering chain through a busy hub, with a device that no other account has.").alias("description"),
        F.when(missed, "The device signal is required, and a fresh device keeps it silent however fast the chain is.").alias("root_cause"),
        F.when(missed, "Let long and fast chains count without a shared device.").alias("remediation"),
    )


def fuzz_cases(spark: SparkSession) -> DataFrame:
    """Malformed inputs and what each raised: case_id, exception_type, expected_outcome, exception_message."""
    base = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    account = ("A", "LEGITIMATE", "h", ["d"], base, 0.5)

    def transfer(*row, naive=False):
        frame = spark.createDataFrame([row], ledgers.TRANSFERS)
        frame = frame.withColumn("executed_at", F.col("executed_at").cast("timestamp_ntz")) if naive else frame
        return validation.require_valid(frame, validation.transfer_reasons(), "transfer")

    def person(**changed):
        row = tuple(changed.get(n, v) for n, v in zip(ledgers.ACCOUNTS.names, account, strict=True))
        return validation.require_valid(spark.createDataFrame([row], ledgers.ACCOUNTS), validation.account_reasons(), "account")

    cases = {
        "negative_transaction_amount": lambda: transfer("a", "b", -500.0, base, "IMPS"), "naive_timezone_timestamp": lambda: transfer("a", "b", 1.0, base, "IMPS", naive=True),
        "self_loop_transaction": lambda: transfer("a", "a", 1.0, base, "IMPS"), "nan_kyc_risk_score": lambda: person(kyc_risk_score=float("nan")), "empty_string_device_id": lambda: person(device_ids=[""]),
        "unknown_account": lambda: verdict_of(ledgers.hub_ledger(spark), "nobody", Thresholds()), "threshold_out_of_range": lambda: Thresholds(min_clustering_coefficient=1.5),
        "account_breaks_ledger": lambda: ledgers.checked_ledger(spark, [(*account[:5], 1.5)], []), "transfer_to_unknown_account": lambda: ledgers.checked_ledger(spark, [account], [("A", "nobody", 1.0, base, "IMPS")]),
    }
    rows = []
    for name, attempt in cases.items():
        try:
            attempt()
            rows.append((name, None, "typed_error", None))
        except Exception as raised:  # noqa: BLE001  what kind of error it is, is the result
            rows.append((name, type(raised).__name__, "typed_error", str(raised)[:300]))
    return spark.createDataFrame(rows, "case_id string, exception_type string, expected_outcome string, exception_message string")


def fuzz_summary(cases: DataFrame) -> DataFrame:
    """One row: cases, known gaps and their ids."""
    judged = evaluation.classify_outcomes(cases, TYPED)
    return judged.agg(F.count("*").alias("cases"), F.count_if("is_known_gap").alias("known_gaps"), F.sort_array(F.collect_list(F.when(F.col("is_known_gap"), F.col("case_id")))).alias("gap_ids"))


def write_findings(findings: DataFrame, path: str) -> None:
    findings.coalesce(1).write.mode("overwrite").json(path)


def scorecard(topology: DataFrame, grounding: DataFrame | None = None) -> str:
    """The one-row reports as text."""
    parts = {"topology": topology.first().asDict()} | ({"grounding": grounding.first().asDict()} if grounding is not None else {})
    return "\n".join(f"{name}\n{json.dumps(row, indent=2, default=str)}" for name, row in parts.items())
