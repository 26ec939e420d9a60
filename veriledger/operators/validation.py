"""Rules for rows and for the ledger as a whole, as predicates that name what is broken."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledger.errors import LedgerError, RecordError
from veriledger.functions.scalars import is_blank

REASONS = "array<string>"


def _reasons(**rules: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items()]))


def account_reasons() -> Column:
    devices = F.col("device_ids")
    return _reasons(
        blank_account_id=is_blank(F.col("account_id")), blank_holder_name=is_blank(F.col("holder_name")), no_opening_time=F.col("opened_at").isNull(),
        risk_out_of_range=~F.col("kyc_risk_score").between(0.0, 1.0), no_device=F.coalesce(F.size(devices), F.lit(0)) < 1,
        blank_device=F.coalesce(F.exists(devices, is_blank), F.lit(False)),
    )


def transfer_reasons() -> Column:
    """An amount of NaN or infinity is not negative and passes, as in the source system."""
    return _reasons(
        self_transfer=F.coalesce(F.col("src") == F.col("dst"), F.lit(False)), amount_not_positive=F.col("amount") <= 0,
        no_execution_time=F.col("executed_at").isNull(), blank_channel=is_blank(F.col("channel")),
    )


def device_reasons() -> Column:
    return _reasons(blank_device_id=is_blank(F.col("device_id")), no_first_seen=F.col("first_seen").isNull())


def split(rows: DataFrame, reasons: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with their reasons)"""
    marked = rows.withColumn("reasons", reasons)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def require_valid(rows: DataFrame, reasons: Column, what: str) -> DataFrame:
    """rows, or a RecordError that shows one that is broken. Zone-less timestamps are broken by their type."""
    naive = [f.name for f in rows.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    if naive:
        raise RecordError(f"{what}: {', '.join(naive)} has no time zone")
    broken = split(rows, reasons)[1].limit(1).collect()
    if broken:
        raise RecordError(f"{what} {broken[0].asDict()}: {', '.join(broken[0]['reasons'])}")
    return rows


def require_accounts(accounts: DataFrame) -> DataFrame:
    """accounts; one that breaks a rule of its own is a LedgerError here, as part of building a ledger. A broken transfer stays a RecordError."""
    try:
        return require_valid(accounts, account_reasons(), "account")
    except RecordError as broken:
        raise LedgerError(str(broken)) from broken


def violations(accounts: DataFrame, transfers: DataFrame) -> DataFrame:
    """(check, subject) for each break of a ledger's structure."""
    ends = transfers.select(F.explode(F.array("src", "dst")).alias("account_id")).distinct()
    own = accounts.select("account_id").distinct()
    text = F.col("account_id").cast("string").alias("subject")
    parts = [
        transfers.where("src = dst").select(F.lit("self_transfer").alias("check"), F.col("src").cast("string").alias("subject")),
        ends.join(own, "account_id", "left_anti").select(F.lit("unknown_account").alias("check"), text),
        own.join(ends, "account_id", "left_anti").select(F.lit("isolated_account").alias("check"), text),
        transfers.where("executed_at IS NULL OR amount IS NULL").select(F.lit("transfer_without_record").alias("check"), F.concat_ws(">", "src", "dst").alias("subject")),
        accounts.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("empty_ledger").alias("check"), F.lit(None).cast("string").alias("subject")),
    ]
    return reduce(DataFrame.unionByName, parts)


def require_ledger(accounts: DataFrame, transfers: DataFrame) -> None:
    found = violations(accounts, transfers).limit(1).collect()
    if found:
        raise LedgerError(f"{found[0]['check']}: {found[0]['subject']}")


def isolated(accounts: DataFrame, account: str, links: DataFrame, end: str) -> DataFrame:
    """Rows of accounts that no row of links names."""
    return accounts.join(links.select(F.col(end).alias(account)), account, "left_anti")
