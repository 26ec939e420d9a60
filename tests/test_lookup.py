"""One account's verdict from a ledger laid out by account: the row of verdicts(), from few buckets."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from veriledger.errors import SignalError
from veriledger.operators import verdicts as V
from veriledger.sources import ledger as L
from veriledger.sources import lookup as K


@pytest.fixture(scope="module")
def made(spark):
    ledger = L.large_ledger(spark, 60, 6, devices_each=0.5, partitions=3)
    close = ledger.transfers.withColumn("executed_at", F.timestamp_add("MINUTE", F.pmod(F.xxhash64("src", "dst"), F.lit(600)).cast("int"), F.lit("2026-01-01").cast("timestamp")))
    ledger = L.Ledger(ledger.accounts, close.cache())
    return ledger, K.lookup(ledger, buckets=16)


def plain(row):
    return {k: round(v, 6) if isinstance(v, float) else v for k, v in row.asDict().items()}


def test_rows_equal_the_verdicts_of_all(made):
    ledger, laid = made
    want = {r["account_id"]: plain(r) for r in V.verdicts(ledger, texts=True).collect()}
    assert len({r["max_multi_hop_velocity_hops"] for r in want.values()}) > 2 and len({r["verdict"] for r in want.values()}) == 2
    for account, options in (("ACC-0", {}), ("ACC-7", {}), ("ACC-31", {"most_keys": 1})):
        row = plain(K.verdict_at(laid, account, texts=True, **options).collect()[0])
        assert row == {k: want[account][k] for k in row}, account


def files_read(df):
    """The files that the tasks of a plan without shuffles read."""
    return sorted({re.search(r"_(\d{5})\.", str(f.urlEncodedPath()))[1] for p in df._jdf.queryExecution().toRdd().partitions() for f in p.files()})


def test_only_the_buckets_of_the_accounts_are_read(spark, made):
    _, laid = made
    assert len(files_read(laid.sent)) == 16
    assert len(files_read(laid.sent.where(F.col("src") == "ACC-7"))) == 1
    few = K.rows_of(laid.sent, "src", spark.createDataFrame([("ACC-7",), ("ACC-8",), ("ACC-9",)], "v string"))
    assert 1 <= len(files_read(few)) <= 3


def test_unknown_and_lonely_accounts(spark, made):
    _, laid = made
    with pytest.raises(SignalError):
        K.verdict_at(laid, "nobody")
    lonely = L.Ledger(spark.createDataFrame([("a", ["d"]), ("b", ["e"])], "account_id string, device_ids array<string>"), spark.createDataFrame([], L.TRANSFERS))
    row = K.verdict_at(K.lookup(lonely, buckets=2), "a").collect()[0]
    assert (row["verdict"], row["shared_device_account_count"], row["max_multi_hop_velocity_hops"], row["min_hop_interval_seconds"]) == ("SAFE", 0, 0, None)
