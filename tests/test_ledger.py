from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veriledger.errors import LedgerError, RecordError
from veriledger.operators import validation
from veriledger.sources import ledger as L

UTC = dt.timezone.utc


def test_ring_is_the_same_for_a_seed():
    assert L.ring_rows(seed=7) == L.ring_rows(seed=7)
    assert L.ring_rows(seed=7) != L.ring_rows(seed=8)


def test_ring_shape():
    accounts, transfers = L.ring_rows(legitimate=5)
    kinds = [a[1] for a in accounts]
    assert len(accounts) == 14 and [kinds.count(k) for k in L.ACCOUNT_TYPES] == [4, 3, 2, 5]
    assert {tuple(a[3]) for a in accounts if a[1] == "LAYERING"} == {("DEV-MULE-SHARED-0001",)}
    assert all(t[0] != t[1] for t in transfers)
    assert {a[0] for a in accounts} == {e for t in transfers for e in t[:2]}


def test_ring_matches_known_rows():
    accounts, transfers = L.ring_rows()
    assert len(accounts) == 19 and len(transfers) == 28
    first, last = transfers[0], transfers[-1]
    assert first == ("ACC-PLACE-000", "ACC-LAYER-002", 67460.45, dt.datetime(2026, 1, 1, 0, 19, tzinfo=UTC), "IMPS")
    assert last == ("ACC-LEGIT-007", "ACC-LEGIT-006", 9347.61, dt.datetime(2026, 1, 22, 22, 54, tzinfo=UTC), "NEFT")
    assert {a[0]: a[5] for a in accounts}["ACC-LAYER-000"] == 0.626


def test_one_legitimate_account_pays_into_the_ring():
    _, transfers = L.ring_rows(legitimate=1)
    assert transfers[-1][:2] == ("ACC-LEGIT-000", "ACC-INTEG-000")


@pytest.mark.parametrize("bad", [{"placement": 0}, {"layering": 0}, {"integration": 0}, {"legitimate": -1}])
def test_ring_parameters(bad):
    with pytest.raises(LedgerError):
        L.ring_rows(**bad)


def test_invariants(spark):
    ring = L.ring_ledger(spark)
    validation.require_ledger(ring.accounts, ring.transfers)
    lonely = ring.accounts.union(spark.createDataFrame([("X", "LEGITIMATE", "x", ["d"], dt.datetime(2026, 1, 1, tzinfo=UTC), 0.1)], L.ACCOUNTS))
    with pytest.raises(LedgerError, match="isolated_account"):
        validation.require_ledger(lonely, ring.transfers)
    with pytest.raises(LedgerError, match="unknown_account"):
        validation.require_ledger(ring.accounts.where("account_id <> 'ACC-LAYER-000'"), ring.transfers)
    with pytest.raises(LedgerError):
        validation.require_ledger(ring.accounts.limit(0), ring.transfers.limit(0))


def test_last_write_wins(spark):
    t = lambda m: dt.datetime(2026, 1, 1, 0, m, tzinfo=UTC)
    rows = spark.createDataFrame([("a", "b", 1.0, t(1), "x"), ("a", "b", 2.0, t(5), "y"), ("a", "b", 3.0, t(3), "z"), ("b", "a", 4.0, t(0), "w")], L.TRANSFERS)
    assert sorted((r.src, r.dst, r.amount, r.channel) for r in L.last_write_wins(rows).collect()) == [("a", "b", 2.0, "y"), ("b", "a", 4.0, "w")]


def test_consecutive_crosses_days(spark):
    rows = [(i, dt.datetime(2026, 1, 1 + i // 3 * 2, i % 3), i * 10) for i in range(9)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")
    assert sorted((r.event_id, r.next_user) for r in L.consecutive(events).collect()) == [(i, (i + 1) * 10 if i < 8 else None) for i in range(9)]


def test_account_rules(spark):
    ok = ("A", "LEGITIMATE", "h", ["d"], dt.datetime(2026, 1, 1, tzinfo=UTC), 0.5)
    change = lambda **k: tuple(k.get(n, v) for n, v in zip(L.ACCOUNTS.names, ok, strict=True))
    cases = {
        "blank_account_id": change(account_id="  "), "blank_holder_name": change(holder_name=None), "risk_out_of_range": change(kyc_risk_score=float("nan")),
        "no_device": change(device_ids=[]), "blank_device": change(device_ids=["d", ""]), "no_opening_time": change(opened_at=None),
    }
    frame = spark.createDataFrame([ok, *cases.values()], L.ACCOUNTS)
    valid, invalid = validation.split(frame, validation.account_reasons())
    assert valid.count() == 1 and sorted(r for row in invalid.collect() for r in row.reasons) == sorted(cases)
    with pytest.raises(RecordError):
        validation.require_valid(frame, validation.account_reasons(), "account")
    assert validation.require_valid(valid, validation.account_reasons(), "account") is valid


def test_transfer_rules(spark):
    now = dt.datetime(2026, 1, 1, tzinfo=UTC)
    rows = [("a", "b", 1.0, now, "x"), ("a", "a", 1.0, now, "x"), ("a", "b", -5.0, now, "x"), ("a", "b", float("nan"), now, "x"), ("a", "b", 1.0, None, " "), (None, "b", 1.0, now, "x")]
    frame = spark.createDataFrame(rows, L.TRANSFERS).withColumn("r", validation.transfer_reasons())
    assert [r.r for r in frame.collect()] == [[], ["self_transfer"], ["amount_not_positive"], [], ["no_execution_time", "blank_channel"], []]
    with pytest.raises(RecordError, match="time zone"):
        validation.require_valid(frame.withColumn("executed_at", F.col("executed_at").cast("timestamp_ntz")), validation.transfer_reasons(), "transfer")


def test_large_ledger(spark):
    big = L.large_ledger(spark, 200, 3)
    again = L.large_ledger(spark, 200, 3)
    assert big.accounts.count() == 200 and big.transfers.exceptAll(again.transfers).isEmpty() and big.transfers.where("src = dst").isEmpty()
    assert validation.split(big.accounts, validation.account_reasons())[1].isEmpty()
