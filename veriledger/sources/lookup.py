"""A ledger laid out for questions about one account: each table in buckets by the column that such questions come with.

Transfers lie twice, by sender and by receiver, devices twice, by account and by device. A question about a few accounts reads the buckets of those accounts, and each hop
reads those of the accounts that it has reached; nothing is shuffled or written that grows with the ledger. The layout is written once and serves any number of questions.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriledger.errors import SignalError
from veriledger.functions.scalars import micros
from veriledger.operators import chains
from veriledger.operators import verdicts as V
from veriledger.operators.signals import pivot_dwell
from veriledger.storage import materialise, materialise_bucketed

BUCKETS = 64
#: Keys up to which a step names them in a filter, so that Spark skips buckets; beyond it they are joined.
MOST_KEYS = 2000


@dataclasses.dataclass(frozen=True)
class Lookup:
    """accounts and devices (account_id, device_id) by account, holders (the same) by device, sent by src, received by dst (both src, dst, us)."""

    accounts: DataFrame
    devices: DataFrame
    holders: DataFrame
    sent: DataFrame
    received: DataFrame


def lookup(ledger, *, buckets: int = BUCKETS) -> Lookup:
    """The layout of a ledger. One file a bucket."""
    by = lambda df, key: materialise_bucketed(df.repartition(buckets, key), buckets, key)
    moves = ledger.transfers.where("src <> dst AND executed_at IS NOT NULL").select("src", "dst", micros(F.col("executed_at")).alias("us"))
    pairs = ledger.account_devices.select("account_id", "device_id").distinct()
    return Lookup(by(ledger.accounts.select("account_id").distinct(), "account_id"), by(pairs, "account_id"), by(pairs, "device_id"), by(moves, "src"), by(moves, "dst"))


def rows_of(table: DataFrame, column: str, keys: DataFrame, *, most_keys: int = MOST_KEYS) -> DataFrame:
    """The rows of table whose column is among keys (one column), from their buckets alone if the keys are few."""
    keys = keys.toDF(column).distinct()
    few = [r[0] for r in keys.limit(most_keys + 1).collect()]
    return table.where(F.col(column).isin(few)) if len(few) <= most_keys else table.join(keys, column, "left_semi")


def _longest_from(table: DataFrame, start, *, backward: bool, window: int, max_hops: int, **options) -> tuple[int, int | None]:
    """(length, smallest wait in microseconds or None) of the longest chains that leave start (backward: that lead to it), followed hop by hop."""
    here, there, sign = ("dst", "src", -1) if backward else ("src", "dst", 1)
    level = table.where(F.col(here) == F.lit(start)).select(F.col(there).alias("end"), (sign * F.col("us")).alias("at"), F.lit(None).cast("long").alias("gap"), F.array(here, there).alias("visited"))
    best = (0, None)
    for k in range(1, max_hops + 1):
        level = materialise(level)
        found = level.agg(F.count("*").alias("n"), F.min("gap").alias("gap")).collect()[0]
        if not found["n"]:
            break
        best = (k, found["gap"])
        near = rows_of(table, here, level.select("end"), **options).select(F.col(here).alias("end"), F.col(there).alias("then"), (sign * F.col("us")).alias("then_at"))
        met = level.join(near, "end").where(F.col("then_at") - F.col("at") >= 0).where(F.col("then_at") - F.col("at") <= window).where(~F.array_contains("visited", F.col("then")))
        level = met.select(F.col("then").alias("end"), F.col("then_at").alias("at"), F.least("gap", F.col("then_at") - F.col("at")).alias("gap"), F.array_append("visited", F.col("then")).alias("visited"))
    return best


def signals_of(laid: Lookup, account_id, *, window_minutes: int = chains.WINDOW_MINUTES, max_hops: int = chains.MAX_HOPS, **options) -> DataFrame:
    """One row: the account's four signals, the same as signals() gives."""
    chains.check_bounds(window_minutes, max_hops)
    spark, own = laid.accounts.sparkSession, F.lit(account_id)
    if laid.accounts.where(F.col("account_id") == own).isEmpty():
        raise SignalError(f"no account {account_id}")
    window = window_minutes * 60 * 1_000_000
    out, into = laid.sent.where(F.col("src") == own), laid.received.where(F.col("dst") == own)
    # devices: other known accounts that hold one of the account's
    held = rows_of(laid.holders, "device_id", laid.devices.where(F.col("account_id") == own).select("device_id"), **options).where(F.col("account_id") != own).select("account_id").distinct()
    shared = held.join(rows_of(laid.accounts, "account_id", held, **options), "account_id", "left_semi").count()
    # clustering: transfers between neighbours, read from the neighbours' buckets
    near = out.select(F.col("dst").alias("v")).union(into.select(F.col("src").alias("v"))).where("v IS NOT NULL").distinct()
    degree = near.count()
    inner = rows_of(laid.sent, "src", near, **options).join(near.toDF("dst"), "dst", "left_semi").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    rate = 2.0 * inner.distinct().count() / (degree * (degree - 1)) if degree > 1 else 0.0
    # chains both ways, and the shortest wait between a transfer in and the next one out
    bounds = {"window": window, "max_hops": max_hops, **options}
    forward, backward = _longest_from(laid.sent, account_id, backward=False, **bounds), _longest_from(laid.received, account_id, backward=True, **bounds)
    own_moves = into.union(out).distinct().select("src", "dst", F.timestamp_micros("us").alias("executed_at"))
    waited = pivot_dwell(own_moves).where(F.col("account_id") == own).collect()
    dwell = round(waited[0]["dwell_seconds"] * 1e6) if waited else None
    seconds = [g / 1e6 for g in (forward[1], backward[1], dwell if dwell is not None and dwell <= window else None) if g is not None]
    schema = f"account_id {laid.accounts.schema['account_id'].dataType.simpleString()}, local_clustering_coefficient double, shared_device_account_count long, max_multi_hop_velocity_hops int, min_hop_interval_seconds double"
    return spark.createDataFrame([(account_id, rate, shared, forward[0] + backward[0], min(seconds, default=None))], schema)


def verdict_at(laid: Lookup, account_id, thresholds: V.Thresholds | None = None, *, rule=V.device_gate, texts: bool = False, **options) -> DataFrame:
    """The verdict of one account, the same row as in verdicts()."""
    return V.decide(signals_of(laid, account_id, **options), thresholds, rule=rule, texts=texts)
