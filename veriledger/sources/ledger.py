"""The ledger's tables: accounts and transfers, from files, from event streams, or synthetic."""

from __future__ import annotations

import dataclasses
import datetime as dt
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriledger.errors import LedgerError
from veriledger.operators import validation

ACCOUNT_TYPES = ("PLACEMENT", "LAYERING", "INTEGRATION", "LEGITIMATE")
ACCOUNTS = T.StructType([
    T.StructField("account_id", T.StringType()), T.StructField("account_type", T.StringType()), T.StructField("holder_name", T.StringType()),
    T.StructField("device_ids", T.ArrayType(T.StringType())), T.StructField("opened_at", T.TimestampType()), T.StructField("kyc_risk_score", T.DoubleType()),
])
TRANSFERS = T.StructType([
    T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("amount", T.DoubleType()),
    T.StructField("executed_at", T.TimestampType()), T.StructField("channel", T.StringType()),
])
DEVICES = T.StructType([T.StructField("device_id", T.StringType()), T.StructField("first_seen", T.TimestampType())])
UTC = dt.timezone.utc


@dataclasses.dataclass(frozen=True)
class Ledger:
    """accounts as in ACCOUNTS, transfers as in TRANSFERS with at most one row for an ordered pair."""

    accounts: DataFrame
    transfers: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.accounts.sparkSession

    @property
    def account_devices(self) -> DataFrame:
        return self.accounts.select("account_id", F.explode("device_ids").alias("device_id")).distinct()


def last_write_wins(transfers: DataFrame, *order: str) -> DataFrame:
    """One row for each ordered pair: the latest, ties by the further columns, later wins."""
    latest = F.struct(*[F.col(c) for c in ("executed_at", *order)])
    rest = [c for c in transfers.columns if c not in ("src", "dst")]
    kept = transfers.groupBy("src", "dst").agg(F.max_by(F.struct(*rest), latest).alias("_kept"))
    return kept.select("src", "dst", *[F.col("_kept")[c].alias(c) for c in rest])


def consecutive(events: DataFrame) -> DataFrame:
    """Each event with the user of the next one by (ts, event_id): next_user.

    Days are ordered in parallel; only one row a day goes through a single task, to join the ends.
    """
    day = F.to_date("ts")
    own = Window.partitionBy("_day").orderBy("ts", "event_id")
    marked = events.withColumn("_day", day).withColumn("_next", F.lead("user_id").over(own))
    heads = marked.groupBy("_day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("_head"))
    following = heads.select("_day", F.lead("_head").over(Window.orderBy("_day")).alias("_head_after"))
    joined = marked.join(following, "_day")
    return joined.withColumn("next_user", F.coalesce("_next", "_head_after")).drop("_day", "_next", "_head_after")


def transfers_of_events(events: DataFrame) -> DataFrame:
    """Consecutive purchasers form a transfer of the purchase's value; the last for each ordered pair stays."""
    bought = consecutive(events.where("event_type = 'purchase'").select("event_id", "ts", "user_id", "value"))
    raw = bought.where("next_user IS NOT NULL AND user_id <> next_user AND value > 0")
    rows = raw.select(F.col("user_id").alias("src"), F.col("next_user").alias("dst"), F.col("value").alias("amount"), F.col("ts").alias("executed_at"), "event_id")
    return last_write_wins(rows, "event_id").drop("event_id")


def devices_of_events(events: DataFrame) -> DataFrame:
    """(account_id, device_id): key of the properties and hour, from each user's first three signup events."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    first = events.where("event_type = 'signup'").withColumn("_n", F.row_number().over(own)).where("_n <= 3")
    name = F.concat(F.lit("D"), F.get_json_object("props", "$.k"), F.lit("-"), F.hour("ts").cast("string"))
    return first.select(F.col("user_id").alias("account_id"), name.alias("device_id")).distinct()


@dataclasses.dataclass(frozen=True)
class EventLedger:
    """The ledger view of an event table: integer account ids, devices as pairs."""

    accounts: DataFrame
    transfers: DataFrame
    account_devices: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.accounts.sparkSession


def event_ledger(spark: SparkSession, sf_dir: str) -> EventLedger:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    transfers, devices = transfers_of_events(events), devices_of_events(events)
    accounts = events.select(F.col("user_id").alias("account_id")).where("account_id IS NOT NULL").distinct()
    return EventLedger(accounts, transfers, devices)


def ledger(spark: SparkSession, accounts: list[tuple], transfers: list[tuple]) -> Ledger:
    rows = spark.createDataFrame(transfers, TRANSFERS).withColumn("_n", F.monotonically_increasing_id())
    return Ledger(spark.createDataFrame(accounts, ACCOUNTS), last_write_wins(rows, "_n").drop("_n"))


def checked_ledger(spark: SparkSession, accounts: list[tuple], transfers: list[tuple]) -> Ledger:
    """ledger() of rows that are valid and form one: broken accounts and a broken structure are LedgerErrors, broken transfers RecordErrors."""
    made = ledger(spark, accounts, transfers)
    validation.require_accounts(made.accounts)
    validation.require_valid(made.transfers, validation.transfer_reasons(), "transfer")
    validation.require_ledger(made.accounts, made.transfers)
    return made


def ring_rows(*, placement: int = 4, layering: int = 3, integration: int = 2, legitimate: int = 10, seed: int = 42) -> tuple[list[tuple], list[tuple]]:
    """A placement, layering, integration ring beside legitimate accounts, the same for the same seed."""
    if min(placement, layering, integration) < 1:
        raise LedgerError("a ring needs at least one account of each kind")
    if legitimate < 0:
        raise LedgerError("the number of legitimate accounts cannot be negative")
    draw, base = random.Random(seed), dt.datetime(2026, 1, 1, tzinfo=UTC)
    accounts, transfers, clock = [], [], base

    def open_(prefix, n, kind, holder, days, risk, shared=None):
        out = []
        for i in range(n):
            name = f"ACC-{prefix}-{i:03d}"
            opened = base - dt.timedelta(days=draw.randint(*days))
            accounts.append((name, kind, f"{holder} {i}", [shared or f"DEV-{prefix}-{i:03d}"], opened, round(draw.uniform(*risk), 3)))
            out.append(name)
        return out

    def send(src, dst, amount, channel):
        transfers.append((src, dst, amount, clock, channel))

    into = open_("PLACE", placement, "PLACEMENT", "Placement", (30, 400), (0.2, 0.5))
    through = open_("LAYER", layering, "LAYERING", "Layering", (1, 20), (0.6, 0.9), "DEV-MULE-SHARED-0001")
    out_of = open_("INTEG", integration, "INTEGRATION", "Integration", (60, 500), (0.3, 0.6))
    for a in into:
        for b in draw.sample(through, min(2, len(through))):
            clock += dt.timedelta(minutes=draw.randint(5, 45))
            send(a, b, round(draw.uniform(45_000, 95_000), 2), "IMPS")
    for a in through:
        for b in out_of:
            clock += dt.timedelta(minutes=draw.randint(5, 30))
            send(a, b, round(draw.uniform(60_000, 140_000), 2), "IMPS")
    plain = open_("LEGIT", legitimate, "LEGITIMATE", "Customer", (100, 2000), (0.0, 0.3))

    def everyday(a, b):
        nonlocal clock
        clock += dt.timedelta(hours=draw.randint(1, 72))
        amount = round(draw.uniform(500, 20_000), 2)
        send(a, b, amount, draw.choice(["UPI", "NEFT"]))

    if len(plain) == 1:
        everyday(plain[0], out_of[0])
    elif plain:
        for i, a in enumerate(plain):
            everyday(a, plain[(i + 1) % len(plain)])
        known = {(t[0], t[1]) for t in transfers}
        for a in plain:
            if draw.random() < 0.3:
                b = draw.choice([p for p in plain if p != a])
                if (a, b) not in known:
                    everyday(a, b)
                    known.add((a, b))
    return accounts, transfers


def ring_ledger(spark: SparkSession, **options) -> Ledger:
    return ledger(spark, *ring_rows(**options))


def hub_rows(customers: int = 40) -> tuple[list[tuple], list[tuple]]:
    """A laundering path through a busy hub whose layering account uses a device of its own."""
    base = dt.datetime(2026, 6, 1, tzinfo=UTC)

    def account(name, kind, device, days=30, risk=0.3):
        return (f"ACC-ADV-{name}", kind, f"Holder {name}", [f"DEV-ADV-{device}"], base - dt.timedelta(days=days), risk)

    accounts = [
        account("PLACE-000", "PLACEMENT", "PLACE-000"), account("HUB-000", "LEGITIMATE", "HUB-000", risk=0.1),
        account("LAYER-000", "LAYERING", "LAYER-UNIQUE-000", 3, 0.7), account("INTEG-000", "INTEGRATION", "INTEG-000"),
        *[account(f"CUST-{i:03d}", "LEGITIMATE", f"CUST-{i:03d}") for i in range(customers)],
    ]
    late = base + dt.timedelta(hours=5)
    transfers = [(f"ACC-ADV-CUST-{i:03d}", "ACC-ADV-HUB-000", 500.0 + 10 * i, base + dt.timedelta(minutes=i), "IMPS") for i in range(customers)]
    for a, b, amount, after in (("PLACE", "HUB", 72_000.0, 0), ("HUB", "LAYER", 71_500.0, 20), ("LAYER", "INTEG", 71_000.0, 35)):
        transfers.append((f"ACC-ADV-{a}-000", f"ACC-ADV-{b}-000", amount, late + dt.timedelta(minutes=after), "IMPS"))
    return accounts, transfers


def hub_ledger(spark: SparkSession) -> Ledger:
    return ledger(spark, *hub_rows())


def large_ledger(spark: SparkSession, accounts: int, transfers_each: int = 10, *, devices_each: float = 0.9, seed: int = 42, partitions: int | None = None) -> Ledger:
    """A synthetic ledger of any size, made on the executors; the same for the same seed, not the ring's draws."""
    ids = spark.range(0, accounts, 1, partitions)
    uniform = lambda *salt: F.pmod(F.xxhash64("id", *[F.lit(s) for s in (seed, *salt)]), F.lit(1 << 40)) / float(1 << 40)
    name = lambda c: F.concat(F.lit("ACC-"), c.cast("string"))
    base = F.lit(dt.datetime(2026, 1, 1, tzinfo=UTC))
    rows = ids.select(
        name(F.col("id")).alias("account_id"), F.lit("LEGITIMATE").alias("account_type"), F.concat(F.lit("Holder "), F.col("id").cast("string")).alias("holder_name"),
        F.array(F.concat(F.lit("DEV-"), F.floor(uniform("d") * accounts * devices_each).cast("string"))).alias("device_ids"),
        F.timestamp_add("DAY", -(1 + uniform("o") * 2000).cast("int"), base).alias("opened_at"), F.round(uniform("k"), 3).alias("kyc_risk_score"),
    )
    sent = ids.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(transfers_each))))
    salted = lambda tag: F.pmod(F.xxhash64("id", "n", F.lit(seed), F.lit(tag)), F.lit(1 << 40)) / float(1 << 40)
    moves = sent.select(
        name(F.col("id")).alias("src"), name(F.floor(salted("t") * accounts)).alias("dst"), F.round(500 + salted("a") * 90_000, 2).alias("amount"),
        F.timestamp_add("SECOND", (salted("s") * 86400 * 30).cast("int"), base).alias("executed_at"), F.when(salted("c") < 0.5, "UPI").otherwise("NEFT").alias("channel"),
    ).where("src <> dst")
    return Ledger(rows, last_write_wins(moves))
