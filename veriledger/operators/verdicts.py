"""Thresholds and the rule that turns signals into a verdict with reasons."""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriledger.errors import SignalError, ThresholdError
from veriledger.functions.scalars import fixed
from veriledger.operators import signals as S
from veriledger.storage import materialise

SAFE, FLAGGED = "SAFE", "FLAGGED"


@dataclasses.dataclass(frozen=True)
class Thresholds:
    min_clustering_coefficient: float = 0.5
    min_shared_device_neighbors: int = 2
    min_velocity_hops: int = 2
    max_hop_interval_seconds: float = 3600.0

    def __post_init__(self):
        if not 0 <= self.min_clustering_coefficient <= 1:
            raise ThresholdError("min_clustering_coefficient must be between 0 and 1")
        for name in ("min_shared_device_neighbors", "min_velocity_hops", "max_hop_interval_seconds"):
            if getattr(self, name) < 0:
                raise ThresholdError(f"{name} cannot be negative")

    def columns(self) -> dict[str, Column]:
        return {f.name: F.lit(getattr(self, f.name)) for f in dataclasses.fields(self)}


def fired(t: dict[str, Column]) -> dict[str, Column]:
    """Which signals fire, in the order of the reasons. A missing interval never does."""
    return {
        "device": F.col("shared_device_account_count") >= t["min_shared_device_neighbors"],
        "clustering": F.col("local_clustering_coefficient") >= t["min_clustering_coefficient"],
        "hops": F.col("max_multi_hop_velocity_hops") >= t["min_velocity_hops"],
        "speed": F.coalesce(F.col("min_hop_interval_seconds") <= t["max_hop_interval_seconds"], F.lit(False)),
    }


def device_gate(s: dict[str, Column]) -> Column:
    """The default rule: a shared device, and any other signal."""
    return s["device"] & (s["clustering"] | s["hops"] | s["speed"])


def device_or_fast_chain(s: dict[str, Column]) -> Column:
    """An alternative that a change of device does not get around: a shared device, or long and fast chains."""
    return s["device"] | (s["hops"] & s["speed"])


def decide(measured: DataFrame, thresholds: Thresholds | None = None, *, rule=device_gate, texts: bool = False) -> DataFrame:
    """measured with verdict and reason_codes (none for SAFE); texts adds triggered_reasons, written out."""
    t = (thresholds or Thresholds()).columns()
    s = fired(t)
    flagged = F.coalesce(rule(s), F.lit(False))
    none = F.array().cast("array<string>")
    codes = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in s.items()]))
    out = measured.withColumn("verdict", F.when(flagged, FLAGGED).otherwise(SAFE)).withColumn("reason_codes", F.when(flagged, codes).otherwise(none))
    if not texts:
        return out
    said = {
        "device": F.concat(F.lit("shared_device_account_count="), F.col("shared_device_account_count").cast("string"), F.lit(" >= threshold="), t["min_shared_device_neighbors"].cast("string")),
        "clustering": F.concat(F.lit("local_clustering_coefficient="), fixed(F.col("local_clustering_coefficient"), 3), F.lit(" >= threshold="), fixed(t["min_clustering_coefficient"], 3)),
        "hops": F.concat(F.lit("max_multi_hop_velocity_hops="), F.col("max_multi_hop_velocity_hops").cast("string"), F.lit(" >= threshold="), t["min_velocity_hops"].cast("string")),
        "speed": F.concat(F.lit("min_hop_interval_seconds="), fixed(F.col("min_hop_interval_seconds"), 1), F.lit(" <= threshold="), fixed(t["max_hop_interval_seconds"], 1)),
    }
    written = F.array_compact(F.array(*[F.when(F.array_contains("reason_codes", n), text) for n, text in said.items()]))
    return out.withColumn("triggered_reasons", written)


def verdicts(ledger, thresholds: Thresholds | None = None, *, window_minutes: int = S.WINDOW_MINUTES, max_hops: int = S.MAX_HOPS, rule=device_gate, texts: bool = False, only: DataFrame | None = None) -> DataFrame:
    """Signals and verdict of every account, or of those in only (account_id)."""
    return decide(S.signals(ledger, window_minutes=window_minutes, max_hops=max_hops, only=only), thresholds, rule=rule, texts=texts)


def verdict_of(ledger, account_id, thresholds: Thresholds | None = None, *, window_minutes: int = S.WINDOW_MINUTES, max_hops: int = S.MAX_HOPS, rule=device_gate, texts: bool = False) -> DataFrame:
    """The verdict of one account: the same row as in verdicts(), from chains of that account alone."""
    one = ledger.accounts.where(F.col("account_id") == F.lit(account_id)).select("account_id")
    if one.isEmpty():
        raise SignalError(f"no account {account_id}")
    measured = S.signals(ledger, window_minutes=window_minutes, max_hops=max_hops, only=one).where(F.col("account_id") == F.lit(account_id))
    return decide(measured, thresholds, rule=rule, texts=texts)


def sweep(measured: DataFrame, many: dict[str, Thresholds]) -> DataFrame:
    """(setting, verdict, n) for each setting, from one pass over the signals."""
    settings = F.array(*[F.struct(F.lit(name).alias("setting"), *[c.alias(n) for n, c in t.columns().items()]) for name, t in many.items()])
    spread = measured.withColumn("_t", F.explode(settings))
    t = {f.name: F.col("_t")[f.name] for f in dataclasses.fields(Thresholds)}
    verdict = F.when(F.coalesce(device_gate(fired(t)), F.lit(False)), FLAGGED).otherwise(SAFE)
    return spread.groupBy(F.col("_t.setting").alias("setting"), verdict.alias("verdict")).agg(F.count("*").alias("n"))


#: Axis ranks that the dense grid of a sweep may have, and thresholds of one axis that come to the driver.
MOST_CELLS, MOST_STEPS = 1 << 20, 1000
#: Where there are more: combinations of thresholds in a block, parts of the accounts that each block meets. Combinations up to which their counts are sent to the settings.
BLOCK, PARTS, MOST_SENT = 4096, 64, 100_000


def sweep_table(measured: DataFrame, settings: DataFrame) -> DataFrame:
    """(setting, verdict, n) of the default rule for the rows of settings (setting, and a column for each threshold), with no work for accounts x settings.

    Any number of settings: equal combinations of thresholds are decided once. A signal only matters by how many of the thresholds on its axis it meets. Accounts are counted by these four
    ranks; sums along the axes then give, for every combination at once, the accounts with the device signal and those of them with no other signal. Verdicts that no account has are left
    out; rows of settings with one name are added up. The grid has one place for each combination of ranks; where thresholds are so many that it would pass MOST_CELLS, distinct signals
    meet blocks of combinations instead.
    """
    names = [f.name for f in dataclasses.fields(Thresholds)]
    settings = settings.select("setting", *[F.col(n).cast("double").alias(n) for n in names])
    asked = materialise(settings.select(*names).distinct())
    found = asked.agg(F.count("*").alias("n"), *[f(n).alias(f"{k}_{n}") for n in names for k, f in (("known", F.count), ("steps", F.count_distinct), ("min", F.min), ("max", F.max))]).collect()[0]
    if not found["n"]:
        return settings.select("setting", F.lit(SAFE).alias("verdict"), F.lit(0).cast("long").alias("n")).limit(0)
    if any(found[f"known_{n}"] < found["n"] for n in names):
        raise ThresholdError("a threshold is missing")
    for end in ("min", "max"):
        Thresholds(**{n: found[f"{end}_{n}"] for n in names})
    steps = {n: found[f"steps_{n}"] for n in names}
    dense = max(steps.values()) <= MOST_STEPS and math.prod(k + 1 for k in steps.values()) <= MOST_CELLS
    flagged = (_flagged_by_ranks if dense else _flagged_by_blocks)(measured, asked, names, found["n"])
    flagged = F.broadcast(flagged) if found["n"] <= MOST_SENT else flagged
    total = measured.count()
    verdicts_ = F.array(F.struct(F.lit(FLAGGED).alias("verdict"), F.col("flagged").alias("n")), F.struct(F.lit(SAFE).alias("verdict"), (F.lit(total) - F.col("flagged")).alias("n")))
    return settings.join(flagged, names).select("setting", F.inline(verdicts_)).where("n > 0").groupBy("setting", "verdict").agg(F.sum("n").cast("long").alias("n"))


def _flagged_by_ranks(measured: DataFrame, asked: DataFrame, names: list[str], _: int) -> DataFrame:
    """(a column for each threshold, flagged) of each row of asked, from running sums over the grid of ranks."""
    clustering, device, hops, speed = names
    steps = {n: sorted(r[0] for r in asked.select(n).distinct().collect()) for n in names}
    value = {clustering: "local_clustering_coefficient", device: "shared_device_account_count", hops: "max_multi_hop_velocity_hops", speed: "min_hop_interval_seconds"}
    axis = lambda n: F.array(*[F.lit(float(x)) for x in steps[n]])
    meets = lambda n, x, v: x <= v if n != speed else x >= v
    rank = lambda n, v: F.size(F.filter(axis(n), lambda x: meets(n, x, v)))
    signal = lambda n: F.col(value[n]).cast("double")
    counted = measured.select(*[F.when(signal(n).isNull(), 0).otherwise(rank(n, signal(n))).alias(n) for n in names]).groupBy(*names).agg(F.count("*").alias("n"))
    size = {n: len(steps[n]) + 1 for n in names}
    place, places = F.col("id"), {}
    for n in names:
        places[n] = (place % size[n]).cast("int").alias(n)
        place = F.floor(place / size[n])
    grid = measured.sparkSession.range(math.prod(size.values())).select(*places.values()).join(counted, names, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    for n in names:
        order = F.desc(n) if n == device else F.asc(n)
        grid = grid.withColumn("n", F.sum("n").over(Window.partitionBy(*[m for m in names if m != n]).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    grid = materialise(grid)
    others = [n for n in names if n != device]
    ranks = {n: f"_{n}" for n in names}
    with_device = grid.where(" AND ".join(f"{n} = {size[n] - 1}" for n in others)).select(F.col(device).alias(ranks[device]), F.col("n").alias("with_device"))
    alone = grid.select(F.col(device).alias(ranks[device]), *[(F.col(n) + 1).alias(ranks[n]) for n in others], F.col("n").alias("alone"))
    # the rank at which a threshold is met: all thresholds that are easier to meet, and itself
    placed = asked.select(*names, *[rank(n, F.col(n)).alias(ranks[n]) for n in names])
    return placed.join(F.broadcast(with_device), ranks[device]).join(alone, list(ranks.values())).select(*names, (F.col("with_device") - F.col("alone")).alias("flagged"))


def _flagged_by_blocks(measured: DataFrame, asked: DataFrame, names: list[str], n_asked: int) -> DataFrame:
    """The same from each pair of distinct signals and combinations, in blocks of bounded size; the pairs are counted where they meet."""
    signals = ["local_clustering_coefficient", "shared_device_account_count", "max_multi_hop_velocity_hops", "min_hop_interval_seconds"]
    counted = measured.groupBy(*signals).agg(F.count("*").alias("n"))
    n_blocks = math.ceil(n_asked / BLOCK)
    dealt = lambda columns, n: F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = counted.withColumn("part", dealt(signals, PARTS)).withColumn("block", every(n_blocks))
    right = asked.withColumn("block", dealt(names, n_blocks)).withColumn("part", every(PARTS))
    met = left.join(right, ["block", "part"]).where(F.coalesce(device_gate(fired({n: F.col(n) for n in names})), F.lit(False)))
    n = met.groupBy(*names).agg(F.sum("n").alias("flagged"))
    return asked.join(n, names, "left").select(*names, F.coalesce("flagged", F.lit(0).cast("long")).alias("flagged"))
