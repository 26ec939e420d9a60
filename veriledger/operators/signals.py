"""The four structural signals of all accounts at once.

Paths: a chain is time-consistent if each next transfer follows the one before within the window, bounds included; the first
transfer is free. Chains visit no account twice. Forward and backward chains of an account are the same set of paths,
grouped by where they start and where they end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriledger.functions.scalars import micros
from veriledger.operators.chains import MAX_HOPS, WINDOW_MINUTES, best_chains, check_bounds, longest, path_levels, paths  # noqa: F401  names that users of signals have
from veriledger.storage import materialise

#: Devices of an account up to which all their subsets are counted.
MOST_DEVICES = 6


def shared_devices(accounts: DataFrame, account_devices: DataFrame, *, only: DataFrame | None = None, most_devices: int = MOST_DEVICES) -> DataFrame:
    """(account_id, shared_device_account_count): other accounts with a device in common. only: (account_id) to count for just these.

    No pairs of accounts are made: how many accounts share at least one of a few devices is a sum, with alternating signs, of how many have all of each
    subset. Equal device sets count once with a weight, subsets are summed before they are shuffled. Only accounts with more than most_devices
    devices, which are rare, meet their partners one by one.
    """
    known = accounts.select("account_id").distinct()
    pairs = account_devices.select("account_id", "device_id").distinct().join(known, "account_id", "left_semi")
    zero = F.lit(0).cast("long")
    if only is not None:
        own = pairs.join(only, "account_id", "left_semi")
        partners = own.join(pairs.select("device_id", F.col("account_id").alias("partner")), "device_id").where("partner <> account_id")
        n = partners.groupBy("account_id").agg(F.count_distinct("partner").alias("n"))
        return known.join(only, "account_id", "left_semi").join(n, "account_id", "left").select("account_id", F.coalesce("n", zero).alias("shared_device_account_count"))
    sets = pairs.groupBy("account_id").agg(F.array_sort(F.collect_set("device_id")).alias("devices"))
    few, many = sets.where(F.size("devices") <= most_devices), sets.where(F.size("devices") > most_devices)
    weights = few.groupBy("devices").agg(F.count("*").alias("n"))
    none = F.array(F.array().cast(weights.schema["devices"].dataType))
    subsets = F.aggregate("devices", none, lambda acc, d: F.concat(acc, F.transform(acc, lambda s: F.array_append(s, d))))
    spread = weights.select("devices", "n", F.explode(F.filter(subsets, lambda s: F.size(s) > 0)).alias("subset"))
    holders = spread.groupBy("subset").agg(F.sum("n").alias("holders"))
    sign = F.when(F.size("subset") % 2 == 1, 1).otherwise(-1)
    by_set = spread.join(holders, "subset").groupBy("devices").agg((F.sum(F.col("holders") * sign) - 1).alias("n_few"))
    # accounts with many devices, and those that they meet
    of_many = many.select("account_id", F.explode("devices").alias("device_id"))
    met = of_many.join(pairs.select("device_id", F.col("account_id").alias("partner")), "device_id").where("partner <> account_id").select("account_id", "partner").distinct()
    for_many = met.groupBy("account_id").agg(F.count("*").alias("extra"))
    for_few = met.join(few.select(F.col("account_id").alias("partner")), "partner", "left_semi").groupBy(F.col("partner").alias("account_id")).agg(F.count("*").alias("extra"))
    found = sets.join(by_set, "devices", "left").join(for_many.union(for_few), "account_id", "left")
    total = found.select("account_id", (F.coalesce("n_few", zero) + F.coalesce("extra", zero)).alias("shared_device_account_count"))
    return accounts.select("account_id").join(total, "account_id", "left").withColumn("shared_device_account_count", F.coalesce("shared_device_account_count", zero))


def undirected(transfers: DataFrame) -> DataFrame:
    return transfers.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _clustering_of(only: DataFrame, transfers: DataFrame) -> DataFrame:
    """clustering() of some accounts: the edges between the neighbours of each, nothing about the rest."""
    edges = undirected(transfers)
    ends = edges.toDF("v", "x").union(edges.select("b", "a").toDF("v", "x"))
    near = ends.join(only.select(F.col("account_id").alias("v")), "v", "left_semi")
    closed = near.join(edges.toDF("x", "y"), "x").join(near.select("v", F.col("x").alias("y")), ["v", "y"]).groupBy("v").agg(F.count("*").alias("t"))
    found = near.groupBy("v").agg(F.count("*").alias("k")).join(closed, "v", "left")
    rate = found.select(F.col("v").alias("account_id"), F.when(F.col("k") < 2, 0.0).otherwise(2.0 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).alias("c"))
    return only.select("account_id").distinct().join(rate, "account_id", "left").select("account_id", F.coalesce("c", F.lit(0.0)).alias("local_clustering_coefficient"))


def clustering(accounts: DataFrame, transfers: DataFrame, *, only: DataFrame | None = None) -> DataFrame:
    """(account_id, local_clustering_coefficient) of the undirected graph. only: (account_id) of accounts, for just these.

    Edges point from the end with fewer neighbours to the one with more, so no account has more than the square root of twice the edges
    as out-neighbours and hubs make no wedges of their own.
    """
    if only is not None:
        return _clustering_of(accounts.select("account_id").join(only, "account_id", "left_semi"), transfers)
    edges = undirected(transfers)
    degree = edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("k"))
    ranked = edges.join(degree.toDF("a", "ka"), "a").join(degree.toDF("b", "kb"), "b")
    forward = F.struct("ka", "a") < F.struct("kb", "b")
    pointed = ranked.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedge = pointed.select("u", F.col("v").alias("x")).join(pointed.select("u", F.col("v").alias("y")), "u").where("x < y")
    closed = wedge.join(edges.toDF("x", "y"), ["x", "y"])
    triangles = closed.select(F.explode(F.array("u", "x", "y")).alias("v")).groupBy("v").agg(F.count("*").alias("t"))
    found = degree.join(triangles, "v", "left").select(
        F.col("v").alias("account_id"), F.when(F.col("k") < 2, 0.0).otherwise(2.0 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).alias("local_clustering_coefficient")
    )
    return accounts.select("account_id").join(found, "account_id", "left").withColumn("local_clustering_coefficient", F.coalesce("local_clustering_coefficient", F.lit(0.0)))


def pivot_dwell(transfers: DataFrame) -> DataFrame:
    """(account_id, dwell_seconds): the shortest wait between a transfer in and a later or simultaneous transfer out.

    The nearest earlier transfer in is the best partner of each transfer out, so one running maximum does for all pairs. It runs within each day, and the days of an account
    hand on their latest transfer in, so a hub's transfers are dealt over its days.
    """
    us, day = micros(F.col("executed_at")), F.floor(F.col("us") / 86_400_000_000)
    into = transfers.select(F.col("dst").alias("account_id"), us.alias("us"), us.alias("in_us"), F.lit(False).alias("out"))
    out = transfers.select(F.col("src").alias("account_id"), us.alias("us"), F.lit(None).cast("long").alias("in_us"), F.lit(True).alias("out"))
    both = into.unionByName(out).withColumn("day", day)
    so_far = Window.partitionBy("account_id", "day").orderBy("us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("account_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = both.groupBy("account_id", "day").agg(F.max("in_us").alias("last"), F.max("out").alias("any_out"))
    before = days.withColumn("before", F.max("last").over(earlier)).where("any_out AND before IS NOT NULL").select("account_id", "day", "before")
    met = both.withColumn("own", F.max("in_us").over(so_far)).where("out").join(before, ["account_id", "day"], "left").withColumn("last_in", F.coalesce("own", "before")).where("last_in IS NOT NULL")
    return met.groupBy("account_id").agg((F.min(F.col("us") - F.col("last_in")) / 1e6).alias("dwell_seconds"))


def velocity(accounts: DataFrame, transfers: DataFrame, *, window_minutes: int = WINDOW_MINUTES, max_hops: int = MAX_HOPS, only: DataFrame | None = None) -> DataFrame:
    """(account_id, forward_hops, backward_hops, max_multi_hop_velocity_hops, min_hop_interval_seconds)

    The two longest chains are added without a time check where they meet; a dwell beyond the window does not count.
    only: (account_id) if just these accounts' rows matter; then chains are followed from them alone, both ways.
    """
    check_bounds(window_minutes, max_hops)
    bounds = {"window_minutes": window_minutes, "max_hops": max_hops}
    if only is None:
        best = materialise(best_chains(transfers, **bounds))
        ahead, back = (best.where(F.col("backward") == b).select("account_id", F.col("hops").alias(h), F.col("gap").alias(g)) for b, h, g in ((False, "f", "fg"), (True, "b", "bg")))
    else:
        ahead, back = longest(paths(transfers, starts=only, **bounds), "start", "f", "fg"), longest(paths(transfers, starts=only, backward=True, **bounds), "start", "b", "bg")
        accounts = accounts.join(only, "account_id", "left_semi")
        touching = only.select("account_id").distinct()
        transfers = transfers.join(touching.toDF("src"), "src", "left_semi").union(transfers.join(touching.toDF("dst"), "dst", "left_semi").select(*transfers.columns)).distinct()
    both = (
        accounts.select("account_id").join(ahead, "account_id", "left")
        .join(back, "account_id", "left").join(pivot_dwell(transfers), "account_id", "left")
    )
    dwell = F.when(F.col("dwell_seconds") <= window_minutes * 60, F.col("dwell_seconds"))
    f, b = F.coalesce("f", F.lit(0)), F.coalesce("b", F.lit(0))
    return both.select("account_id", f.alias("forward_hops"), b.alias("backward_hops"), (f + b).alias("max_multi_hop_velocity_hops"), F.least("fg", "bg", dwell).alias("min_hop_interval_seconds"))


def signals(ledger, *, window_minutes: int = WINDOW_MINUTES, max_hops: int = MAX_HOPS, only: DataFrame | None = None) -> DataFrame:
    """One row for each account (or each of only): the four signals of its neighbourhood. Transfers are written once, as all signals read them."""
    check_bounds(window_minutes, max_hops)
    accounts, transfers = ledger.accounts.select("account_id"), materialise(ledger.transfers.select("src", "dst", "executed_at"))
    moved = velocity(accounts, transfers, window_minutes=window_minutes, max_hops=max_hops, only=only).drop("forward_hops", "backward_hops")
    return clustering(accounts, transfers, only=only).join(shared_devices(accounts, ledger.account_devices, only=only), "account_id").join(moved, "account_id")
