"""Longest time-consistent chains of all accounts without writing every chain.

A walk may visit an account twice, a chain may not. The longest walk from each transfer is a dynamic program over transfers: one that goes on has length k if a transfer that
follows it within the window has length k - 1, and its smallest wait is that of the best follower. What follows a transfer lies in two slots of time as long as the window: the rest of
its own and the beginning of the next. In each, a running minimum gives the best follower, so an account with many transfers in and out makes no pairs. Walks do not go straight
back: beside the best follower the best one with another end is kept. Each step writes at most two rows a transfer and direction.

Each walk carries its accounts. Where the best walk of an account visits none twice it is the best chain. Else the chains of that account are followed one by one, but only those that can still
beat what is known to be a chain.

path_levels() writes all chains, for those who ask for them, for a few accounts, and where they are no more than a few for each transfer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriledger.errors import SignalError
from veriledger.functions.scalars import micros, seconds_between
from veriledger.storage import materialise

WINDOW_MINUTES, MAX_HOPS = 120, 6
#: Chains a transfer and depth up to which writing them one by one is cheaper than the program.
MOST_LISTED = 6


def check_bounds(window_minutes: int, max_hops: int) -> None:
    if window_minutes <= 0 or max_hops <= 0:
        raise SignalError("window and depth must be positive")


def path_levels(transfers: DataFrame, *, window_minutes: int = WINDOW_MINUTES, max_hops: int = MAX_HOPS, starts: DataFrame | None = None, backward: bool = False, most: int | None = None) -> list[DataFrame] | None:
    """For each depth the chains (start, end, last_us, gap in seconds or null, visited, k).

    A chain and its next transfer meet on the account and on slots of time as long as the window, so a hub's transfers of other days
    are never compared. Each depth is written once, since the next and the sums both read it.
    starts: (account_id) to follow only chains from these. backward: chains against the direction of transfers and time.
    most: None comes back if a depth might have more chains a transfer; that is known before they are made, from the transfers out of an account in each slot.
    """
    check_bounds(window_minutes, max_hops)
    window = window_minutes * 60 * 1_000_000
    us = micros(F.col("executed_at"))
    ends = ("dst", "src") if backward else ("src", "dst")
    moves = transfers.where("src <> dst AND executed_at IS NOT NULL").select(*ends, (-us if backward else us).alias("us")).toDF("src", "dst", "us")
    moves = materialise(moves)
    level = moves if starts is None else moves.join(starts.select(F.col("account_id").alias("src")), "src", "left_semi")
    level = level.select(F.col("src").alias("start"), F.col("dst").alias("end"), F.col("us").alias("last_us"), F.lit(None).cast("double").alias("gap"), F.array("src", "dst").alias("visited"), F.lit(1).alias("k"))
    levels = [level]
    slot = lambda c: F.floor(c / window)
    onward = moves.select(F.col("src").alias("end"), F.col("dst").alias("then"), F.col("us").alias("then_us"), slot(F.col("us")).alias("slot"))
    if most is not None:
        spare = most * moves.count()
        outs = materialise(onward.groupBy("end", "slot").agg(F.count("*").alias("n")))
    for k in range(2, max_hops + 1):
        waiting = level.withColumn("slot", F.explode(F.array(slot(F.col("last_us")), slot(F.col("last_us")) + 1)))
        if most is not None and (waiting.join(outs, ["end", "slot"]).agg(F.sum("n")).collect()[0][0] or 0) > spare:
            return None
        met = waiting.join(onward, ["end", "slot"]).where("then_us - last_us BETWEEN 0 AND " + str(window)).where(~F.array_contains("visited", F.col("then")))
        step = seconds_between(F.col("last_us"), F.col("then_us"))
        level = materialise(met.select("start", F.col("then").alias("end"), F.col("then_us").alias("last_us"), F.least("gap", step).alias("gap"), F.array_append("visited", F.col("then")).alias("visited"), F.lit(k).alias("k")))
        if level.isEmpty():
            break
        levels.append(level)
    return levels


def paths(transfers: DataFrame, **options) -> DataFrame:
    return reduce(DataFrame.unionByName, path_levels(transfers, **options))


def longest(found: DataFrame, side: str, hops: str, gap: str) -> DataFrame:
    """Longest chains by their start or end, and the smallest gap on chains of that length."""
    best = F.max(F.struct(F.col("k"), (-F.col("gap")).alias("g")))
    return found.groupBy(F.col(side).alias("account_id")).agg(best.alias("best")).select("account_id", F.col("best.k").alias(hops), (-F.col("best.g")).alias(gap))


def _moves(transfers: DataFrame) -> DataFrame:
    """Both directions: backward, transfers go from receiver to sender and time runs down."""
    base = transfers.where("src <> dst AND executed_at IS NOT NULL").select("src", "dst", micros(F.col("executed_at")).alias("us"))
    both = base.withColumn("backward", F.lit(False)).unionByName(base.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("us")).alias("us"), F.lit(True).alias("backward")))
    return materialise(both.withColumn("id", F.monotonically_increasing_id()))


def walk_levels(moves: DataFrame, window: int, max_hops: int) -> list[DataFrame]:
    """For each length k the walks (backward, id, src, dst, us, gap, chain, twice, k): of each first transfer those with the smallest gap (at most two, one for each slot).

    gap: the smallest wait in microseconds, null for single transfers; chain: the accounts; twice: whether one of them is visited twice.
    """
    slot = lambda c: F.floor(c / window)
    own = F.struct(slot(F.col("us")).alias("slot"), F.lit(False).alias("next"), (-F.col("us")).alias("at"))
    after = F.struct((slot(F.col("us")) + 1).alias("slot"), F.lit(True).alias("next"), (F.col("us") + window).alias("at"))
    asked = moves.select("backward", "id", "src", F.col("dst").alias("v"), "dst", "us", F.explode(F.array(own, after)).alias("p")).select("backward", "id", "src", "dst", "v", "us", "p.*", F.lit(True).alias("asks"))
    both_sides = F.array(own, F.struct(slot(F.col("us")).alias("slot"), F.lit(True).alias("next"), F.col("us").alias("at")))
    level = moves.select("backward", "id", "src", "dst", "us", F.lit(None).cast("long").alias("gap"), F.array("src", "dst").alias("chain"), F.lit(False).alias("twice"), F.lit(1).alias("k"))
    levels = [level]
    order = Window.partitionBy("backward", "v", "slot", "next").orderBy("at", "asks", "id")
    so_far, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)

    def best(rows: DataFrame, offers: dict[str, Column]) -> DataFrame:
        """rows with, for each name of an offer, the least offer so far and (name_2) the least with another end.

        Of a new offer and the best before it the loser is kept if their ends differ; the least loser never ends where the best does, as whatever the best has overtaken was better.
        """
        rows = rows.withColumns({f"_{n}": c for n, c in offers.items()})
        rows = rows.withColumns({n: F.min(f"_{n}").over(so_far) for n in offers} | {f"_{n}_before": F.min(f"_{n}").over(earlier) for n in offers})
        lost = lambda n: F.when(F.col(f"_{n}.end") != F.col(f"_{n}_before.end"), F.greatest(f"_{n}", f"_{n}_before"))
        return rows.withColumns({f"{n}_2": F.min(lost(n)).over(so_far) for n in offers})

    for k in range(2, max_hops + 1):
        outs = level.select("backward", "id", F.col("src").alias("v"), F.col("us").alias("then"), "dst", "gap", "chain", "twice", F.explode(both_sides).alias("p"))
        outs = outs.select("backward", "id", "v", "then", F.col("dst").alias("end"), "gap", "chain", "twice", "p.*", F.lit(False).alias("asks"))
        rows = asked.unionByName(outs, allowMissingColumns=True)
        offer = lambda by: F.when(~F.col("asks") & F.col(by).isNotNull(), F.struct(by, "twice", "end", "chain"))
        rows = best(rows, {"soon": offer("then"), "tight": offer("gap")})
        onward = lambda name: F.when(F.col(f"{name}.end") != F.col("src"), F.col(name)).otherwise(F.col(f"{name}_2"))
        met = rows.where("asks").withColumn("soon", onward("soon")).withColumn("tight", onward("tight")).where("soon IS NOT NULL")
        wait = F.col("soon.then") - F.col("us")
        tighter = F.coalesce(F.struct(F.col("tight.gap"), F.col("tight.twice")) < F.struct(wait, F.col("soon.twice")), F.lit(False)) & F.col("tight").isNotNull()
        chosen = lambda f: F.when(tighter, F.col(f"tight.{f}")).otherwise(F.col(f"soon.{f}"))
        met = met.withColumn("_rest", chosen("chain")).withColumn("_twice", chosen("twice")).withColumn("gap", F.least(wait, F.col("tight.gap")))
        level = materialise(met.select(
            "backward", "id", "src", "dst", "us", "gap", F.concat(F.array("src"), "_rest").alias("chain"), (F.col("_twice") | F.array_contains("_rest", F.col("src"))).alias("twice"), F.lit(k).alias("k"),
        ))
        if level.isEmpty():
            break
        levels.append(level)
    return levels


def _followed(moves: DataFrame, walks: DataFrame, open_starts: DataFrame, window: int, max_hops: int) -> DataFrame:
    """(backward, src, best: k and -gap) of chains from open_starts (backward, src, sure_k, sure_gap), as far as they beat what is sure."""
    ahead = walks.groupBy("id").agg(F.max("k").alias("reach"), F.min("gap").alias("least"))
    moves = materialise(moves.join(ahead, "id"))
    slot = lambda c: F.floor(c / window)
    could = F.least(F.col("k") - 1 + F.col("reach"), F.lit(max_hops))
    hope = (could > F.col("sure_k")) | (could == F.col("sure_k")) & F.coalesce(F.least("gap", "least") < F.col("sure_gap"), F.lit(False))
    first = moves.join(open_starts, ["backward", "src"]).withColumn("gap", F.lit(None).cast("long")).withColumn("k", F.lit(1)).where(hope)
    kept = ["backward", "start", "end", "us", "gap", "visited", "sure_k", "sure_gap", "k"]
    level = materialise(first.select("backward", F.col("src").alias("start"), F.col("dst").alias("end"), "us", "gap", F.array("src", "dst").alias("visited"), "sure_k", "sure_gap", "k"))
    levels = [level]
    onward = moves.select("backward", F.col("src").alias("end"), F.col("dst").alias("then"), F.col("us").alias("then_us"), slot(F.col("us")).alias("slot"), "reach", "least")
    for k in range(2, max_hops + 1):
        waiting = level.withColumn("slot", F.explode(F.array(slot(F.col("us")), slot(F.col("us")) + 1)))
        met = waiting.join(onward, ["backward", "end", "slot"]).where(f"then_us - us BETWEEN 0 AND {window}").where(~F.array_contains("visited", F.col("then")))
        met = met.withColumn("gap", F.least("gap", F.col("then_us") - F.col("us"))).withColumn("k", F.lit(k)).where(hope)
        level = materialise(met.withColumn("visited", F.array_append("visited", F.col("then"))).drop("end", "us").withColumnsRenamed({"then": "end", "then_us": "us"}).select(*kept))
        if level.isEmpty():
            break
        levels.append(level)
    every = reduce(DataFrame.unionByName, levels)
    return every.groupBy("backward", F.col("start").alias("src")).agg(F.max(F.struct("k", (-F.col("gap")).alias("g"))).alias("best"))


def best_chains(transfers: DataFrame, *, window_minutes: int = WINDOW_MINUTES, max_hops: int = MAX_HOPS, most_listed: int = MOST_LISTED) -> DataFrame:
    """(backward, account_id, hops, gap): the length of the longest chains that start (or, backward, end) at each account and the smallest wait in seconds on chains of that length.

    transfers: src, dst, executed_at. Null accounts, null times and transfers to oneself take no part.
    Where chains do not multiply, so that no depth has more than most_listed of them a transfer, they are written; else the program runs. Both give the same rows, and either writes
    rows in proportion to the transfers.
    """
    check_bounds(window_minutes, max_hops)
    window = window_minutes * 60 * 1_000_000
    transfers = transfers.where("src IS NOT NULL AND dst IS NOT NULL")
    if levels := path_levels(transfers, window_minutes=window_minutes, max_hops=max_hops, most=most_listed):
        chains = reduce(DataFrame.unionByName, levels)
        sides = [longest(chains, side, "hops", "gap").withColumn("backward", F.lit(backward)) for side, backward in (("start", False), ("end", True))]
        return sides[0].union(sides[1]).select("backward", "account_id", "hops", "gap")
    moves = _moves(transfers)
    walks = reduce(DataFrame.unionByName, walk_levels(moves, window, max_hops))
    rank = F.struct("k", (-F.col("gap")).alias("g"))
    found = walks.groupBy("backward", "src").agg(F.max(F.struct("k", (-F.col("gap")).alias("g"), (~F.col("twice")).alias("chain"))).alias("walk"), F.max(F.when(~F.col("twice"), rank)).alias("sure"))
    found = materialise(found)
    doubtful = found.where("NOT walk.chain").select("backward", "src", F.col("sure.k").alias("sure_k"), (-F.col("sure.g")).alias("sure_gap"))
    out = found.select("backward", "src", F.col("sure").alias("best"))
    if not doubtful.isEmpty():
        out = out.unionByName(_followed(moves, walks, doubtful, window, max_hops)).groupBy("backward", "src").agg(F.max("best").alias("best"))
    return out.select("backward", F.col("src").alias("account_id"), F.col("best.k").alias("hops"), (-F.col("best.g") / 1e6).alias("gap"))
