"""Longest chains from the program over transfers, against walking all chains, and what it writes for a hub."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from veriledger.operators import chains as C

BASE = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "src string, dst string, executed_at timestamp"


def brute(moves, window, hops):
    best = {}

    def go(path, last, gap):
        k = len(path) - 1
        for backward, start in ((False, path[0]), (True, path[-1])):
            rank = (k, -gap if gap is not None else float("-inf"))
            if rank > best.get((backward, start), (0, 0)):
                best[(backward, start)] = rank
        if k < hops:
            for a, b, t in moves:
                wait = (t - last).total_seconds()
                if a == path[-1] and b not in path and 0 <= wait <= window * 60:
                    go([*path, b], t, wait if gap is None else min(gap, wait))

    for a, b, t in moves:
        if a != b:
            go([a, b], t, None)
    return {k: (n, None if g == float("-inf") else -g) for k, (n, g) in best.items()}


def found(spark, moves, window, hops, **options):
    rows = C.best_chains(spark.createDataFrame(moves, SCHEMA), window_minutes=window, max_hops=hops, **options).collect()
    return {(r["backward"], r["account_id"]): (r["hops"], r["gap"]) for r in rows}


@pytest.mark.parametrize("seed,accounts,n,spread,window,hops", [(1, 6, 40, 90, 20, 6), (2, 5, 30, 12, 10, 4), (3, 30, 150, 400, 60, 6), (4, 4, 12, 3, 5, 6)])
def test_chains_equal_walking(spark, seed, accounts, n, spread, window, hops):
    """Few accounts and short times, so that most long walks come back to an account."""
    rnd = random.Random(seed)
    moves = [(f"a{rnd.randrange(accounts)}", f"a{rnd.randrange(accounts)}", BASE + dt.timedelta(minutes=rnd.randrange(spread))) for _ in range(n)]
    want = brute(moves, window, hops)
    for most in (0, 10**6):
        assert found(spark, moves, window, hops, most_listed=most) == want, most


def test_bounds_of_the_window_and_equal_times(spark):
    at = lambda m: BASE + dt.timedelta(minutes=m)
    moves = [("a", "b", at(0)), ("b", "c", at(120)), ("c", "d", at(241)), ("x", "y", at(7)), ("y", "z", at(7)), ("z", "z", at(7))]
    got = found(spark, moves, 120, 6, most_listed=0)
    assert got[(False, "a")] == (2, 7200.0) and got[(True, "c")] == (2, 7200.0) and got[(False, "c")] == (1, None) and got[(False, "x")] == (2, 0.0) and (False, "z") not in got


def test_a_hub_writes_rows_in_proportion_to_its_transfers(spark):
    """Everybody pays the hub and is paid by it within one window: chains are as many as pairs, rows are not."""
    n = 400
    moves = [(f"a{i}", "hub", BASE + dt.timedelta(seconds=i)) for i in range(n)] + [("hub", f"a{i}", BASE + dt.timedelta(seconds=n + i)) for i in range(n)]
    made = C._moves(spark.createDataFrame(moves, SCHEMA))
    levels = C.walk_levels(made, 7_200_000_000, 6)
    assert sum(level.count() for level in levels) <= 2 * 2 * len(levels) * len(moves)
    assert C.path_levels(spark.createDataFrame(moves, SCHEMA), most=C.MOST_LISTED) is None
    got = found(spark, moves, 120, 6)
    assert got[(False, "a0")] == (2, 400.0 + 1) and got[(False, "a399")] == (2, 1.0) and got[(False, "hub")] == (1, None) and got[(True, "a0")] == (2, 1.0) and got[(True, "a399")] == (2, 401.0)


def test_no_transfers(spark):
    assert found(spark, [], 120, 6) == {}
    assert found(spark, [("a", "a", BASE), ("a", None, BASE), ("a", "b", None)], 120, 6) == {}
