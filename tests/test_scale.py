"""Plans that have to hold for hubs and common devices: the same results as brute force, also for accounts with many devices and for a few accounts alone."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriledger import storage
from veriledger.errors import IndexError_, LedgerError, RecordError
from veriledger.operators import evaluation, signals
from veriledger.sources import ledger as L
from veriledger.sources import model

BASE = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def devices():
    rnd = random.Random(4)
    own = {f"a{i}": {"common", *(f"d{rnd.randrange(25)}" for _ in range(rnd.randint(0, 3)))} if i % 3 else {f"d{rnd.randrange(25)}"} for i in range(60)}
    own |= {f"many{i}": {f"d{j}" for j in range(i, i + 12)} for i in range(3)} | {"none": set()}
    return own


@pytest.fixture(scope="module")
def moves():
    rnd = random.Random(6)
    out = {}
    for _ in range(400):
        a, b = ("hub", f"a{rnd.randrange(40)}") if rnd.random() < 0.3 else (f"a{rnd.randrange(40)}", f"a{rnd.randrange(40)}")
        if a != b:
            out[(a, b) if rnd.random() < 0.5 else (b, a)] = BASE + dt.timedelta(minutes=10 * rnd.randrange(900))
    return [(a, b, 1.0, t, "UPI") for (a, b), t in out.items()]


def test_shared_devices(spark, devices):
    accounts = spark.createDataFrame([(a,) for a in devices], "account_id string")
    pairs = spark.createDataFrame([(a, d) for a, own in devices.items() for d in own], "account_id string, device_id string")
    want = {a: sum(1 for b, other in devices.items() if b != a and own & other) for a, own in devices.items()}
    for most in (0, 2, 6):
        assert {r[0]: r[1] for r in signals.shared_devices(accounts, pairs, most_devices=most).collect()} == want, most
    some = accounts.where("account_id IN ('a1', 'many1', 'none')")
    assert {r[0]: r[1] for r in signals.shared_devices(accounts, pairs, only=some).collect()} == {a: want[a] for a in ("a1", "many1", "none")}
    plan = signals.shared_devices(accounts, pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan


def test_device_overlap_makes_no_pairs_of_accounts(spark, devices):
    accounts = spark.createDataFrame([(a,) for a in devices], "account_id string")
    pairs = spark.createDataFrame([*((a, d) for a, own in devices.items() for d in own), (None, "d1"), ("a1", None), ("stranger", "d2")], "account_id string, device_id string")
    every = devices | {"stranger": {"d2"}}
    want = {a: sum(1 for b, other in every.items() if b != a and own & other) for a, own in devices.items()}
    for most in (0, 2, 5):
        assert {r[0]: r[1] for r in evaluation.device_overlap(pairs, accounts, most_combined=most).collect()} == want, most
    # one device for all: what joins make stays in proportion to the accounts
    n = 3000
    common = spark.range(n).select(F.col("id").alias("account_id"), F.lit("d").alias("device_id"))
    found = evaluation.device_overlap(common, spark.range(n).toDF("account_id"))
    assert found.where(F.col("shared_device_account_count") != n - 1).isEmpty()
    most = _most_rows(found)
    assert 0 < most < 20 * n


def _most_rows(df) -> int:
    """Rows of the largest output among the operators of a plan that has run."""
    df.collect()
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            plan.append(node.executedPlan())
        if hasattr(node, "plan") and node.nodeName().endswith("QueryStage"):
            plan.append(node.plan())
    return most


def test_dwell_and_clustering_with_a_hub(spark, moves):
    transfers = spark.createDataFrame(moves, L.TRANSFERS)
    want = {}
    for a, b in itertools.product(moves, moves):
        if a[1] == b[0] and b[3] >= a[3]:
            gap = (b[3] - a[3]).total_seconds()
            want[a[1]] = min(want.get(a[1], gap), gap)
    assert {r[0]: r[1] for r in signals.pivot_dwell(transfers).collect()} == want
    accounts = spark.createDataFrame([(f"a{i}",) for i in range(41)] + [("hub",)], "account_id string")
    whole = {r[0]: r[1] for r in signals.clustering(accounts, transfers).collect()}
    few = accounts.where("account_id IN ('hub', 'a3', 'a40')")
    assert {r[0]: round(r[1], 12) for r in signals.clustering(accounts, transfers, only=few).collect()} == {a: round(whole[a], 12) for a in ("hub", "a3", "a40")}


def test_scopes_remove_tables(spark, tmp_path):
    import glob

    at = storage.shared_dir(spark)
    before = set(glob.glob(f"{at}/veriledger-*"))
    with storage.scope(spark) as kept:
        storage.materialise(spark.range(3))
        kept.append(storage.materialise(spark.range(4)))
    assert len(set(glob.glob(f"{at}/veriledger-*")) - before) == 1 and kept[0].count() == 4
    storage.discard(kept[0])
    assert set(glob.glob(f"{at}/veriledger-*")) == before


def test_checked_ledger(spark):
    person = lambda name, risk=0.5: (name, "LEGITIMATE", "h", ["d"], BASE, risk)
    people = [person("a"), person("b")]
    assert L.checked_ledger(spark, people, [("a", "b", 1.0, BASE, "UPI")]).transfers.count() == 1
    for accounts, transfers, error in (([person("a", 2.0)], [], LedgerError), (people, [("a", "b", -1.0, BASE, "UPI")], RecordError), (people, [("a", "c", 1.0, BASE, "UPI")], LedgerError), ([*people, person("c")], [("a", "b", 1.0, BASE, "UPI")], LedgerError)):
        with pytest.raises(error):
            L.checked_ledger(spark, accounts, transfers)


def test_word_vectors(spark, tmp_path):
    np.savez(tmp_path / model.FILE, words=np.array(["left", "right"]), matrix=np.array([[2.0, 0.0], [0.0, 4.0]]))
    embed = model.load_embedder(spark, str(tmp_path))
    rows = spark.createDataFrame([("Left",), ("left right",), ("none",), (None,)], "t string").select(embed(F.col("t")).alias("v")).collect()
    assert [[round(x, 6) for x in r["v"]] for r in rows] == [[1.0, 0.0], [round(1 / 5**0.5, 6), round(2 / 5**0.5, 6)], [0.0, 0.0], [0.0, 0.0]]
    with pytest.raises(IndexError_):
        model.load_embedder(spark, str(tmp_path / "none"))
