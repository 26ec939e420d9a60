from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from veriledger.errors import SignalError, ThresholdError, TopologyEvaluationError
from veriledger.operators import evaluation, signals
from veriledger.operators import verdicts as V
from veriledger.queries import HUB, RING
from veriledger.sources import ledger as L

UTC = dt.timezone.utc
BASE = dt.datetime(2026, 1, 1, tzinfo=UTC)


def chains(edges, start, window, most, forward):
    """(longest chain, smallest gap among chains of that length) by walking every simple path."""
    best: list = [0, None]

    def walk(at, last, k, gap, seen):
        if (k, -(gap if gap is not None else float("inf"))) > (best[0], -(best[1] if best[1] is not None else float("inf"))):
            best[:] = [k, gap]
        if k == most:
            return
        for a, b, t in edges:
            here, then = (a, b) if forward else (b, a)
            if here != at or then in seen:
                continue
            step = None if last is None else (t - last if forward else last - t)
            if step is None or 0 <= step <= window:
                walk(then, t, k + 1, gap if step is None else step if gap is None else min(gap, step), seen | {then})

    walk(start, None, 0, None, {start})
    return tuple(best)


@pytest.fixture(scope="module")
def graph(spark):
    rnd = random.Random(4)
    names = [f"n{i}" for i in range(9)]
    edges = {}
    for _ in range(34):
        a, b = rnd.sample(names, 2)
        edges[a, b] = rnd.randrange(0, 400) * 60
    rows = [(a, b, 1.0, BASE + dt.timedelta(seconds=t), "x") for (a, b), t in edges.items()]
    accounts = [(n, "LEGITIMATE", n, sorted(rnd.sample(["d1", "d2", "d3", "d4", "d5"], rnd.randint(1, 2))), BASE, 0.1) for n in [*names, "alone"]]
    return L.ledger(spark, accounts, rows), [(a, b, t) for (a, b), t in edges.items()], accounts


def test_signals_equal_brute_force(graph):
    ledger, edges, accounts = graph
    got = {r["account_id"]: r for r in signals.signals(ledger, window_minutes=90, max_hops=4).collect()}
    window = 90 * 60
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    devices = {a[0]: set(a[3]) for a in accounts}
    for name in devices:
        f, fg = chains(edges, name, window, 4, True)
        b, bg = chains(edges, name, window, 4, False)
        dwell = [o - i for _, x, i in edges if x == name for y, _, o in edges if y == name and o >= i]
        waits = [g for g in (fg, bg, min(dwell) if dwell and min(dwell) <= window else None) if g is not None]
        own = sorted(near.get(name, ()))
        closed = sum(v in near[u] for i, u in enumerate(own) for v in own[:i])
        r = got[name]
        assert r["max_multi_hop_velocity_hops"] == f + b
        assert r["min_hop_interval_seconds"] == (min(waits) if waits else None)
        assert r["local_clustering_coefficient"] == pytest.approx(2 * closed / (len(own) * (len(own) - 1)) if len(own) > 1 else 0)
        assert r["shared_device_account_count"] == sum(bool(devices[name] & d) for n, d in devices.items() if n != name)
    assert any(r["local_clustering_coefficient"] > 0 for r in got.values())


@pytest.mark.parametrize(("make", "want"), [(L.ring_ledger, RING), (L.hub_ledger, HUB)])
def test_goldens(spark, make, want):
    got = sorted((r["account_id"], r["shared_device_account_count"], r["max_multi_hop_velocity_hops"], r["min_hop_interval_seconds"], r["verdict"]) for r in V.verdicts(make(spark)).collect())
    assert got == sorted(want)


def test_reasons_are_written_out(spark):
    got = {r["account_id"]: r["triggered_reasons"] for r in V.verdicts(L.ring_ledger(spark), texts=True).collect()}
    assert got["ACC-LAYER-001"] == ["shared_device_account_count=2 >= threshold=2", "max_multi_hop_velocity_hops=2 >= threshold=2", "min_hop_interval_seconds=3300.0 <= threshold=3600.0"]
    assert len(got["ACC-LAYER-000"]) == 2 and got["ACC-LEGIT-000"] == []


def test_one_account_equals_all(spark):
    ring = L.ring_ledger(spark)
    one = V.verdict_of(ring, "ACC-LAYER-001").collect()
    assert one == V.verdicts(ring).where("account_id = 'ACC-LAYER-001'").collect()
    with pytest.raises(SignalError):
        V.verdict_of(ring, "nobody")


def test_thresholds(spark):
    for bad in ({"min_clustering_coefficient": 1.5}, {"min_velocity_hops": -1}, {"max_hop_interval_seconds": -1.0}):
        with pytest.raises(ThresholdError):
            V.Thresholds(**bad)
    measured = signals.signals(L.ring_ledger(spark))
    n = {(r["setting"], r["verdict"]): r["n"] for r in V.sweep(measured, {"lenient": V.Thresholds(0.0, 0, 0, 1e9), "strict": V.Thresholds(1.0, 9, 12, 0.0)}).collect()}
    assert n["lenient", "FLAGGED"] == 19 and n["strict", "SAFE"] == 19


def test_bounds(spark):
    for options in ({"window_minutes": 0}, {"max_hops": 0}):
        with pytest.raises(SignalError):
            signals.signals(L.ring_ledger(spark), **options)


def test_alternative_rule_catches_the_hub_attack(spark):
    hub = L.hub_ledger(spark)
    got = {r["account_id"]: r["verdict"] for r in V.verdicts(hub, rule=V.device_or_fast_chain).collect()}
    assert got["ACC-ADV-LAYER-000"] == "FLAGGED" and got["ACC-ADV-CUST-000"] == "SAFE"


def test_independent_evaluation(spark):
    ring = L.ring_ledger(spark)
    decided = V.verdicts(ring)
    report, found = evaluation.topology_report(decided, ring)
    row = report.collect()[0]
    assert (row["tp"], row["fp"], row["tn"], row["fn"], row["precision"], row["recall"], row["f1"], row["accuracy"]) == (3, 0, 16, 0, 1.0, 1.0, 1.0, 1.0)
    assert row["has_zero_degradation"] and found.isEmpty()
    worse = decided.withColumn("shared_device_account_count", F.col("shared_device_account_count") + 1)
    assert evaluation.topology_report(worse, ring)[1].count() == 19
    with pytest.raises(TopologyEvaluationError):
        evaluation.topology_report(decided.limit(0), ring)
    with pytest.raises(TopologyEvaluationError):
        evaluation.topology_report(decided.withColumn("account_id", F.lit("nobody")), ring)


def test_rates_on_nothing(spark):
    row = evaluation.confusion(spark.createDataFrame([], "t boolean, p boolean"), "t", "p").collect()[0]
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"], row["total"]) == (1.0, 1.0, 1.0, 1.0, 0)


def test_findings_and_scorecard(spark, tmp_path):
    from veriledger.plans import reports

    finding = reports.hub_finding(spark)
    row = finding.collect()[0]
    assert (row["firewall_verdict"], row["alternative_verdict"], row["shared_device_account_count"], row["max_multi_hop_velocity_hops"], row["is_false_negative"]) == ("SAFE", "FLAGGED", 0, 3, True)
    reports.write_findings(finding, str(tmp_path / "findings"))
    assert spark.read.json(str(tmp_path / "findings")).count() == 1
    summary = reports.fuzz_summary(reports.fuzz_cases(spark)).collect()[0]
    assert (summary["cases"], summary["known_gaps"], summary["gap_ids"]) == (9, 0, [])
    ring = L.ring_ledger(spark)
    assert '"tp": 3' in reports.scorecard(evaluation.topology_report(V.verdicts(ring), ring)[0])
