"""Verdict counts of many settings from one count by ranks, against deciding for each setting."""

from __future__ import annotations

import itertools
import random

import pytest

from veriledger.errors import ThresholdError
from veriledger.operators import verdicts as V

FIELDS = "setting string, min_clustering_coefficient double, min_shared_device_neighbors int, min_velocity_hops int, max_hop_interval_seconds double"
SIGNALS = "account_id int, local_clustering_coefficient double, shared_device_account_count long, max_multi_hop_velocity_hops int, min_hop_interval_seconds double"


@pytest.fixture(scope="module")
def measured(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0.0, 0.2, 0.5, 1.0]), rnd.randrange(4), rnd.randrange(6), rnd.choice([None, 0.0, 60.0, 90.5, 4000.0])) for i in range(300)]
    return rows, spark.createDataFrame(rows, SIGNALS).repartition(3)


@pytest.mark.parametrize("most_cells", [1 << 20, 10])
def test_counts_equal_deciding(spark, measured, monkeypatch, most_cells):
    monkeypatch.setattr(V, "MOST_CELLS", most_cells)
    rows, frame = measured
    grid = [(f"{c}-{d}-{h}-{i}", c, d, h, i) for c, d, h, i in itertools.product((0.0, 0.2, 0.3, 1.0), (0, 1, 3), (0, 2, 9), (0.0, 60.0, 90.4, 90.5, 1e6))] + [("again", 0.2, 1, 2, 60.0)]
    assert len(grid) > 180
    want = {}
    for name, c, d, h, i in grid:
        for _, a, b, e, g in rows:
            verdict = "FLAGGED" if b >= d and (a >= c or e >= h or (g is not None and g <= i)) else "SAFE"
            want[name, verdict] = want.get((name, verdict), 0) + 1
    assert {(r["setting"], r["verdict"]): r["n"] for r in V.sweep_table(frame, spark.createDataFrame(grid, FIELDS)).collect()} == want


def test_settings_out_of_range_and_none(spark, measured):
    for bad in ((2.0, 1, 1, 1.0), (0.5, -1, 1, 1.0), (None, 1, 1, 1.0)):
        with pytest.raises(ThresholdError):
            V.sweep_table(measured[1], spark.createDataFrame([("x", *bad)], FIELDS))
    assert V.sweep_table(measured[1].limit(0), spark.createDataFrame([("x", 0.5, 1, 1, 1.0)], FIELDS)).collect() == []


def test_more_settings_than_fit_the_driver(spark, measured):
    rows, frame = measured
    n = 120_000
    settings = spark.range(n).selectExpr("id AS setting", "(id % 5) * 0.1D AS min_clustering_coefficient", "id % 4 AS min_shared_device_neighbors", "1 + id % 6 AS min_velocity_hops", "30.0D * (id % 7) AS max_hop_interval_seconds")
    got = {(r["setting"], r["verdict"]): r["n"] for r in V.sweep_table(frame, settings).collect()}
    totals = {}
    for (setting, _), k in got.items():
        totals[setting] = totals.get(setting, 0) + k
    assert len(totals) == n and set(totals.values()) == {len(rows)}
    for i in (0, 17, 99_999, n - 1):
        c, d, h, g = (i % 5) * 0.1, i % 4, 1 + i % 6, 30.0 * (i % 7)
        want = sum(b >= d and (a >= c or e >= h or (w is not None and w <= g)) for _, a, b, e, w in rows)
        assert got.get((i, "FLAGGED"), 0) == want


def test_many_thresholds_on_one_axis_and_settings_of_one_name(spark, measured):
    rows, frame = measured
    many = [(f"s{i % 4000}", 0.5, 1, 9, i / 2) for i in range(5000)]
    want = {}
    for name, c, d, h, i in many:
        for _, a, b, e, g in rows:
            verdict = "FLAGGED" if b >= d and (a >= c or e >= h or (g is not None and g <= i)) else "SAFE"
            want[name, verdict] = want.get((name, verdict), 0) + 1
    assert {(r["setting"], r["verdict"]): r["n"] for r in V.sweep_table(frame, spark.createDataFrame(many, FIELDS)).collect()} == want
    assert V.sweep_table(frame, spark.createDataFrame([], FIELDS)).collect() == []
