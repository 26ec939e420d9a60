"""Exact search through cells: the rows of brute force, with fewer pairs scored."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veriledger.operators import cells as C
from veriledger.operators import retrieval

DIMS = 24


def vectors(n, groups, seed, noise=0.15):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(groups, DIMS))
    return centres[rnd.integers(0, groups, n)] + noise * rnd.normal(size=(n, DIMS))


def frame(spark, matrix, name, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(matrix)], f"{name} long, vector array<double>")


def brute(q, r, k, digits):
    s = np.round(C.unit(q) @ C.unit(r).T, digits) + 0.0
    order = np.lexsort((np.broadcast_to(np.arange(len(r)), s.shape), -s), axis=1)[:, :k]
    return {(i, int(j), n + 1): s[i, j] for i, row in enumerate(order) for n, j in enumerate(row)}


@pytest.fixture(scope="module")
def rows():
    r = vectors(1500, 25, 1)
    r[200:260] = r[200]  # a common vector
    r[7] = r[8] = 0
    return r


@pytest.mark.parametrize("options", [{}, {"large_block": 40}])
def test_search_equals_brute_force(spark, rows, options):
    q = np.concatenate([vectors(60, 25, 1), rows[198:203], np.zeros((1, DIMS)), -rows[:2]])
    made = C.build(frame(spark, rows, "row_id").repartition(5), n_cells=30)
    for k in (1, 3, 80):
        got = {(r["query_id"], r["row_id"], r["rank"]): r["score"] for r in C.search(frame(spark, q, "query_id"), made, k, digits=6, **options).collect()}
        want = brute(q, rows, k, 6)
        assert got.keys() == want.keys() and max(abs(got[x] - want[x]) for x in got) < 1e-9, k


def test_fewer_than_half_of_the_pairs_are_scored(spark, rows):
    made = C.build(frame(spark, rows, "row_id"), n_cells=30)
    scored, every = C.pairs_scored(frame(spark, vectors(100, 25, 1), "query_id"), made, 3, digits=6)
    assert every == 100 * 1498 and 0 < scored < every / 2


def test_cells_without_structure_still_give_all(spark):
    r = np.random.default_rng(3).normal(size=(400, DIMS))
    got = {(x["query_id"], x["row_id"], x["rank"]) for x in C.search(frame(spark, r[:30], "query_id"), C.build(frame(spark, r, "row_id")), 4, digits=6).collect()}
    assert got == brute(r[:30], r, 4, 6).keys()


def test_few_rows_nulls_and_repeated_ids(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 1.0]), (4, [1.0, 1.0])], "row_id long, vector array<double>")
    queries = spark.createDataFrame([("a", [2.0, 0.0]), ("b", None), ("c", [0.0, 0.0])], "query_id string, vector array<double>")
    got = sorted((r["query_id"], r["rank"], r["row_id"], round(r["score"], 6)) for r in retrieval.nearest(queries, rows, 9, most_sent=0).collect())
    half = round(0.5**0.5, 6)
    assert got == [("a", 1, 1, 1.0), ("a", 2, 4, half), ("a", 3, 4, half), ("a", 4, 3, 0.0), ("c", 1, 1, 0.0), ("c", 2, 3, 0.0), ("c", 3, 4, 0.0), ("c", 4, 4, 0.0)]
    assert retrieval.nearest(queries.limit(0), rows, 2, most_sent=0).count() == 0 and retrieval.nearest(queries, rows.where("row_id > 9"), 2, most_sent=0).count() == 0
    only_zeros = retrieval.nearest(queries, rows.where(F.col("row_id") == 3), 2, most_sent=0).collect()
    assert sorted((r["query_id"], r["row_id"]) for r in only_zeros) == [("a", 3), ("c", 3)]


def test_queries_come_once_to_a_shelf(spark, rows, monkeypatch):
    """Shelves of few rows, a cell larger than a shelf, queries in several blocks; every query may visit every cell, but is sent to shelves only."""
    monkeypatch.setattr(C, "SHELF", 50)
    monkeypatch.setattr(C, "LEAST_SHELF", 10)
    monkeypatch.setattr(C, "MOST_HELD", 500)
    rnd = np.random.default_rng(5)
    r = np.concatenate([rnd.normal(size=(400, DIMS)), np.repeat(rnd.normal(size=(1, DIMS)), 130, 0)])
    q = np.concatenate([r[:70], r[-1:]])
    made = C.build(frame(spark, r, "row_id").repartition(3), n_cells=25)
    placed, block = C._plan(made, len(q), 1)
    assert block == 50 and placed.parts.max() > 1
    for c in np.flatnonzero(placed.parts == 1):
        assert made.size[placed.first == placed.first[c]].sum() <= 50
    asked = C.units(frame(spark, q, "query_id"), "query_id").withColumn("floor", F.lit(-1.0))
    sent = C.visits(asked, made, placed, 3, 6)
    assert sent.count() == sent.select("query_id", "shelf").distinct().count() == len(q) * placed.n and placed.n < len(made.size)
    got = {(x["query_id"], x["row_id"], x["rank"]) for x in C.search(frame(spark, q, "query_id"), made, 3, digits=6, large_block=20).collect()}
    assert got == brute(q, r, 3, 6).keys()


def test_queries_pass_a_shelf_in_batches():
    """a task holds the rows of its shelf and one batch of queries; a block of 40,000 queries is answered batch by batch and does not come to Python as a whole."""
    rnd = np.random.default_rng(9)
    r, q = C.unit(rnd.normal(size=(500, DIMS))), C.unit(rnd.normal(size=(1000, DIMS)))
    cell = np.arange(500) // 125
    centres = C.unit([r[cell == c].sum(0) for c in range(4)])
    angle = np.arccos((r * centres[cell]).sum(1))
    order, first = np.lexsort((angle, cell)), [None, [0, 1, 2, 3, 9]]

    def batch(n, **columns):
        kinds = {"query_id": pa.string(), "row_id": pa.int64(), "vector": pa.list_(pa.float64()), "floor": pa.float64(), "first": pa.list_(pa.int64()), "cell": pa.int64(), "angle": pa.float64()}
        fixed = {"shelf": pa.array([0] * n, pa.int32()), "qb": pa.array([0] * n, pa.int32()), "asks": pa.array(["query_id" in columns] * n)}
        return pa.RecordBatch.from_pydict(fixed | {c: pa.array(columns.get(c, [None] * n), t) for c, t in kinds.items()})

    taken = 0

    def batches():
        nonlocal taken
        yield batch(500, row_id=order, vector=list(r[order]), cell=cell[order], angle=angle[order])
        asked = batch(1000, query_id=[f"q{i}" for i in range(1000)], vector=list(q), floor=[None if i % 2 else -1.0 for i in range(1000)], first=[first[i % 2] for i in range(1000)])
        for taken in range(1, 41):
            yield asked

    want, most, n = brute(q, r, 3, 6).keys(), 0, 0
    tracemalloc.start()
    for i, out in enumerate(C._met(batches(), centres, 3, 6, 20_000)):
        assert taken == i + 1
        n += out.num_rows
        if i in (0, 39):
            places = np.tile(np.arange(1, 4), 1000)
            assert {(int(a[1:]), b, int(p)) for a, b, p in zip(*(out.column(c).to_pylist() for c in ("query_id", "row_id")), places, strict=True)} == want
        most = max(most, tracemalloc.get_traced_memory()[1])
        if i == 0:
            after_one = most
    tracemalloc.stop()
    assert n == 40 * 3000 and most < 1.2 * after_one + 2e6


def test_scores_of_close_rows_are_not_decided_in_single_precision(spark):
    """Rows whose cosines differ by less than single precision can tell keep the order of double precision."""
    rnd = np.random.default_rng(11)
    base, side = rnd.normal(size=(2, DIMS))
    r = np.array([base + (((i * 37) % 300) + 1) * 1e-5 * side for i in range(300)])
    q = np.concatenate([base[None], r[:9], rnd.normal(size=(5, DIMS))])
    got = {(x["query_id"], x["row_id"], x["rank"]) for x in C.search(frame(spark, q, "query_id"), C.build(frame(spark, r, "row_id"), n_cells=6), 4, digits=12).collect()}
    assert got == brute(q, r, 4, 12).keys()
