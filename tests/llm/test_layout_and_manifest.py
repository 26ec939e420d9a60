"""The clustered layout and the Merkle manifest against plain Python, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriledger.llm import clustered as C
from veriledger.llm import merkle as M
from veriledger.llm import ordering

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def table(n=700):
    rnd = random.Random(3)
    langs = ["en"] * 6 + ["de", "fr", None, "", "ü"]
    rows = [(i, rnd.choice(["a", "b", "B", "ß", None, "hot", "hot", "hot"]), rnd.choice(langs), rnd.choice([None, 5, 70]), rnd.choice([None, "", "x" * rnd.randrange(40), "é" * rnd.randrange(9)])) for i in range(n)]
    return [*rows, rows[5], rows[5], (None, "a", "en", 1, "t"), (None, "a", "en", 1, "t"), (-4, None, None, None, None), (n + 1, "a", "en", 9, "long " * 100_000)]


@pytest.fixture(scope="module")
def docs(spark):
    clash = {c: F.lit(None).cast("string") for c in ("z", "file", "position", "length", "date", "pos", "grp", "digest", "bucket", "left", "root", "_m", "key", "c_lang")}
    return spark.createDataFrame(table(), SCHEMA).withColumns(clash).repartition(7).cache()


def test_places_in_an_order(spark):
    rows = spark.range(0, 5000, numPartitions=9).select((F.col("id") % 7).alias("g"), (F.col("id") * 7919 % 1000).alias("v"), F.lit(2).alias("w"))
    got = collections.defaultdict(list)
    for r in ordering.positions(rows, F.col("v"), by=("g",)).collect():
        got[r["g"]].append((r["pos"], r["v"]))
    for own in got.values():
        own.sort()
        assert [p for p, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)
    summed = sorted((r["before"], r["v"]) for r in ordering.running(rows, "w", F.col("v")).collect())
    assert [b for b, _ in summed] == [2 * i for i in range(5000)] and [v for _, v in summed] == sorted(v for _, v in summed)
    same = ordering.positions(spark.range(3000).select(F.lit(1).alias("v")), F.col("v"))
    assert sorted(r["pos"] for r in same.collect()) == list(range(3000))


def test_dominance_tree():
    rnd = np.random.default_rng(5)
    for m, dims in ((1, 2), (40, 8), (500, 8), (300, 4)):
        points, corners = rnd.integers(-7, 8, (m, dims)), rnd.integers(-7, 8, (60, dims))
        weights = rnd.integers(1, 9, m)
        below = (points[None] <= corners[:, None]).all(2)
        tree = C.DominanceTree(points, weights)
        assert tree.sums(corners).tolist() == (below @ weights).tolist()
        assert set(zip(*(x.tolist() for x in tree.members(corners)), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(below)), strict=True))


def brute_layout(rows, file_rows):
    n = len(rows)
    low = lambda v: (v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0)
    values = [(low(s), low(g), low(len(t.encode()) if t is not None else -1), low(None if d is None else zlib.crc32(str(d).encode()) % 365)) for d, s, g, _, t in rows]
    coords = [[8 * sum(o[i] < v[i] for o in values) // n for i in range(4)] for v in values]
    zs = [sum((c[i] >> bit & 1) << (4 * bit + 3 - at) for bit in range(3) for at, i in enumerate((3, 2, 1, 0))) for c in coords]
    order = sorted(range(n), key=lambda i: (zs[i], low(rows[i][0])))
    file = {i: p // file_rows for p, i in enumerate(order)}
    bounds = {f: [g(coords[i][k] for i in own) for k in range(4) for g in (min, max)] for f in set(file.values()) for own in [[i for i in file if file[i] == f]]}
    out = []
    for p, i in enumerate(order):
        c, near = coords[i], (0, 0, 1, 1)
        touched = sum(all(b[2 * k] <= c[k] + near[k] and b[2 * k + 1] >= c[k] - near[k] for k in range(4)) for b in bounds.values())
        matching = len({file[j] for j in range(n) if all(abs(coords[j][k] - c[k]) <= near[k] for k in range(4))})
        out.append((rows[i][0], zs[i], p, file[i], touched, matching, ",".join(map(str, bounds[file[i]]))))
    return out


@pytest.mark.parametrize("file_rows", [5, 100])
def test_layout(docs, file_rows):
    got = [tuple(r) for r in C.clustered(docs, file_rows=file_rows).collect()]
    want = brute_layout(table(), file_rows)
    # rows of equal cell and key take their places in any order, which only changes which of them has which place
    key = lambda r: (r[2], r[1])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_layout_of_nothing_and_of_too_many_cells(spark):
    assert C.clustered(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        C.Curve(["a", "b", "c", "d"], 4)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(digests, fanout):
    """The root, and of each node the (before, after) siblings of each level."""
    row, place, proofs = list(digests), list(range(len(digests))), [[] for _ in digests]
    while len(row) > 1:
        runs = [row[i : i + fanout] for i in range(0, len(row), fanout)]
        for i, p in enumerate(place):
            run = runs[p // fanout]
            proofs[i].append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1 :])))
            place[i] = p // fanout
        row = [sha("".join(r)) for r in runs]
    return row[0], proofs


def brute_manifest(rows, fanout):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda r: sha("".join(field(r[i]) for i in (0, 1, 2, 3, 4)))
    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(by[g], key=lambda x: x[:3])], fanout) for g in order}
    root, tops = brute_tree([trees[g][0] for g in order], fanout)
    return [(x[1] if x[0] else None, x[2], trees[g][0], root, sha("".join(a + b for a, b in proof + tops[n]))) for n, g in enumerate(order) for x, proof in zip(sorted(by[g], key=lambda x: x[:3]), trees[g][1], strict=True)]


@pytest.mark.parametrize("fanout,levels", [(2, 7), (2, 2), (3, 1), (4, 3)])
def test_manifest(docs, fanout, levels):
    made = M.manifest(docs, fanout=fanout, levels=levels)
    got = made.select("doc_id", "leaf", "subroot", "root", M.siblings(F.col("left"), F.col("right")).alias("proof"), (M.fold(F.col("leaf"), F.col("left"), F.col("right")) == F.col("root")).alias("ok")).collect()
    assert all(r["ok"] for r in got)
    assert collections.Counter(tuple(r)[:5] for r in got) == collections.Counter(brute_manifest(table(), fanout))


def test_changed_rows_are_found(spark):
    rows = [r for r in table(60)[:60]]
    docs = spark.createDataFrame(rows, SCHEMA)
    proved = M.manifest(docs)
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 7, "other").when(F.col("doc_id") == 8, F.lit(None)).otherwise(F.col("text"))).union(spark.createDataFrame([(99, None, None, None, None)], SCHEMA))
    same = {r[0] for r in rows} - {7} - ({8} if rows[8][4] is not None else set())
    assert {r["doc_id"]: r["verified"] for r in M.verify(proved, changed).collect()} == {i: i in same for i in [*range(60), 99]}


def test_manifest_of_few_rows(spark):
    assert M.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    one = M.manifest(spark.createDataFrame([(1, "s", None, 2, "ab")], SCHEMA)).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] == sha("1:11:s-1:22:ab") and one["left"] == one["right"] == []
