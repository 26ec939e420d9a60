"""A layout of rows in files along a Z-order curve of several columns, and what queries on it have to read.

Each column is cut into 2 ** DIGITS coordinates of equal shares of the rows; the coordinates' digits interleave to a cell number, rows are ordered by cell and key, and
file_rows consecutive ones are a file. How many files a query touches is counted with KD-trees over the corner points of files: a file with bounds [low, high] meets a
box if low <= the box's high end and -high <= minus its low end in every column, which is dominance in a space of twice as many dimensions, so the tree answers with the
counts of whole subtrees. A tree of the same kind over the cells lists the cells of a box, whose files are intervals.

How it scales: the curve has at most MOST_CELLS cells. A file lies in one cell or holds a border between two, so files have fewer than 2 * MOST_CELLS different bounds, however
many files there are; they are counted by bounds first, dealt into DEALT trees, and each tree answers for all cells of the curve. Only tables of at most MOST_CELLS rows are broadcast, and only
the cuts (at most 2 ** DIGITS values a column) come to the driver. Rows are numbered by ranges, and bounds of a file are a window over its file_rows rows.

Defined results: nulls are the smallest values of a column and null texts have length -1; a null doc_id has a null date, the smallest; strings compare by their bytes; equal values have one coordinate, so a value
that most rows share leaves others unused; rows with equal cell and key take their places in any order; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriledger.llm.merkle import CRC
from veriledger.llm.ordering import positions, running
from veriledger.llm.storage import materialise, scope

DIGITS, FILE_ROWS = 3, 2000
MOST_CELLS = 1 << 12
#: Trees over the bounds of files, and points in a leaf of a tree.
DEALT, LEAF = 16, 8


class DominanceTree:
    """A KD-tree over points with weights. For many corners at once: the weight of the points that are at most the corner in every dimension, or those points."""

    def __init__(self, points: np.ndarray, weights: np.ndarray):
        self.points, self.weights = points, weights
        self.order = np.arange(len(points))
        low, high, total, span, below = [], [], [], [], []
        waiting = [(0, len(points), -1, 0)]
        while waiting:
            a, b, parent, side = waiting.pop()
            own = points[self.order[a:b]]
            node = len(low)
            low.append(own.min(0))
            high.append(own.max(0))
            total.append(weights[self.order[a:b]].sum())
            span.append((a, b))
            below.append([-1, -1])
            if parent >= 0:
                below[parent][side] = node
            widest = int((high[-1] - low[-1]).argmax())
            if b - a > LEAF and high[-1][widest] > low[-1][widest]:
                self.order[a:b] = self.order[a:b][np.argsort(own[:, widest], kind="stable")]
                middle = (a + b) // 2
                waiting += [(a, middle, node, 0), (middle, b, node, 1)]
        self.low, self.high, self.total, self.span, self.below = np.array(low), np.array(high), np.array(total), np.array(span), np.array(below)

    def _walk(self, corners: np.ndarray):
        """Pairs (corner, node) of whole subtrees that are dominated, and pairs of leaves to look into, a level of the tree at a time."""
        corner, node = np.arange(len(corners)), np.zeros(len(corners), np.int64)
        while len(corner):
            near = (self.low[node] <= corners[corner]).all(1)
            corner, node = corner[near], node[near]
            whole = (self.high[node] <= corners[corner]).all(1)
            leaf = ~whole & (self.below[node, 0] < 0)
            yield corner[whole], node[whole], corner[leaf], node[leaf]
            onward = ~whole & ~leaf
            corner, node = np.repeat(corner[onward], 2), self.below[node[onward]].ravel()

    def _points_of(self, corner: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.span[node, 1] - self.span[node, 0]
        which = np.repeat(np.arange(len(node)), size)
        within = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        return corner[which], self.order[self.span[node, 0][which] + within]

    def sums(self, corners: np.ndarray) -> np.ndarray:
        out = np.zeros(len(corners), np.int64)
        for corner, node, partly, leaf in self._walk(corners):
            np.add.at(out, corner, self.total[node])
            c, p = self._points_of(partly, leaf)
            hit = (self.points[p] <= corners[c]).all(1)
            np.add.at(out, c[hit], self.weights[p[hit]])
        return out

    def members(self, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(corner, point) of all dominated points."""
        found = []
        for corner, node, partly, leaf in self._walk(corners):
            found.append(self._points_of(corner, node))
            c, p = self._points_of(partly, leaf)
            hit = (self.points[p] <= corners[c]).all(1)
            found.append((c[hit], p[hit]))
        return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


class Curve:
    """Cells of named columns, in the order in which each round of digits names them."""

    def __init__(self, names: list[str], digits: int):
        if 1 << (digits * len(names)) > MOST_CELLS:
            raise ValueError(f"{len(names)} columns of {digits} digits have more than {MOST_CELLS} cells")
        self.names, self.digits = names, digits

    def cell(self) -> Column:
        """The cell number of a row's coordinates."""
        bits = [F.shiftright(F.col(f"c_{n}"), d).bitwiseAND(1) for d in reversed(range(self.digits)) for n in self.names]
        return reduce(lambda acc, b: acc * 2 + b, bits, F.lit(0)).cast("long")

    def coordinates(self, cells: np.ndarray) -> dict[str, np.ndarray]:
        out = {n: np.zeros(len(cells), np.int64) for n in self.names}
        at = self.digits * len(self.names)
        for _ in range(self.digits):
            for n in self.names:
                at -= 1
                out[n] = out[n] * 2 + (cells >> at & 1)
        return out

    def boxes(self, cells: np.ndarray, reach: dict[str, int]) -> np.ndarray:
        """Corner points of each cell's query: its high ends, then its low ends with their sign changed."""
        c = self.coordinates(cells)
        return np.stack([c[n] + reach[n] for n in self.names] + [reach[n] - c[n] for n in self.names], 1)


def coordinates(rows: DataFrame, columns: list[str], digits: int) -> DataFrame:
    """rows with c_<column>: floor(2 ** digits * (number of rows with a smaller value) / (number of rows).

    Values are counted, their running sums taken by ranges, and of each coordinate only its smallest value comes back, as a literal that rows are compared with.
    """
    n, shares = rows.count(), 1 << digits
    if not n:
        return rows.withColumns({f"c_{c}": F.lit(0) for c in columns})
    text = {c: dict(rows.dtypes)[c] == "string" for c in columns}
    each = [F.struct(F.lit(i).alias("i"), (F.col(c) if text[c] else F.lit(None).cast("string")).alias("s"), (F.lit(None) if text[c] else F.col(c)).cast("long").alias("x")) for i, c in enumerate(columns)]
    counted = rows.select(F.explode(F.array(*each)).alias("v")).groupBy("v.i", "v.s", "v.x").agg(F.count("*").alias("n"))
    summed = running(counted, "n", F.col("i"), F.col("s").asc_nulls_first(), F.col("x").asc_nulls_first())
    share = F.expr(f"CAST(((before - i * {n}L) * {shares}L) DIV {n}L AS INT)")
    cuts = summed.withColumn("share", share).groupBy("i", "share").agg(F.min(F.struct("s", "x")).alias("v")).select("i", "share", "v.s", "v.x").collect()
    out = {}
    for i, c in enumerate(columns):
        value = F.lit(0)
        for cut in sorted((r for r in cuts if r["i"] == i and r["share"] > 0), key=lambda r: r["share"]):
            value = F.when(F.col(c) >= F.lit(cut["s"] if text[c] else cut["x"]), cut["share"]).otherwise(value)
        out[f"c_{c}"] = value.cast("int")
    return rows.withColumns(out)


def layout(rows: DataFrame, columns: list[str], interleave: list[str], *, key: str, digits: int = DIGITS, file_rows: int = FILE_ROWS) -> DataFrame:
    """rows (written) with c_<column>, z, position and file: the order of the curve, equal cells by key (null first)."""
    curve = Curve(interleave, digits)
    placed = positions(coordinates(rows, columns, digits).withColumn("z", curve.cell()), F.col("z"), F.col(key).asc_nulls_first())
    return materialise(placed.withColumnRenamed("pos", "position").withColumn("file", F.floor(F.col("position") / file_rows)))


def reads(laid: DataFrame, interleave: list[str], reach: dict[str, int], *, digits: int = DIGITS) -> DataFrame:
    """(z, files_touched, files_matching) of each cell with rows: what the query of the cell and reach cells around it, column by column, has to read.

    files_touched: files whose bounds meet the query; files_matching: files with a row in it.
    """
    curve = Curve(interleave, digits)
    low, high = [f"low_{n}" for n in interleave], [f"high_{n}" for n in interleave]
    files = laid.groupBy("file").agg(*[F.min(f"c_{n}").alias(a) for n, a in zip(interleave, low, strict=True)], *[F.max(f"c_{n}").alias(b) for n, b in zip(interleave, high, strict=True)])
    corners = files.groupBy(*low, *high).agg(F.count("*").alias("files")).withColumn("tree", F.pmod(F.xxhash64(*low, *high), F.lit(DEALT)))

    def touched(points: pd.DataFrame) -> pd.DataFrame:
        grid = np.arange(1 << (digits * len(interleave)))
        tree = DominanceTree(np.concatenate([points[low].to_numpy(np.int64), -points[high].to_numpy(np.int64)], 1), points["files"].to_numpy(np.int64))
        n = tree.sums(curve.boxes(grid, reach))
        return pd.DataFrame({"z": grid[n > 0], "files_touched": n[n > 0]})

    met = corners.groupBy("tree").applyInPandas(touched, "z long, files_touched long").groupBy("z").agg(F.sum("files_touched").alias("files_touched"))
    # queries keep the coordinates without reach, so cells that differ in one never meet
    exact = [f"c_{n}" for n in interleave if not reach[n]]
    cells = laid.groupBy("z", *exact).agg(F.min("file").alias("first"), F.max("file").alias("last"))

    def matching(own: pd.DataFrame) -> pd.DataFrame:
        at = own["z"].to_numpy(np.int64)
        spots = curve.coordinates(at)
        points = np.stack([*(spots[n] for n in interleave), *(-spots[n] for n in interleave)], 1)
        query, point = DominanceTree(points, np.ones(len(at), np.int64)).members(curve.boxes(at, reach))
        first, last = own["first"].to_numpy(np.int64)[point], own["last"].to_numpy(np.int64)[point]
        order = np.lexsort((at[point], query))
        query, first, last = query[order], first[order], last[order]
        # cells follow each other in files, so intervals of one query overlap at their ends at most
        before = np.where(np.append(False, query[1:] == query[:-1]), np.append(-1, last[:-1]), -1)
        return pd.DataFrame({"z": at, "files_matching": np.bincount(query, last - np.maximum(first, before + 1) + 1, len(at)).astype(np.int64)})

    found = cells.groupBy(*exact).applyInPandas(matching, "z long, files_matching long")
    return found.join(met.hint("merge"), "z")


def bounds(columns: list[str]) -> Column:
    """The smallest and largest coordinates of a row's file, column by column."""
    own = Window.partitionBy("file")
    return F.concat_ws(",", *[f(f"c_{c}").over(own).cast("string") for c in columns for f in (F.min, F.max)])


#: The columns, those of a round of digits from first to last, and how far a query reaches.
COLUMNS, ROUND = ["source", "lang", "length", "date"], ["date", "length", "lang", "source"]
REACH = {"source": 0, "lang": 0, "length": 1, "date": 1}


def clustered(docs: DataFrame, *, file_rows: int = FILE_ROWS, digits: int = DIGITS, reach: dict[str, int] | None = None) -> DataFrame:
    """Documents laid out by source, language, length and date: doc_id, z, position, file, files_touched, files_matching, file_bounds."""
    rows = materialise(docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long").alias("length"),
        (F.crc32(F.col("doc_id").cast("string")) % 365).alias("date"),
    ))
    laid = layout(rows, COLUMNS, ROUND, key="doc_id", digits=digits, file_rows=file_rows)
    # one row a cell of the curve: at most MOST_CELLS
    answers = F.broadcast(reads(laid, ROUND, reach or REACH, digits=digits))
    return laid.withColumn("file_bounds", bounds(COLUMNS)).join(answers, "z").select("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds")


def op12_kd_clustered_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scope(spark) as kept:
        kept.append(materialise(clustered(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
    return kept[0]


_BITS = " + ".join(f"((c_{n} >> {d}) & 1) * {1 << (4 * d + 3 - i)}" for d in (2, 1, 0) for i, n in enumerate(ROUND))
_MEET = " AND ".join(f"f.low_{n} <= q.c_{n} + {REACH[n]} AND f.high_{n} >= q.c_{n} - {REACH[n]}" for n in COLUMNS)
_INSIDE = " AND ".join(f"r.c_{n} BETWEEN q.c_{n} - {REACH[n]} AND q.c_{n} + {REACH[n]}" for n in COLUMNS)
SQL = {
    "op12_kd_clustered_layout": f"""WITH d AS (SELECT doc_id, source, lang, coalesce(strlen(text), -1) AS length, xor({CRC.format("doc_id")}, 4294967295) % 365 AS date FROM documents),
c AS (SELECT doc_id, {", ".join(f"8 * (rank() OVER (ORDER BY {n} NULLS FIRST) - 1) // count(*) OVER () AS c_{n}" for n in COLUMNS)} FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY z, doc_id) - 1 AS position FROM (SELECT *, {_BITS} AS z FROM c)),
r AS (SELECT *, position // 2000 AS file FROM p),
f AS (SELECT file, {", ".join(f"min(c_{n}) AS low_{n}, max(c_{n}) AS high_{n}" for n in COLUMNS)} FROM r GROUP BY file),
q AS (SELECT DISTINCT z, {", ".join(f"c_{n}" for n in COLUMNS)} FROM r),
a AS (SELECT z, count(*) AS files_touched FROM q JOIN f ON {_MEET} GROUP BY z),
m AS (SELECT q.z, count(DISTINCT r.file) AS files_matching FROM q JOIN r ON {_INSIDE} GROUP BY q.z)
SELECT doc_id, CAST(z AS BIGINT) AS z, CAST(position AS BIGINT) AS position, CAST(file AS BIGINT) AS file, CAST(files_touched AS BIGINT) AS files_touched, CAST(files_matching AS BIGINT) AS files_matching,
  concat_ws(',', {", ".join(f"low_{n}, high_{n}" for n in COLUMNS)}) AS file_bounds FROM r JOIN f USING (file) JOIN a USING (z) JOIN m USING (z)"""
}
QUERIES = {"op12_kd_clustered_layout": op12_kd_clustered_layout}
