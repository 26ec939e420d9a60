"""Exact nearest rows by cosine through cells: a coarse partition of the vectors that lets whole cells, and rows of those that stay, go unscored.

Cells come from spherical k-means, each round of which runs over all rows: tasks add up the vectors of each cell, and only cells x dimensions numbers (bounded by MOST_NUMBERS)
come to the driver. Every row keeps its cell and its angle to the cell's centre; of every cell its size and its smallest and largest angle are known.

A search first scores each query against the nearest cells that together hold k rows. The k-th score found is a floor: by the triangle inequality of angles a row at angle a from its centre
has at most the cosine of |angle(query, centre) - a| with the query, so cells, and rows within a cell, whose bound is under the floor cannot matter. The others are scored in a second pass.
The result is that of scoring all pairs; what is saved depends on how far the vectors cluster. Vectors without any structure in many dimensions have no cell far enough from any query.

Cells that lie near each other share a shelf of bounded size, cells with more rows than that take several. A query is sent once to each shelf with a cell that it visits, not once to
each cell, and meets its cells there; queries are dealt in blocks of bounded size too, which pass the shelf in batches. So a task holds one shelf and one batch of queries at a time, however
many cells and queries there are.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriledger.storage import materialise

#: Numbers (cells x dimensions) of the centres, which all tasks get, and cells at most.
MOST_NUMBERS, MOST_CELLS = 2_000_000, 4096
ROUNDS = 6
#: Rows or queries of one comparison (large_block may be less), and rows of a shelf or queries of a block: at most SHELF, and as many as have SHELF_NUMBERS numbers.
LARGE_BLOCK, BLOCK = 20_000, 1024
SHELF, LEAST_SHELF, SHELF_NUMBERS = 65_536, 1000, 1 << 22
#: Numbers of an intermediate array, or of a batch that a task gives.
MOST_HELD = 1 << 20
#: Pairs of a shelf and a block of queries for each core, if there are rows enough; tasks at most.
TASKS_A_CORE, MOST_PARTITIONS = 4, 2000
#: What rounding may add to a score or to a bound.
SLACK = 1e-7


def unit(vectors) -> np.ndarray:
    matrix = np.array([np.asarray(v, np.float64) for v in vectors])
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm > 0, norm, 1)


def units(df: DataFrame, id_column: str) -> DataFrame:
    """(id, vector at unit length) of the rows with a vector, written."""
    kind = df.schema[id_column].dataType.simpleString()

    def normal(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(vector=list(unit(pdf["vector"])))

    known = df.where("vector IS NOT NULL").select(id_column, F.col("vector").cast("array<double>").alias("vector"))
    return materialise(known.mapInPandas(normal, f"{id_column} {kind}, vector array<double>"))


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


@dataclasses.dataclass(frozen=True)
class Cells:
    """rows: row_id, vector (of unit length), cell, angle; written. Arrays have one entry a cell. Rows without direction (zero vectors) are apart: their cosine is 0 with everything."""

    rows: DataFrame
    centres: np.ndarray
    size: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    zeros: DataFrame
    n_zeros: int

    def bounds(self, to_centre: np.ndarray) -> np.ndarray:
        """The highest cosine that a row of each cell can have with each query, from the queries' angles to the centres."""
        gap = np.maximum(np.maximum(to_centre - self.farthest, self.nearest - to_centre), 0)
        return np.cos(gap)


def _spread(sample: np.ndarray, n: int) -> np.ndarray:
    """n of the sample that lie far from each other: each next one is the farthest from those taken."""
    taken, best = [0], sample @ sample[0]
    while len(taken) < n:
        taken.append(int(best.argmin()))
        best = np.maximum(best, sample @ sample[taken[-1]])
    return sample[taken]


def _assign(matrix: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell, cosine = np.zeros(len(matrix), np.int64), np.zeros(len(matrix))
    for own in _parts(len(matrix), len(centres)):
        cosines = matrix[own] @ centres.T
        cell[own] = cosines.argmax(1)
        cosine[own] = cosines.max(1)
    return cell, cosine


def _parts(n: int, width: int) -> list[slice]:
    """Slices of n rows, each of at most MOST_HELD numbers if rows have width of them."""
    step = max(1, MOST_HELD // max(1, width))
    return [slice(a, a + step) for a in range(0, n, step)]


def build(rows: DataFrame, *, n_cells: int | None = None, rounds: int = ROUNDS) -> Cells:
    """Cells of rows (row_id long, vector; null vectors are left out). Centres start from at most four rows a cell, the smallest by a hash of row_id; every round and the cells themselves take all rows."""
    spark = rows.sparkSession
    pair = "row_id long, vector array<double>"

    every = units(rows.withColumn("row_id", F.col("row_id").cast("long")), "row_id")
    is_zero = ~F.exists("vector", lambda x: x != 0)
    zeros, pointed = every.where(is_zero), every.where(~is_zero)
    shape = pointed.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).collect()[0]
    n_zeros = zeros.count()
    if not shape["n"]:
        none = np.zeros(0)
        return Cells(pointed.withColumns({"cell": F.lit(0), "angle": F.lit(0.0)}), np.zeros((0, 1)), none, none, none, zeros, n_zeros)
    n_cells = n_cells or round(math.sqrt(shape["n"]))
    n_cells = max(1, min(n_cells, MOST_CELLS, MOST_NUMBERS // shape["dims"], shape["n"]))
    sample = np.array([r["vector"] for r in pointed.orderBy(F.xxhash64("row_id"), "row_id").limit(4 * n_cells).collect()])
    centres = _spread(sample, n_cells)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centres)

        def sums(batches):
            now = sent.value
            total, count = np.zeros_like(now), np.zeros(len(now), np.int64)
            for pdf in batches:
                matrix = np.stack(pdf["vector"].to_numpy())
                cell, _ = _assign(matrix, now)
                np.add.at(total, cell, matrix)
                count += np.bincount(cell, minlength=len(now))
            met = np.flatnonzero(count)
            if len(met):
                yield pd.DataFrame({"cell": met, "n": count[met], "total": list(total[met])})

        def add(parts: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"cell": parts["cell"].iloc[:1], "n": [parts["n"].sum()], "total": [np.sum(np.stack(parts["total"].to_numpy()), axis=0)]})

        found = pointed.mapInPandas(sums, "cell long, n long, total array<double>").groupBy("cell").applyInPandas(add, "cell long, n long, total array<double>").collect()
        before, centres = centres, centres.copy()
        for r in found:
            centre = np.array(r["total"])
            if (norm := np.linalg.norm(centre)) > 0:
                centres[r["cell"]] = centre / norm
        if np.abs(centres - before).max() < 1e-6:
            break
    sent = spark.sparkContext.broadcast(centres)

    def place(batches):
        for pdf in batches:
            cell, cosine = _assign(np.stack(pdf["vector"].to_numpy()), sent.value)
            yield pdf.assign(cell=cell, angle=_angles(cosine))

    placed = materialise(pointed.mapInPandas(place, pair + ", cell long, angle double"))
    size, low, high = np.zeros(n_cells, np.int64), np.full(n_cells, np.pi), np.zeros(n_cells)
    for r in placed.groupBy("cell").agg(F.count("*"), F.min("angle"), F.max("angle")).collect():
        size[r[0]], low[r[0]], high[r[0]] = r[1:]
    return Cells(placed, centres, size, low, high, zeros, n_zeros)


def _first_cells(cells: Cells, to_centre: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the nearest cells that hold k rows together (all cells, if there are not so many rows)."""
    order = np.argsort(to_centre + np.where(cells.size > 0, 0, 10), axis=1, kind="stable")
    enough = np.cumsum(cells.size[order], axis=1) >= k
    last = np.where(enough.any(1), enough.argmax(1), len(cells.size) - 1)
    return [o[: n + 1] for o, n in zip(order, last, strict=True)]


@dataclasses.dataclass(frozen=True)
class Shelves:
    """Of each cell its first shelf and on how many it lies (more than one for a large cell, which has them alone)."""

    first: np.ndarray
    parts: np.ndarray
    n: int


def shelves(cells: Cells, most: int) -> Shelves:
    """Cells are halved across their widest direction until a shelf has at most `most` rows."""
    first, parts, n = np.zeros(len(cells.size), np.int64), np.maximum(1, -(-cells.size // most)), 0
    waiting = [np.array([c]) for c in np.flatnonzero(parts > 1)] + [np.flatnonzero(parts == 1)]
    while waiting:
        own = waiting.pop()
        if len(own) > 1 and cells.size[own].sum() > most:
            spread = cells.centres[own] - cells.centres[own].mean(0)
            own = own[np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable")]
            filled = np.cumsum(cells.size[own])
            at = min(max(int(np.searchsorted(filled, filled[-1] / 2)), 1), len(own) - 1)
            waiting += [own[:at], own[at:]]
        elif len(own):
            first[own] = n
            n += int(parts[own[0]])
    return Shelves(first, parts, n)


def _chosen(cells: Cells, matrix: np.ndarray, floor: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Which cells each query visits: without a floor (nan) the nearest with k rows, else those whose bound reaches it."""
    to_centre = _angles(matrix @ cells.centres.T)
    chosen = (cells.bounds(to_centre) + slack >= floor[:, None]) & (cells.size > 0)
    new = np.flatnonzero(np.isnan(floor))
    for i, own in zip(new, _first_cells(cells, to_centre[new], k), strict=True):
        chosen[i, own] = True
    return chosen


def _slack(digits: int | None) -> float:
    return SLACK + (0.5 * 10**-digits if digits is not None else 0)


def _each_chosen(queries: DataFrame, cells: Cells, k: int, digits: int | None, give, schema: str) -> DataFrame:
    """give(part of the queries, which cells they visit), for parts of bounded size."""
    sent, slack = queries.sparkSession.sparkContext.broadcast((cells.centres, cells.size, cells.nearest, cells.farthest)), _slack(digits)

    def run(batches):
        own = Cells(None, *sent.value, None, 0)
        for pdf in batches:
            for at in _parts(len(pdf), max(own.centres.shape)):
                part = pdf.iloc[at]
                yield from give(part, _chosen(own, np.stack(part["vector"].to_numpy()), part["floor"].to_numpy(np.float64), k, slack))

    return queries.select("query_id", "vector", "floor").mapInPandas(run, schema)


def visits(queries: DataFrame, cells: Cells, placed: Shelves, k: int, digits: int | None = None) -> DataFrame:
    """(query_id, vector, floor, first, shelf): the shelves that each query has to visit. queries: query_id, vector, and floor (null at first; then the k-th score found).

    Without a floor, first has the nearest cells with k rows, the only ones to visit; with one, all cells whose bound reaches it are visited.
    """
    order = np.argsort(placed.first, kind="stable")
    at_shelf, starts = np.unique(placed.first[order], return_index=True)
    parts = placed.parts[order][starts]

    def give(part, chosen):
        i, g = np.nonzero(np.logical_or.reduceat(chosen[:, order], starts, axis=1))
        within = np.concatenate([np.zeros(0, np.int64), *[np.arange(n) for n in parts[g]]])
        i, shelf = np.repeat(i, parts[g]), np.repeat(at_shelf[g], parts[g]) + within
        new = np.isnan(part["floor"].to_numpy(np.float64))
        part = part.assign(first=[np.flatnonzero(c) if n else None for c, n in zip(chosen, new, strict=True)])
        for at in _parts(len(i), len(part["vector"].iloc[0])):
            yield part.iloc[i[at]].assign(shelf=shelf[at].astype(np.int32))

    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vector array<double>, floor double, first array<long>, shelf int"
    return _each_chosen(queries, cells, k, digits, give, schema)


class _Best:
    """Of each query its k best rows so far, best first, ties to the smaller id.

    Pairs are compared in single precision first, which is off by at most `off` for vectors of unit length; those that may count are scored in double precision.
    """

    def __init__(self, matrix: np.ndarray, floor: np.ndarray, k: int, digits: int | None):
        self.matrix, self.single, self.floor, self.k, self.digits = matrix, matrix.astype(np.float32), np.nan_to_num(floor, nan=-np.inf), k, digits
        self.slack, self.off = _slack(digits), (matrix.shape[1] + 8) * 2.0**-23
        self.score, self.id = np.full((len(matrix), k), -np.inf), np.full((len(matrix), k), np.iinfo(np.int64).max)

    def meet(self, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, single: np.ndarray) -> None:
        k = self.k
        s = self.single[queries] @ single.T
        limit = np.maximum(self.score[queries, k - 1], self.floor[queries])
        if len(ids) > k and (new := np.flatnonzero(limit == -np.inf)).size:
            limit[new] = np.partition(s[new], len(ids) - k, axis=1)[:, len(ids) - k] - self.off
        at, col = np.divmod(np.flatnonzero(s >= (limit - 2 * self.slack - self.off).astype(np.float32)[:, None]), len(ids))
        i, q, v = ids[col], queries[at], np.zeros(len(at))
        for own in _parts(len(at), 2 * rows.shape[1]):
            v[own] = np.einsum("ij,ij->i", self.matrix[q[own]], rows[col[own]])
        v = np.round(v, self.digits) + 0.0 if self.digits is not None else v
        last, last_id = self.score[q, k - 1], self.id[q, k - 1]
        better = ((v > last) | (v == last) & (i < last_id)) & (v >= self.floor[q] - SLACK)
        if not better.any():
            return
        v, i, q = v[better], i[better], q[better]
        own = np.unique(q)
        v, i, q = np.concatenate([self.score[own].ravel(), v]), np.concatenate([self.id[own].ravel(), i]), np.concatenate([np.repeat(own, k), q])
        order = np.lexsort((i, -v, q))
        v, i, q = v[order], i[order], q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < k
        self.score[q[kept], place[kept]], self.id[q[kept], place[kept]] = v[kept], i[kept]


def _numbers(vectors: pa.Array, dims: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class _Shelf:
    """The rows of one shelf, by cell and angle."""

    def __init__(self, parts: list[pa.RecordBatch], dims: int):
        column = lambda n: np.concatenate([p.column(n).to_numpy(zero_copy_only=False) for p in parts])
        self.ids, self.angles, cell = column("row_id"), column("angle"), column("cell")
        self.rows = np.concatenate([_numbers(p.column("vector"), dims) for p in parts])
        self.single = self.rows.astype(np.float32)
        self.cells, begins = np.unique(cell, return_index=True)
        self.spans = list(zip(begins, np.append(begins[1:], len(cell)), strict=True))

    def best(self, part: pa.RecordBatch, centres: np.ndarray, k: int, digits: int | None, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, ids, scores) of the k best of each query of a part among the rows that it has to visit."""
        matrix, floor = _numbers(part.column("vector"), centres.shape[1]), part.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
        best, reach = _Best(matrix, floor, k, digits), _angles(np.nan_to_num(floor, nan=-1.0) - _slack(digits)) + SLACK
        first = part.column("first")
        asked = np.repeat(first.is_null().to_numpy(zero_copy_only=False)[:, None], len(self.cells), axis=1)
        listed, of = first.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(part)), first.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        place = np.minimum(np.searchsorted(self.cells, listed), len(self.cells) - 1)
        here = self.cells[place] == listed
        asked[of[here], place[here]] = True
        for c, (begin, end) in enumerate(self.spans):
            to_centre, own = _angles(matrix @ centres[self.cells[c]]), self.angles[begin:end]
            low, high = np.searchsorted(own, to_centre - reach, "left"), np.searchsorted(own, to_centre + reach, "right")
            asks = np.flatnonzero((low < high) & asked[:, c])
            if len(asks):
                for b in range(begin + int(low[asks].min()), begin + int(high[asks].max()), step):
                    piece = slice(b, min(b + step, end))
                    best.meet(asks, self.ids[piece], self.rows[piece], self.single[piece])
        at, place = np.nonzero(best.score > -np.inf)
        return at, best.id[at, place], best.score[at, place]


def _met(batches: Iterable[pa.RecordBatch], centres: np.ndarray, k: int, digits: int | None, large_block: int) -> Iterator[pa.RecordBatch]:
    """Batches hold, for each shelf and block of queries, first the rows of the shelf, then the queries. Only the rows are held; queries are answered as they come, step by step."""
    key, waiting, shelf, step = None, [], None, min(BLOCK, large_block)
    for batch in (b for b in batches if len(b)):
        marks = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("shelf", "qb", "asks")])
        begins = np.append(0, np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1)
        for begin, end in zip(begins, [*begins[1:], len(batch)], strict=True):
            if key != (key := tuple(marks[:2, begin])):
                waiting, shelf = [], None
            if not marks[2, begin]:
                waiting.append(batch.slice(begin, end - begin))
                continue
            if waiting:
                waiting, shelf = [], _Shelf(waiting, centres.shape[1])
            for a in range(begin, end if shelf else begin, step):
                part = batch.slice(a, min(step, end - a))
                at, ids, scores = shelf.best(part, centres, k, digits, step)
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(at)), pa.array(ids), pa.array(scores)], ["query_id", "row_id", "score"])


def score(visited: DataFrame, cells: Cells, placed: Shelves, query_blocks: np.ndarray, k: int, digits: int | None, large_block: int) -> DataFrame:
    """(query_id, row_id, score): at most k rows for each query and shelf that it visits. query_blocks: of each shelf, in how many blocks its queries come."""
    spark, kind = visited.sparkSession, visited.schema["query_id"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(cells.centres)
    # one row a cell, one row a shelf
    lies = F.broadcast(spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(placed.first)), "at_shelf": placed.first, "parts": placed.parts}), "cell long, at_shelf int, parts int"))
    blocks = F.broadcast(spark.createDataFrame(pd.DataFrame({"shelf": np.arange(placed.n), "query_blocks": query_blocks}), "shelf int, query_blocks int"))
    one = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = visited.join(blocks, "shelf").withColumn("qb", one("query_id", "query_blocks")).drop("query_blocks").withColumn("asks", F.lit(True))
    right = cells.rows.join(lies, "cell").withColumn("shelf", (F.col("at_shelf") + one("row_id", "parts"))).join(blocks.where("query_blocks > 0"), "shelf")
    right = right.select("row_id", "vector", "cell", "angle", "shelf", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"), F.lit(False).alias("asks"))
    n = int(min(max(query_blocks.sum(), 1), MOST_PARTITIONS))
    met = right.unionByName(left, allowMissingColumns=True).repartition(n, "shelf", "qb").sortWithinPartitions("shelf", "qb", "asks", "cell", "angle", "row_id")
    return met.mapInArrow(lambda batches: _met(batches, sent.value, k, digits, large_block), f"query_id {kind}, row_id long, score double")


def _plan(cells: Cells, n_queries: int, parallelism: int) -> tuple[Shelves, int]:
    """Shelves, and queries of a block: both of bounded size, and so many together that all cores have work."""
    most = max(1, min(SHELF, SHELF_NUMBERS // cells.centres.shape[1]))
    wanted = math.ceil(TASKS_A_CORE * parallelism / math.ceil(max(n_queries, 1) / most))
    return shelves(cells, min(most, max(LEAST_SHELF, math.ceil(int(cells.size.sum()) / wanted)))), most


def _first_scores(asked: DataFrame, cells: Cells, placed: Shelves, block: int, k: int, digits: int | None, large_block: int) -> DataFrame:
    """score() of the nearest cells with k rows, written."""
    visited = materialise(visits(asked.withColumn("floor", F.lit(None).cast("double")), cells, placed, k, digits))
    come = np.zeros(placed.n, np.int64)
    for r in visited.groupBy("shelf").count().collect():
        come[r[0]] = math.ceil(r[1] / block)
    return materialise(score(visited, cells, placed, come, k, digits, large_block))


def search(queries: DataFrame, cells: Cells, k: int, *, digits: int | None = None, large_block: int = LARGE_BLOCK) -> DataFrame:
    """(query_id, row_id, score, rank): the k rows with the highest cosine for each query (query_id, vector), ties to the smaller row_id. Null vectors have no rows."""
    every = units(queries, "query_id")
    is_zero = ~F.exists("vector", lambda x: x != 0)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    asked, lost = every.where(~is_zero), every.where(is_zero)
    # rows and queries without direction: their cosine is 0, so the k smallest ids are all that counts
    of_zero = lambda rows: F.broadcast(rows.select("row_id").orderBy("row_id").limit(k))
    parts = [lost.select("query_id").join(of_zero(cells.rows.select("row_id").union(cells.zeros.select("row_id"))), how="cross").withColumn("score", F.lit(0.0))]
    if cells.n_zeros:
        parts.append(asked.select("query_id").join(of_zero(cells.zeros), how="cross").withColumn("score", F.lit(0.0)))
    if len(cells.size):
        placed, block = _plan(cells, n_asked := asked.count(), queries.sparkSession.sparkContext.defaultParallelism)
        first = _first_scores(asked, cells, placed, block, k, digits, large_block)
        full = materialise(best(first).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor")))
        # queries with fewer than k rows in all have seen every cell; the others see those of the first visit again
        parts.append(first.join(full, "query_id", "left_anti"))
        again = visits(asked.join(full, "query_id"), cells, placed, k, digits)
        parts.append(score(again, cells, placed, np.full(placed.n, math.ceil(n_asked / block)), k, digits, large_block))
    out = parts[0].select("query_id", "row_id", "score")
    for part in parts[1:]:
        out = out.union(part.select("query_id", "row_id", "score"))
    return best(out)


def pairs_scored(queries: DataFrame, cells: Cells, k: int, *, digits: int | None = None) -> tuple[int, int]:
    """(pairs of cells' rows that search() may score, all pairs): a measure of what the cells are worth for these queries and rows."""
    asked, size = units(queries, "query_id"), cells.size
    placed, block = _plan(cells, asked.count(), queries.sparkSession.sparkContext.defaultParallelism)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    floors = _first_scores(asked, cells, placed, block, k, digits, LARGE_BLOCK).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))

    def pairs(part, chosen):
        yield pd.DataFrame({"n": (chosen * size).sum(1)})

    visiting = asked.withColumn("floor", F.lit(None).cast("double")).unionByName(asked.join(floors, "query_id"))
    n = _each_chosen(visiting, cells, k, digits, pairs, "n long").agg(F.sum("n")).collect()[0][0] or 0
    return n, asked.count() * int(size.sum())
