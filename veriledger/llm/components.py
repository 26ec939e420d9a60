"""Connected components of an edge table, by alternating large and small stars.

Every round is written to the shared folder, and the one before it removed. Nothing but a count and two sums of hashes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriledger.llm.storage import discard, materialise


def _digest(pairs: DataFrame) -> tuple:
    """Equal for equal sets of pairs."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))).collect()[0])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every endpoint of edges (u, v): the smallest id reachable. Null endpoints and loops are left out."""
    pairs = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    # edges always point from a larger to a smaller id: keep the smallest neighbour of each vertex (a star), hang the others on it
    pairs = materialise(pairs)
    known = _digest(pairs)
    while True:
        both = pairs.union(pairs.select(F.col("v"), F.col("u"))).toDF("u", "v")
        # large star: neighbours above u hang on the smallest of u and its neighbours
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct())
        # small star: neighbours below u, and u, hang on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        after = materialise(small)
        discard(pairs, large)
        pairs, before, known = after, known, _digest(after)
        if known == before:
            break
    roots = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return roots.union(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
