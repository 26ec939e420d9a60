"""The place of every row in a total order, without a task that sees all rows and without sending the tasks' counts to one place.

Rows are sorted into ranges; each range's rows before it are a sum of at most LEVELS dyadic blocks of ranges (the block left of the range for every binary digit 1
of its number), so counts are added by blocks and met by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriledger.llm.storage import materialise

#: Ranges may be 2 ** LEVELS.
LEVELS = 20
#: Of the numbers that monotonically_increasing_id() gives, the digits of the row within its partition.
ROW_DIGITS = 33


def sorted_ranges(rows: DataFrame, *order: Column) -> DataFrame:
    """rows in this order, written, with _m (ascending with the order) and _part (the range). Rows that are equal in order are told apart, so many of them are dealt over ranges too."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    return materialise(ranged.withColumn("_m", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_m", ROW_DIGITS)))


def sums_before(counts: DataFrame, *by: str) -> DataFrame:
    """counts (by..., _part, n; one row of each) with before: the sum of n in smaller _part of the same by."""
    levels = F.sequence(F.lit(0), F.lit(LEVELS))
    blocks = counts.select(*by, "n", F.explode(F.transform(levels, lambda v: F.struct(v.alias("level"), F.call_function("shiftright", F.col("_part"), v).alias("block")))).alias("b"))
    blocks = blocks.groupBy(*by, "b.level", "b.block").agg(F.sum("n").alias("total"))
    left = F.transform(levels, lambda v: F.struct(v.alias("level"), F.call_function("shiftright", F.col("_part"), v).alias("block")))
    odd = F.transform(F.filter(left, lambda x: x["block"] % 2 == 1), lambda x: F.struct(x["level"].alias("level"), (x["block"] - 1).alias("block")))
    asked = counts.select(*by, "_part", F.explode(odd).alias("b")).select(*by, "_part", "b.level", "b.block")
    found = asked.join(blocks.hint("merge"), [*by, "level", "block"]).groupBy(*by, "_part").agg(F.sum("total").alias("before"))
    return counts.join(found.hint("merge"), [*by, "_part"], "left").withColumn("before", F.coalesce("before", F.lit(0).cast("long")))


def positions(rows: DataFrame, *order: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with pos: the number of rows before each, of the same by if given (by come first in the order; they must not be null)."""
    ranged = sorted_ranges(rows, *[F.col(c) for c in by], *order)
    counts = ranged.groupBy(*by, "_part").agg(F.count("*").alias("n"), F.min("_m").alias("_first"))
    offsets = sums_before(counts, *by).select(*by, "_part", (F.col("before") - F.col("_first")).alias("_shift"))
    return ranged.join(offsets.hint("merge"), [*by, "_part"]).withColumn("pos", F.col("_m") + F.col("_shift")).select(*rows.columns, "pos")


def running(rows: DataFrame, weight: str, *order: Column) -> DataFrame:
    """rows with before: the sum of weight over the rows before each."""
    ranged = sorted_ranges(rows, *order)
    offsets = sums_before(ranged.groupBy("_part").agg(F.sum(weight).alias("n"))).select("_part", F.col("before").alias("_before"))
    so_far = Window.partitionBy("_part").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("_own", F.coalesce(F.sum(weight).over(so_far), F.lit(0)))
    return own.join(offsets.hint("merge"), "_part").withColumn("before", F.col("_before") + F.col("_own")).select(*rows.columns, "before")
