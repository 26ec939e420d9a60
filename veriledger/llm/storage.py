"""Written tables that cut lineage (as in the rest of the package), and bounds on what Arrow hands to Python at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

from veriledger.storage import discard, materialise, scope, shared_dir

__all__ = ["discard", "materialise", "scope", "shared_dir", "small_batches"]

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> None:
    """Arrow batches of at most so many rows and bytes, as documents can be long; smaller settings stay.

    Both settings are the session's and stay lowered: what the operators return is planned when it is used.
    """
    if not 0 < int(spark.conf.get(ROWS)) <= rows:
        spark.conf.set(ROWS, rows)
    known = spark.conf.get(BYTES, None)
    if known is None or not known.isdigit() or not 0 < int(known) <= size:
        spark.conf.set(BYTES, size)
