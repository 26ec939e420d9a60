"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

DIR = "spark.checkpoint.dir"
#: Spark's own setting that removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Of this thread (or task of an event loop): the tables of each open scope, inner ones last.
_open: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, one of our own in local mode (as in tests); on a cluster that is an error."""
    path = spark.conf.get(DIR, None) or spark.sparkContext.getConf().get(DIR)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"{DIR} is not set: tables between steps need a folder that all executors share")
        path = tempfile.mkdtemp(prefix="veriledger-")
        spark.conf.set(DIR, path)
    return path.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lost executors need no earlier stage.

    The shuffle files behind the table go when it is written, not when the driver next collects its garbage; the session's setting comes back.
    """
    spark = df.sparkSession
    path = _new_path(spark)
    with _lean_shuffles(spark):
        df.write.parquet(path)
    return _tracked(spark.read.schema(df.schema).parquet(path), path)


def materialise_bucketed(df: DataFrame, n: int, *keys: str, compression: str = "zstd") -> DataFrame:
    """materialise() as n buckets by keys, sorted in each: what groups or joins by keys with n partitions needs no shuffle of this table, and a filter on a single key
    reads the files of one bucket. A task writes one file for each bucket that it has rows of."""
    spark = df.sparkSession
    path = _new_path(spark)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    with _lean_shuffles(spark):
        df.write.format("parquet").option("path", path).option("compression", compression).bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    return _tracked(spark.table(name), path)


def _new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/veriledger-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _lean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of what is written inside as soon as the write ends."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def _tracked(written: DataFrame, path: str) -> DataFrame:
    written._veriledger_path = path
    for paths in _open.get()[-1:]:
        paths.append(path)
    return written


def _remove(spark: SparkSession, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{path.rsplit('/', 1)[1].replace('-', '_')}`")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*written: DataFrame) -> None:
    """Removes tables of materialise() that nothing reads any more."""
    for df in written:
        if path := getattr(df, "_veriledger_path", None):
            _remove(df.sparkSession, path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Removes at its end all tables that were written inside, but those appended to the list that it gives.

    What an operator returns reads such tables, so it has to be written or collected inside.
    """
    kept: list[DataFrame] = []
    outside, paths = _open.get(), []
    _open.set((*outside, paths))
    try:
        yield kept
    finally:
        _open.set(outside)
        stay = {getattr(df, "_veriledger_path", None) for df in kept}
        for paths_outside in outside[-1:]:
            paths_outside += [p for p in paths if p in stay]
        for path in paths:
            if path not in stay:
                _remove(spark, path)
