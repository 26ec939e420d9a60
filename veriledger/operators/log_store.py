"""How an audit log lies in a folder, so that two writers cannot both follow one entry and a cut tail shows.

Each append writes its lines to a folder of its own (segment=<id>) that no reader sees yet. Then it creates the next head record, _heads/<version>.json, which names the segment, its
first and last entry and the last hash. Creating a file that must not exist is the one step that has to be atomic (a rename that does not overwrite in a shared store, a hard link on a local disk): of
two writers that followed the same head, one gets the version, and the other one's lines are dropped and chained again after the new head. An append reads the newest head record and nothing
else of the log. Readers take the lines of segments that a head names; what heads promise and lines lack is missing.
"""

from __future__ import annotations

import dataclasses
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledger.errors import AuditError

HEADS = "_heads"
HEAD = "version long, first long, last long, entry_hash string, previous_hash string, segment string, created_at string"


@dataclasses.dataclass(frozen=True)
class Head:
    """The newest entry of a log; version -1 for a log without entries."""

    version: int
    sequence_number: int
    entry_hash: str


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _path(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    place, files = _path(spark, path)
    files.delete(place, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with this text, whole or not at all; False if there is one of this name."""
    place, files = _path(spark, path)
    if files.exists(place):
        return False
    draft, _ = _path(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = files.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm = spark._jvm
    try:
        if files.getUri().getScheme() == "file":
            local = lambda p: jvm.java.nio.file.Paths.get(files.makeQualified(p).toUri())
            jvm.java.nio.file.Files.createLink(local(place), local(draft))
        else:
            kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            never = spark.sparkContext._gateway.new_array(kind, 1)
            never[0] = getattr(kind, "NONE")
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(draft), files.makeQualified(place), never)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    finally:
        files.delete(draft, False)


def start(spark: SparkSession, path: str) -> None:
    """Makes a folder a log without entries, if it is none; raises if it has lines that no head record knows."""
    place, files = _path(spark, path)
    found = files.listStatus(place) if files.exists(place) else []
    if any(f.isFile() and not f.getPath().getName().startswith(("_", ".")) for f in found):
        raise AuditError(f"{path}: lines without head records; append to a new log")
    files.mkdirs(_path(spark, f"{path}/{HEADS}")[0])


def _versions(spark: SparkSession, path: str) -> list[int]:
    place, files = _path(spark, f"{path}/{HEADS}")
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    return [int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")]


def newest(spark: SparkSession, path: str, genesis: str) -> Head:
    """The head, from the names of the head records and the newest one's content."""
    versions, (_, files) = _versions(spark, path), _path(spark, path)
    if not versions:
        return Head(-1, 0, genesis)
    source, _ = _path(spark, f"{path}/{HEADS}/{max(versions):020d}.json")
    stream = files.open(source)
    try:
        record = json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()
    return Head(record["version"], record["last"], record["entry_hash"])


def commit(spark: SparkSession, path: str, after: Head, *, last: int, entry_hash: str, segment: str, created_at: str) -> bool:
    """Makes a written segment part of the log; False if the log has another entry after this head by now."""
    record = {"version": after.version + 1, "first": after.sequence_number + 1, "last": last, "entry_hash": entry_hash, "previous_hash": after.entry_hash, "segment": segment, "created_at": created_at}
    return create_once(spark, f"{path}/{HEADS}/{after.version + 1:020d}.json", json.dumps(record) + "\n")


def has_heads(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/{HEADS}")


def heads(spark: SparkSession, path: str) -> DataFrame:
    """HEAD rows, one for each append."""
    return spark.read.schema(HEAD).json(f"{path}/{HEADS}/*.json") if _versions(spark, path) else spark.createDataFrame([], HEAD)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(segment, value) of the lines of committed segments."""
    if not _versions(spark, path):
        return spark.createDataFrame([], "segment string, value string")
    every = spark.read.option("recursiveFileLookup", "true").text(path).select(F.regexp_extract("_metadata.file_path", "/segment=([0-9a-f]+)/", 1).alias("segment"), "value")
    return every.join(heads(spark, path).select("segment"), "segment", "left_semi")


def missing(spark: SparkSession, path: str, entries: DataFrame) -> DataFrame:
    """(sequence_number) of entries that a head record promises and that entries (sequence_number) lacks."""
    promised = heads(spark, path).where("first <= last").select(F.explode(F.sequence("first", "last")).alias("sequence_number"))
    return promised.join(entries.select("sequence_number"), "sequence_number", "left_anti")


def check_heads(spark: SparkSession, path: str, genesis: str) -> None:
    """Raises if a head record is lost or does not follow the one before it."""
    records = heads(spark, path)
    before = records.select((F.col("version") + 1).alias("version"), (F.col("last") + 1).alias("_first"), F.col("entry_hash").alias("_hash"))
    both = records.join(before, "version", "left")
    follows = F.when(F.col("version") == 0, (F.col("first") == 1) & (F.col("previous_hash") == genesis)).otherwise((F.col("first") == F.col("_first")) & (F.col("previous_hash") == F.col("_hash")))
    if not both.where(~F.coalesce(follows, F.lit(False))).isEmpty():
        raise AuditError("a head record is lost or was changed")
