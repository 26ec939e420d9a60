"""Provision files: a folder of JSON objects, each with a flag and an array of provisions."""

from __future__ import annotations

import dataclasses
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriledger.errors import CorpusError
from veriledger.storage import materialise

SCHEMA = "citation_id string, title string, text string, keywords array<string>, source_file string, ordinal long"
_REQUIRED = ("citation_id", "title", "text")
_FILE_SCHEMA = "path string, position long, n long, verified boolean, wrong string, citation_id string, title string, text string, keywords array<string>, source_file string"
_FILE_ROWS = pa.schema([
    ("path", pa.string()), ("position", pa.int64()), ("n", pa.int64()), ("verified", pa.bool_()), ("wrong", pa.string()), ("citation_id", pa.string()), ("title", pa.string()), ("text", pa.string()),
    ("keywords", pa.list_(pa.string())), ("source_file", pa.string()),
])


@dataclasses.dataclass(frozen=True)
class Corpus:
    """provisions as in SCHEMA (ordinal: by file name, then position); verified: all files say that their text is real."""

    provisions: DataFrame
    verified: bool


def _parse(name: str, content: bytes) -> tuple[bool, list[tuple]]:
    try:
        whole = json.loads(content.decode("utf-8", "strict"))
    except ValueError as wrong:
        raise CorpusError(f"{name}: not JSON ({wrong})") from wrong
    if not isinstance(whole, dict):
        raise CorpusError(f"{name}: expected an object")
    listed = whole.get("provisions")
    if not isinstance(listed, list):
        raise CorpusError(f"{name}: provisions must be an array")
    rows = []
    for n, p in enumerate(listed):
        missing = [k for k in _REQUIRED if not isinstance(p, dict) or k not in p]
        if missing:
            raise CorpusError(f"{name}: provision {n} lacks {', '.join(missing)}")
        keywords = p.get("keywords", [])
        if not isinstance(keywords, list) or not all(isinstance(v, str | None) for v in (*(p[k] for k in _REQUIRED), *keywords)):
            raise CorpusError(f"{name}: provision {n} has a value of another type")
        rows.append((*(p[k] for k in _REQUIRED), keywords))
    return bool(whole.get("verified_real_text", False)), rows


def _read_files(batches):
    """For each file a row with its flag, its number of provisions or what is wrong with it, and a row for each provision."""
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            path = path.as_py()
            name = path.rsplit("/", 1)[-1]
            flag, rows, wrong = False, [], None
            try:
                flag, rows = _parse(name, content.as_py())
            except CorpusError as raised:
                wrong = str(raised)
            head = {"path": path, "position": -1, "n": len(rows), "verified": flag, "wrong": wrong}
            listed = [{"path": path, "position": i, "source_file": name, **dict(zip((*_REQUIRED, "keywords"), r, strict=True))} for i, r in enumerate(rows)]
            yield pa.RecordBatch.from_pylist([head, *listed], schema=_FILE_ROWS)


def read_corpus(spark: SparkSession, folder: str) -> Corpus:
    """Files are parsed whole, strictly, where they are read; ordinals follow file names, then positions.

    Of the files the driver gets one row of counts and, if some are wrong, what is wrong with the first. Ordinals are running sums of the files' counts,
    over one short row for each file. An empty array of provisions is no error while another file has some.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        raise CorpusError(f"no folder {folder}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", "content")
    parsed = materialise(files.mapInArrow(_read_files, _FILE_SCHEMA))
    heads = parsed.where("position < 0")
    found = heads.agg(F.count("*").alias("files"), F.sum("n").alias("n"), F.bool_and("verified").alias("verified"), F.expr("min_by(wrong, path) FILTER (WHERE wrong IS NOT NULL)").alias("wrong")).first()
    if not found["files"]:
        raise CorpusError(f"no .json files in {folder}")
    if found["wrong"] is not None:
        raise CorpusError(found["wrong"])
    if not found["n"]:
        raise CorpusError(f"no provisions in {folder}")
    before = F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    starts = heads.select("path", F.coalesce(before, F.lit(0)).alias("start"))
    listed = parsed.where("position >= 0").join(starts, "path").withColumn("ordinal", F.col("start") + F.col("position"))
    return Corpus(listed.select("citation_id", "title", "text", "keywords", "source_file", "ordinal"), found["verified"])


def scan_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Provisions through a distributed scan, for folders too large to parse in one place: the columns of SCHEMA but ordinal, and position, file_verified and missing.

    missing: required keys that the provision lacks; a key with a null value is there. A file that is not an object with an array of provisions fails the scan.
    """
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
    parsed = F.from_json("value", "verified_real_text string, provisions array<string>", {"mode": "FAILFAST"})
    named = files.select(parsed.alias("f"), F.col("_metadata.file_name").alias("source_file"))
    listed = named.select("source_file", F.coalesce(~F.lower("f.verified_real_text").isin("false", "0", "", "null"), F.lit(False)).alias("file_verified"), F.posexplode("f.provisions").alias("position", "p"))
    own = F.from_json("p", "citation_id string, title string, text string, keywords array<string>")
    keys = F.coalesce(F.json_object_keys("p"), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*[F.lit(k) for k in _REQUIRED]), keys)
    return listed.select(own.alias("o"), "source_file", "position", "file_verified", missing.alias("missing")).select(
        "o.citation_id", "o.title", "o.text", F.coalesce("o.keywords", F.array().cast("array<string>")).alias("keywords"), "source_file", "position", "file_verified", "missing"
    )


def embedding_text(title, text, keywords):
    """What an embedding model reads of a provision."""
    return F.concat(title, F.lit(". "), text, F.lit(" Keywords: "), F.concat_ws(", ", keywords))
