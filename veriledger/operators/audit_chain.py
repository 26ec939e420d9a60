"""An append-only audit log whose entries carry the hash of the one before.

Hashing forward is sequential by its nature: each entry needs the previous hash. So payloads are made in parallel, and one ordered task folds
over them, streaming. Checking is parallel: each entry names its predecessor's hash, so links and hashes are checked apart. Where one chain is too
long for one task, keep a log for each segment (a day, a region): each has its own head, and append() and verify() work on each alone.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledger.errors import AuditError
from veriledger.functions.canonical import canonical
from veriledger.functions.scalars import canonical_json
from veriledger.operators import log_store
from veriledger.operators.log_store import exists
from veriledger.storage import materialise

GENESIS = "GENESIS"
#: How often an append starts again because another writer was faster.
MOST_ATTEMPTS = 20
WARNING_KEY = "SYSTEM_AUDIT_WARNING"
UNVERIFIED_WARNING = "The provisions cited in this entry come from a corpus that is not marked as verified text; check them before relying on them."
LINE = "sequence_number long, account_id string, entry_hash string, previous_entry_hash string, line string"


def warning(verified: Column) -> Column:
    """Only where grounding took place and its corpus is not verified; null stays null."""
    return F.when(verified == F.lit(False), UNVERIFIED_WARNING)


def payload(record: dict, sequence: int, previous: str, created_at: str) -> dict:
    """What is hashed: ten keys, the warning's in lower case and always there."""
    return {
        "sequence_number": sequence, "account_id": record["account_id"], "verdict": record["verdict"], "triggered_reasons": list(record["triggered_reasons"] or []),
        "metrics": record["metrics"], "regulatory_provisions": record["regulatory_provisions"], "corpus_is_verified_real_text": record["corpus_is_verified_real_text"],
        "system_audit_warning": record.get(WARNING_KEY), "created_at": created_at, "previous_entry_hash": previous,
    }


def line_of(hashed: dict, entry_hash: str) -> str:
    """What is written: the warning in upper case, and left out when there is none."""
    shown = {k: v for k, v in hashed.items() if k != "system_audit_warning"} | {"entry_hash": entry_hash}
    if hashed["system_audit_warning"] is not None:
        shown[WARNING_KEY] = hashed["system_audit_warning"]
    return canonical_json(shown)


def with_parts(records: DataFrame) -> DataFrame:
    """records with a column payload: the canonical JSON of a record's own columns, cut where an entry's number, hash and time come in. Made in parallel and in the JVM (doubles: in Python).

    records: account_id, verdict, triggered_reasons, metrics, regulatory_provisions, corpus_is_verified_real_text and, where there is one, WARNING_KEY; other columns stay beside it.
    """
    kinds = {f.name: f.dataType for f in records.schema.fields}
    of = lambda name: canonical(F.col(f"`{name}`"), kinds[name])
    # a record without reasons has an empty list of them
    reasons = F.when(F.col("triggered_reasons").isNull(), "[]").otherwise(of("triggered_reasons"))
    return records.withColumn("payload", F.struct(
        F.col("account_id").cast("string").alias("account_id"),
        F.concat(F.lit('{"account_id": '), of("account_id"), F.lit(', "corpus_is_verified_real_text": '), of("corpus_is_verified_real_text"), F.lit(', "created_at": ')).alias("first"),
        F.concat(F.lit(', "metrics": '), of("metrics"), F.lit(', "previous_entry_hash": ')).alias("second"),
        F.concat(F.lit(', "regulatory_provisions": '), of("regulatory_provisions"), F.lit(', "sequence_number": ')).alias("third"),
        (of(WARNING_KEY) if WARNING_KEY in kinds else F.lit("null")).alias("warning"),
        F.concat(F.lit(', "triggered_reasons": '), reasons, F.lit(', "verdict": '), of("verdict"), F.lit("}")).alias("last"),
    ))


def _chain_parts(records: DataFrame, order: list[str], created_at: str, head: tuple[int, str]) -> DataFrame:
    """chain() of records with_parts(): what is left to the one ordered task is to join texts and hash them."""
    last, first_hash = head
    when = json.dumps(created_at)
    ordered = records.select(*order, "payload").repartition(1).sortWithinPartitions(*order).select("payload.*")

    def fold(batches):
        n, previous = last, first_hash
        for pdf in batches:
            rows = []
            for account, first, second, third, warned, rest in pdf.itertuples(index=False, name=None):
                n += 1
                until, between = f"{first}{when}", f'{second}"{previous}"{third}{n}'
                digest = hashlib.sha256(f'{until}{between}, "system_audit_warning": {warned}{rest}'.encode()).hexdigest()
                shown = until if warned == "null" else f'{{"{WARNING_KEY}": {warned}, {until[1:]}'
                rows.append((n, account, digest, previous, f'{shown}, "entry_hash": "{digest}"{between}{rest}'))
                previous = digest
            yield pd.DataFrame(rows, columns=["sequence_number", "account_id", "entry_hash", "previous_entry_hash", "line"])

    return ordered.mapInPandas(fold, LINE)


def chain(records: DataFrame, *, order: list[str], created_at: str, head: tuple[int, str] = (0, GENESIS)) -> DataFrame:
    """LINE rows for records (with_parts(), or a column record_json: a JSON object), appended after head = (last sequence number, last hash) in this total order."""
    if "payload" in records.columns:
        return _chain_parts(records, order, created_at, head)
    last, first_hash = head
    ordered = records.select(*order, "record_json").repartition(1).sortWithinPartitions(*order)

    def fold(batches):
        n, previous = last, first_hash
        for pdf in batches:
            rows = []
            for text in pdf["record_json"]:
                n += 1
                hashed = payload(json.loads(text), n, previous, created_at)
                digest = hashlib.sha256(canonical_json(hashed).encode()).hexdigest()
                rows.append((n, hashed["account_id"], digest, previous, line_of(hashed, digest)))
                previous = digest
            yield pd.DataFrame(rows, columns=["sequence_number", "account_id", "entry_hash", "previous_entry_hash", "line"])

    return ordered.mapInPandas(fold, LINE)


def linked(rows: DataFrame, *, order: list[str], payload_column: str, genesis: str = GENESIS) -> DataFrame:
    """rows with sequence_number, previous_entry_hash and entry_hash = sha256(previous, "|", payload): a chain over one text column."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", sequence_number long, previous_entry_hash string, entry_hash string"

    def fold(batches):
        n, previous = 0, genesis
        for pdf in batches:
            seq, before, own = [], [], []
            for text in pdf[payload_column]:
                n += 1
                seq.append(n)
                before.append(previous)
                previous = hashlib.sha256(f"{previous}|{text}".encode()).hexdigest()
                own.append(previous)
            yield pdf.assign(sequence_number=seq, previous_entry_hash=before, entry_hash=own)

    return rows.repartition(1).sortWithinPartitions(*order).mapInPandas(fold, schema)


def _checked(chained: DataFrame, recomputed: Column, genesis: str) -> DataFrame:
    """Entries that do not follow their predecessor (kind: link) or whose content does not give their hash (hash).

    The predecessor comes by a join on the sequence number, so no single task orders the whole chain.
    """
    before = chained.select((F.col("sequence_number") + 1).alias("sequence_number"), F.col("entry_hash").alias("_before"))
    checked = chained.join(before, "sequence_number", "left")
    link = F.col("previous_entry_hash") != F.coalesce("_before", F.lit(genesis))
    kind = F.when(F.coalesce(link, F.lit(True)), "link").when(F.coalesce(recomputed != F.col("entry_hash"), F.lit(True)), "hash")
    return checked.withColumn("kind", kind).where("kind IS NOT NULL")


def broken_links(chained: DataFrame, recomputed: Column, *, genesis: str = GENESIS) -> DataFrame:
    """(sequence_number, kind) of entries that do not follow their predecessor (link) or whose content does not give their hash (hash)."""
    return _checked(chained, recomputed, genesis).select("sequence_number", "kind")


def written_hash(line: Column, entry_hash: Column) -> Column:
    """The hash of what a line in canonical form says was hashed, by Spark's own functions; null or another hash for lines in any other form.

    The hashed text is the line without its own hash and with the warning back at its place. A line that gives the hash so has the content that was hashed: to differ, it would
    need another text with the same hash.
    """
    own = F.concat(F.lit(', "entry_hash": "'), entry_hash, F.lit('"'))
    opening = F.regexp_extract(line, rf'^\{{"{WARNING_KEY}": ((?:"(?:[^"\\]++|\\.)*+"))(?=, )', 0)
    warned = F.substring(opening, len(WARNING_KEY) + 6, F.length(opening))
    body = F.when(opening == "", line).otherwise(F.concat(F.lit("{"), F.substring(line, F.length(opening) + 3, F.length(line))))
    bare = F.replace(body, own, F.lit(""))
    mark = ', "triggered_reasons": '
    rest = F.substring_index(bare, mark, -1)
    start = F.substring(bare, F.lit(1), F.length(bare) - F.length(rest) - len(mark))
    hashed = F.concat(start, F.lit(', "system_audit_warning": '), F.when(opening == "", "null").otherwise(warned), F.lit(mark), rest)
    return F.when(F.length(body) - F.length(bare) == F.length(own), F.sha2(hashed, 256))


def broken_entries(log: DataFrame) -> DataFrame:
    """(sequence_number, kind) of a log's broken entries. Lines in canonical form are hashed in the JVM; only what fails there is parsed and hashed again in Python."""
    suspect = _checked(log, written_hash(F.col("line"), F.col("entry_hash")), GENESIS)
    parsed = F.when(F.col("kind") == "hash", recompute()(F.col("line")))
    return suspect.where(F.coalesce(parsed != F.col("entry_hash"), F.lit(True))).select("sequence_number", "kind")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """LINE rows of a log (JSON lines, blank ones skipped), of one that append() wrote only what is committed; malformed lines have null fields and are kept."""
    lines = (log_store.lines(spark, path).select("value") if log_store.has_heads(spark, path) else spark.read.text(path)).where(~F.col("value").rlike(r"^\s*$"))
    return _entries(lines)


def _entries(lines: DataFrame) -> DataFrame:
    parsed = F.from_json("value", "sequence_number long, account_id string, entry_hash string, previous_entry_hash string")
    return lines.select(parsed.alias("p"), F.col("value").alias("line")).select("p.*", "line").select("sequence_number", "account_id", "entry_hash", "previous_entry_hash", "line")


def recompute() -> Callable[[Column], Column]:
    """The hash that a written line's content gives."""

    @F.pandas_udf("string")
    def again(lines: pd.Series) -> pd.Series:
        def one(text):
            try:
                entry = json.loads(text)
                hashed = payload(entry, entry["sequence_number"], entry["previous_entry_hash"], entry["created_at"])
            except (ValueError, KeyError, TypeError):
                return None
            return hashlib.sha256(canonical_json(hashed).encode()).hexdigest()

        return lines.map(one)

    return again


def head_of(spark: SparkSession, path: str) -> tuple[int, str]:
    """(last sequence number, its hash), (0, GENESIS) for no log. Of a log that append() wrote, from its newest head record alone."""
    if log_store.has_heads(spark, path):
        head = log_store.newest(spark, path, GENESIS)
        return head.sequence_number, head.entry_hash
    if not exists(spark, path):
        return 0, GENESIS
    log = read_log(spark, path)
    found = log.agg(F.max("sequence_number").alias("n"), F.max_by("entry_hash", "sequence_number").alias("h"), F.count_if(F.col("sequence_number").isNull() | F.col("entry_hash").isNull()).alias("bad")).collect()[0]
    if found["bad"]:
        raise AuditError(f"{path}: malformed entries")
    return (found["n"], found["h"]) if found["n"] is not None else (0, GENESIS)


@dataclasses.dataclass(frozen=True)
class Draft:
    """Lines that are written but not yet part of the log, and the head that they follow."""

    path: str
    after: log_store.Head
    segment: str
    last: int
    entry_hash: str
    created_at: str

    @property
    def folder(self) -> str:
        return f"{self.path}/segment={self.segment}"


def draft(records: DataFrame, path: str, *, order: list[str], created_at: str) -> Draft:
    """Chains records after the log's newest head and writes their lines where readers do not see them yet."""
    spark = records.sparkSession
    log_store.start(spark, path)
    after, segment = log_store.newest(spark, path, GENESIS), uuid.uuid4().hex
    chained = materialise(chain(records, order=order, created_at=created_at, head=(after.sequence_number, after.entry_hash)))
    last = chained.agg(F.max("sequence_number"), F.max_by("entry_hash", "sequence_number")).collect()[0]
    made = Draft(path, after, segment, last[0] if last[0] is not None else after.sequence_number, last[1] or after.entry_hash, created_at)
    chained.select("line").write.text(made.folder)
    return made


def publish(spark: SparkSession, made: Draft) -> bool:
    """Makes a draft part of the log. False if another writer's lines have taken its place after the same head; the draft is gone then."""
    if log_store.commit(spark, made.path, made.after, last=made.last, entry_hash=made.entry_hash, segment=made.segment, created_at=made.created_at):
        return True
    log_store.remove(spark, made.folder)
    return False


def append(records: DataFrame, path: str, *, order: list[str], created_at: str) -> DataFrame:
    """Chains records after the log's head, publishes their lines, and returns them (LINE rows). If another writer is faster, the records are chained again after its lines."""
    spark = records.sparkSession
    for _ in range(MOST_ATTEMPTS):
        made = draft(records, path, order=order, created_at=created_at)
        if publish(spark, made):
            return _entries(spark.read.text(made.folder))
    raise AuditError(f"{path}: other writers were faster {MOST_ATTEMPTS} times")


def has_run(spark: SparkSession, path: str, created_at: str) -> bool:
    """Whether an append of this created_at is in the log; reads head records only."""
    return log_store.has_heads(spark, path) and not log_store.heads(spark, path).where(F.col("created_at") == created_at).isEmpty()


def verify(spark: SparkSession, path: str, *, known: tuple[int, str] | None = None) -> bool:
    """True for an intact or missing log; else an AuditError that names the first bad entry.

    Entries that a head record promises must be there, so a cut tail is found. A log of which the last head records went with their lines looks like one that was never
    longer: known, a head (sequence number, hash) that the caller kept, finds that.
    """
    if not exists(spark, path):
        if known:
            raise AuditError("the log is gone")
        return True
    log = read_log(spark, path)
    if log_store.has_heads(spark, path):
        log_store.check_heads(spark, path, GENESIS)
        lost = log_store.missing(spark, path, log).agg(F.min("sequence_number")).collect()[0][0]
        if lost is not None:
            raise AuditError(f"entry {lost}: promised by a head record and not there")
    if known and known[0] and log.where((F.col("sequence_number") == known[0]) & (F.col("entry_hash") == known[1])).isEmpty():
        raise AuditError(f"entry {known[0]}: a head that was known is not in the log")
    if not log.where("sequence_number IS NULL OR entry_hash IS NULL").isEmpty():
        raise AuditError("an entry is malformed")
    numbers = log.agg(F.count("*").alias("n"), F.max("sequence_number").alias("m"), F.count_distinct("sequence_number").alias("d")).collect()[0]
    if numbers["n"] != (numbers["m"] or 0) or numbers["d"] != numbers["n"]:
        raise AuditError("entries are missing or repeated")
    bad = broken_entries(log).orderBy("sequence_number").limit(1).collect()
    if bad:
        raise AuditError(f"entry {bad[0]['sequence_number']}: the {'chain is broken' if bad[0]['kind'] == 'link' else 'content was changed'}")
    return True

