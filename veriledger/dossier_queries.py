"""Registered queries of the second half of a run: provision files, grounding, records, the audit log and reports; and the SQL for the same rows.

The benchmark table serves as a rule corpus, written as provision files and read back; conversations serve as records of an audit log.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledger.errors import AuditError, VeriledgerError
from veriledger.operators import audit_chain, evaluation, log_store, retrieval, validation, verdicts
from veriledger.plans import dossier, reports
from veriledger.queries import _A, _ALL, _D, _SIGNS, RING, _ledger, _table
from veriledger.registry import query
from veriledger.sources import corpus as corpora
from veriledger.sources import ledger as ledgers
from veriledger.sources import model
from veriledger.storage import materialise, shared_dir


def _place(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/veriledger-{what}-{uuid.uuid4().hex}"


def _provision_files(spark: SparkSession, sf_dir: str, *, flags=(True, False), defects: bool = False) -> str:
    """A folder of two provision files: even items with the first flag, odd ones with the second. defects: some lack their text or title."""
    lost = lambda c, n: F.when(F.col("item_id") % n != 0, c) if defects else c  # noqa: E731  the JSON writer leaves null fields out
    name = F.col("item_id").cast("string")
    item = F.struct(
        "item_id", F.concat(F.lit("B-"), name).alias("citation_id"), lost(F.concat(F.lit("Item "), name), 7).alias("title"), lost(F.col("text"), 5).alias("text"),
        F.array(F.concat(F.lit("k"), (F.col("item_id") % 3).cast("string"))).alias("keywords"),
    )
    listed = _table(spark, sf_dir, "benchmark").where("text IS NOT NULL").groupBy((F.col("item_id") % 2).alias("id")).agg(F.array_sort(F.collect_list(item)).alias("p"))
    whole = spark.range(0, 2, 1, 2).join(F.broadcast(listed), "id", "left")  # one row, so one file, in each of two partitions
    provisions = F.transform(F.coalesce("p", F.array().cast(listed.schema["p"].dataType)), lambda p: p.dropFields("item_id"))
    folder = _place(spark, "provisions")
    whole.select(F.when(F.col("id") == 0, flags[0]).otherwise(flags[1]).alias("verified_real_text"), provisions.alias("provisions")).write.json(folder)
    return folder


_B = """bk AS (SELECT item_id, row_number() OVER (ORDER BY item_id % 2, item_id) - 1 AS ordinal, row_number() OVER (PARTITION BY item_id % 2 ORDER BY item_id) - 1 AS "position",
  concat('B-', item_id) AS citation_id, concat('Item ', item_id) AS title, text, concat('k', item_id % 3) AS keyword FROM benchmark WHERE text IS NOT NULL)"""


@query(f"""WITH {_B} SELECT citation_id, title, sha256(text) AS text_sha256, keyword AS keywords, concat('part-0000', item_id % 2) AS source, ordinal, false AS corpus_verified FROM bk""")
def corpus_files(spark, sf_dir):
    read = corpora.read_corpus(spark, _provision_files(spark, sf_dir))
    return read.provisions.select("citation_id", "title", F.sha2("text", 256).alias("text_sha256"), F.concat_ws(",", "keywords").alias("keywords"), F.substring("source_file", 1, 10).alias("source"), "ordinal", F.lit(read.verified).alias("corpus_verified"))


@query(f"""WITH {_B} SELECT citation_id, "position", item_id % 2 = 0 AS file_verified, concat_ws(',', CASE WHEN item_id % 7 = 0 THEN 'title' END, CASE WHEN item_id % 5 = 0 THEN 'text' END) AS missing,
CASE WHEN item_id % 5 <> 0 THEN sha256(text) END AS text_sha256 FROM bk""")
def corpus_files_scanned(spark, sf_dir):
    """Required keys that provisions lack, found by the distributed scan."""
    found = corpora.scan_corpus(spark, _provision_files(spark, sf_dir, defects=True))
    return found.select("citation_id", F.col("position").cast("long").alias("position"), "file_verified", F.concat_ws(",", "missing").alias("missing"), F.sha2("text", 256).alias("text_sha256"))


@query("SELECT * FROM (VALUES ('both', true), ('first', false), ('neither', false), ('second', false)) AS x(flags, corpus_verified)")
def corpus_all_verified(spark, sf_dir):
    many = {"both": (True, True), "first": (True, False), "second": (False, True), "neither": (False, False)}
    return spark.createDataFrame([(name, corpora.read_corpus(spark, _provision_files(spark, sf_dir, flags=f)).verified) for name, f in many.items()], "flags string, corpus_verified boolean")


def _outcomes(spark: SparkSession, cases: dict) -> DataFrame:
    """(case_id, exception_type): what each attempt raises; null if nothing."""
    rows = []
    for name, attempt in cases.items():
        try:
            attempt()
            rows.append((name, None))
        except Exception as raised:  # noqa: BLE001  what kind of error it is, is the result
            rows.append((name, type(raised).__name__))
    return spark.createDataFrame(rows, "case_id string, exception_type string")


def _rows_sql(rows: list[tuple], *columns: str) -> str:
    shown = lambda v: "CAST(NULL AS VARCHAR)" if v is None else str(v).lower() if isinstance(v, bool) else repr(v)
    return "SELECT * FROM (VALUES {}) AS x({})".format(", ".join(f"({', '.join(map(shown, r))})" for r in rows), ", ".join(f'"{c}"' for c in columns))


_FILE_ERRORS = {
    "no_folder": None, "no_files": [], "not_json": ["{"], "no_object": ["[]"], "no_array": ['{"provisions": 3}'], "no_text": ['{"provisions": [{"citation_id": "x", "title": "t"}]}'],
    "no_provisions": ['{"provisions": []}'], "null_text": ['{"provisions": [{"citation_id": "x", "title": "t", "text": null}]}'],
}


@query(_rows_sql([(k, None if k == "null_text" else "CorpusError") for k in _FILE_ERRORS], "case_id", "exception_type"))
def corpus_errors(spark, sf_dir):
    """Missing and malformed provision files are typed errors; a key that is there with a null value is none."""

    def attempt(texts):
        folder = _place(spark, "files")
        if texts is not None:
            spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.text(folder)
            _as_json_files(spark, folder)
        corpora.read_corpus(spark, folder)

    return _outcomes(spark, {name: lambda t=texts: attempt(t) for name, texts in _FILE_ERRORS.items()})


def _as_json_files(spark: SparkSession, folder: str) -> None:
    """The text files of a folder get names that end in .json."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(path):
        if status.getPath().getName().endswith(".txt") and status.getLen():
            fs.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(status.getPath().toString()[:-4] + ".json"))


@query(_rows_sql([("damaged_model", "IndexError_"), ("missing_model", "IndexError_"), ("model", None), ("no_source", "IndexError_"), ("two_sizes", "IndexError_")], "case_id", "exception_type"))
def embedder_errors(spark, sf_dir):
    """Fetching and loading embedding models: a sound one loads, all others are typed errors."""
    import pathlib
    import tempfile

    import numpy as np

    with tempfile.TemporaryDirectory() as folder:
        top = pathlib.Path(folder)
        for name, words, rows in (("sound", ["a", "b"], 2), ("sizes", ["a"], 2)):
            (top / name).mkdir()
            np.savez(top / name / model.FILE, words=np.array(words), matrix=np.eye(rows, 3))
        (top / "damaged").mkdir()
        (top / "damaged" / model.FILE).write_bytes(b"no archive")

        def fetched():
            model.download_model((top / "sound").as_uri(), str(top / "copy"))
            model.load_embedder(spark, str(top / "copy"))

        return _outcomes(spark, {
            "model": fetched, "missing_model": lambda: model.load_embedder(spark, str(top / "none")), "damaged_model": lambda: model.load_embedder(spark, str(top / "damaged")),
            "two_sizes": lambda: model.load_embedder(spark, str(top / "sizes")), "no_source": lambda: model.download_model((top / "none").as_uri(), str(top / "x")),
        })


_REASONS = """g AS (SELECT *, dev AND (clu OR hop OR spd) AS flagged FROM s),
rt AS (SELECT account_id, flagged, CASE WHEN flagged THEN list_filter([
  CASE WHEN dev THEN concat('shared_device_account_count=', shared_device_account_count, ' >= threshold=2') END,
  CASE WHEN clu THEN concat('local_clustering_coefficient=', printf('%.3f', local_clustering_coefficient), ' >= threshold=0.500') END,
  CASE WHEN hop THEN concat('max_multi_hop_velocity_hops=', max_multi_hop_velocity_hops, ' >= threshold=2') END,
  CASE WHEN spd THEN concat('min_hop_interval_seconds=', printf('%.1f', min_hop_interval_seconds), ' <= threshold=3600.0') END], lambda x: x IS NOT NULL) ELSE [] END AS reasons FROM g)"""


@query(f"{_ALL}, {_SIGNS}, {_REASONS} SELECT account_id, array_to_string(reasons, '; ') AS reasons, len(reasons) AS n_reasons FROM rt")
def verdict_reason_texts(spark, sf_dir):
    found = verdicts.verdicts(_ledger(spark, sf_dir), texts=True)
    return found.select("account_id", F.concat_ws("; ", "triggered_reasons").alias("reasons"), F.size("triggered_reasons").cast("long").alias("n_reasons"))


_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"unnest(regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))".format(_FOLDED)


def _embedded(name: str, key: str, text: str, source: str) -> str:
    return f"""{name}_v AS (SELECT k, d, sum(v) AS v FROM (SELECT k, CAST(concat('0x', substr(md5(w), 1, 8)) AS BIGINT) % 256 AS d, CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END AS v
  FROM (SELECT {key} AS k, {_WORDS.format(text)} AS w FROM {source})) GROUP BY k, d),
{name}_n AS (SELECT k, sqrt(sum(v * v)) AS n FROM {name}_v GROUP BY k)"""


_GROUNDED = f"""{_B}, qt AS (SELECT account_id, concat('Account ', account_id, ' flagged for suspicious money laundering typology. Structural signals observed: ', array_to_string(reasons, '; '), '.') AS query_text FROM rt WHERE flagged),
{_embedded("q", "account_id", "query_text", "qt")}, {_embedded("r", "ordinal", "concat(title, '. ', text, ' Keywords: ', keyword)", "bk")},
dots AS (SELECT q_v.k AS q, r_v.k AS r, sum(q_v.v * r_v.v) AS dot FROM q_v JOIN r_v USING (d) GROUP BY 1, 2),
sims AS (SELECT account_id, query_text, bk.*, round(coalesce(dot, 0) / coalesce(nullif(qn.n, 0) * nullif(rn.n, 0), 1), 6) + 0.0 AS score
  FROM qt CROSS JOIN bk LEFT JOIN dots ON q = account_id AND r = ordinal LEFT JOIN q_n qn ON qn.k = account_id LEFT JOIN r_n rn ON rn.k = ordinal),
top AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY score DESC, ordinal) AS rank FROM sims QUALIFY rank <= 3)"""


@query(f"{_ALL}, {_SIGNS}, {_REASONS}, {_GROUNDED} SELECT account_id, sha256(query_text) AS query_sha256, rank, citation_id, title, score AS similarity_score, concat('part-0000', item_id % 2) AS source, false AS corpus_verified FROM top")
def grounded_provisions(spark, sf_dir):
    """The provisions nearest to each flagged account's reasons."""
    corpus = corpora.read_corpus(spark, _provision_files(spark, sf_dir))
    decided = materialise(verdicts.verdicts(_ledger(spark, sf_dir), texts=True))
    found = retrieval.ground(decided, corpus, retrieval.index(corpus), digits=6)
    each = found.select("account_id", F.sha2("query_text", 256).alias("query_sha256"), F.inline("provisions"), F.col("corpus_is_verified_real_text").alias("corpus_verified"))
    return each.select("account_id", "query_sha256", F.col("rank").cast("long").alias("rank"), "citation_id", "title", "similarity_score", F.substring("source_file", 1, 10).alias("source"), "corpus_verified")


@query(f"""{_ALL}, {_SIGNS}, {_REASONS}, {_GROUNDED}, c AS (SELECT account_id, string_agg(citation_id, ',' ORDER BY rank) AS citations FROM top GROUP BY account_id)
SELECT CAST(rt.account_id AS VARCHAR) AS account_id, CASE WHEN flagged THEN 'FLAGGED' ELSE 'SAFE' END AS verdict, array_to_string(reasons, '; ') AS reasons, citations, CASE WHEN flagged THEN false END AS corpus_is_verified_real_text,
CASE WHEN flagged THEN '{audit_chain.UNVERIFIED_WARNING}' END AS warning, max_multi_hop_velocity_hops AS hops, CAST(shared_device_account_count AS BIGINT) AS devices FROM rt JOIN m USING (account_id) LEFT JOIN c USING (account_id)""")
def dossier_records(spark, sf_dir):
    """Records of all accounts: grounding, flag and warning only where the verdict is FLAGGED."""
    corpus = corpora.read_corpus(spark, _provision_files(spark, sf_dir))
    made = dossier.dossiers(_ledger(spark, sf_dir), corpus, digits=6)
    citations = F.when(F.col("regulatory_provisions").isNotNull(), F.concat_ws(",", F.transform("regulatory_provisions", lambda p: p["citation_id"])))
    return made.select(
        "account_id", "verdict", F.concat_ws("; ", "triggered_reasons").alias("reasons"), citations.alias("citations"), "corpus_is_verified_real_text", F.col(audit_chain.WARNING_KEY).alias("warning"),
        F.col("metrics.max_multi_hop_velocity_hops").alias("hops"), F.col("metrics.shared_device_account_count").alias("devices"),
    )


@query("SELECT 9 AS total_citations, 9 AS verified_citations, 0 AS hallucinated_citations, 1.0::DOUBLE AS \"precision\", true AS is_fully_grounded")
def ring_grounding_report(spark, sf_dir):
    """The ring's three flagged accounts, grounded and evaluated against the provision files, which are read again for it."""
    folder = _provision_files(spark, sf_dir)
    corpus = corpora.read_corpus(spark, folder)
    decided = materialise(verdicts.verdicts(ledgers.ring_ledger(spark), texts=True))
    report = evaluation.evaluate_grounding_of(retrieval.ground(decided, corpus, retrieval.index(corpus)), folder)
    return report.select("total_citations", "verified_citations", "hallucinated_citations", "precision", "is_fully_grounded")


_RUN = [*[(a, v) for a, *_, v in sorted(RING)], ("ACC-LAYER-001", "FLAGGED")]


@query(_rows_sql([(n, a, v, 3 if v == "FLAGGED" else 0, v == "FLAGGED", "t2" if n == len(_RUN) else "t1", True) for n, (a, v) in enumerate(_RUN, 1)], "sequence_number", "account_id", "verdict", "n_provisions", "has_warning", "created_at", "verified"))
def ring_run_log(spark, sf_dir):
    """A whole run over the ring, then one over a single account, both into one log, which verifies."""
    corpus, log = corpora.read_corpus(spark, _provision_files(spark, sf_dir)), _place(spark, "log")
    dossier.run(ledgers.ring_ledger(spark), corpus, log, created_at="t1")
    dossier.run(ledgers.ring_ledger(spark), corpus, log, created_at="t2", account_id="ACC-LAYER-001")
    of = lambda path: F.get_json_object("line", path)
    listed = F.from_json(of("$.regulatory_provisions"), "array<struct<citation_id:string>>")
    return audit_chain.read_log(spark, log).select(
        "sequence_number", "account_id", of("$.verdict").alias("verdict"), F.coalesce(F.size(listed), F.lit(0)).alias("n_provisions"), of(f"$.{audit_chain.WARNING_KEY}").isNotNull().alias("has_warning"),
        of("$.created_at").alias("created_at"), F.lit(audit_chain.verify(spark, log)).alias("verified"),
    )


_PAYLOAD = """concat('{{"account_id": "', a, '", "corpus_is_verified_real_text": ', f, ', "created_at": "', t, '", "metrics": {{"n_chars": ', c, ', "turn": ', turn, '}}, "previous_entry_hash": "', {prev}, '", "regulatory_provisions": null, "sequence_number": ', e.n, ', "system_audit_warning": ', CASE WHEN w IS NULL THEN 'null' ELSE concat('"', w, '"') END, ', "triggered_reasons": ', r, ', "verdict": "', v, '"}}')"""
_LINES = f"""e AS (SELECT row_number() OVER (ORDER BY conv_id % 2, conv_id, turn) AS n, concat('c-', conv_id, '-', turn) AS a, turn, length(text) AS c, concat('t', 1 + conv_id % 2) AS t, CASE WHEN role = 'user' THEN 'SAFE' ELSE 'FLAGGED' END AS v,
  CASE WHEN role = 'user' THEN 'null' WHEN turn % 3 = 0 THEN 'true' ELSE 'false' END AS f, CASE WHEN role <> 'user' AND turn % 3 <> 0 THEN '{audit_chain.UNVERIFIED_WARNING}' END AS w, CASE WHEN role = 'user' THEN '[]' ELSE concat('["', role, '", "x"]') END AS r
  FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL),
h AS (SELECT e.n, 'GENESIS' AS prev, sha256({_PAYLOAD.format(prev="'GENESIS'")}) AS h FROM e WHERE e.n = 1
  UNION ALL SELECT e.n, h.h, sha256({_PAYLOAD.format(prev="h.h")}) FROM h JOIN e ON e.n = h.n + 1),
l AS (SELECT e.n, a, prev, h, concat('{{', CASE WHEN w IS NULL THEN '' ELSE concat('"SYSTEM_AUDIT_WARNING": "', w, '", ') END, '"account_id": "', a, '", "corpus_is_verified_real_text": ', f, ', "created_at": "', t, '", "entry_hash": "', h, '", "metrics": {{"n_chars": ', c, ', "turn": ', turn,
  '}}, "previous_entry_hash": "', prev, '", "regulatory_provisions": null, "sequence_number": ', e.n, ', "triggered_reasons": ', r, ', "verdict": "', v, '"}}') AS line FROM e JOIN h USING (n))"""


def _conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of conversation turns, beside conv_id and turn."""
    turns = _table(spark, sf_dir, "conversations").where("text IS NOT NULL AND role IS NOT NULL")
    user = F.col("role") == "user"
    verified = F.when(~user, F.col("turn") % 3 == 0)
    record = turns.select(
        "conv_id", "turn", F.concat(F.lit("c-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("account_id"), F.when(user, "SAFE").otherwise("FLAGGED").alias("verdict"),
        F.when(user, F.array().cast("array<string>")).otherwise(F.array(F.col("role"), F.lit("x"))).alias("triggered_reasons"), F.struct(F.col("turn"), F.length("text").alias("n_chars")).alias("metrics"),
        F.lit(None).cast("array<string>").alias("regulatory_provisions"), verified.alias("corpus_is_verified_real_text"), audit_chain.warning(verified).alias(audit_chain.WARNING_KEY),
    )
    return audit_chain.with_parts(record)


def _conversation_log(spark: SparkSession, sf_dir: str) -> str:
    """An audit log of conversation turns, those of even conversations first, then the others appended."""
    ready, log = _conversation_records(spark, sf_dir), _place(spark, "log")
    for part in range(2):
        audit_chain.append(ready.where(F.col("conv_id") % 2 == part), log, order=["conv_id", "turn"], created_at=f"t{part + 1}")
    return log


@query(f"WITH RECURSIVE {_LINES} SELECT n AS sequence_number, a AS account_id, h AS entry_hash, prev AS previous_entry_hash, sha256(line) AS line_sha256 FROM l")
def audit_log_entries(spark, sf_dir):
    """A log file written in two runs: hashes of the canonical content, and the lines as they are written."""
    return audit_chain.read_log(spark, _conversation_log(spark, sf_dir)).select("sequence_number", "account_id", "entry_hash", "previous_entry_hash", F.sha2("line", 256).alias("line_sha256"))


@query(f"WITH RECURSIVE {_LINES} SELECT 'none' AS log, 0::BIGINT AS sequence_number, 'GENESIS' AS entry_hash UNION ALL SELECT 'written', max(n), arg_max(h, n) FROM l")
def audit_log_head(spark, sf_dir):
    heads = {"none": _place(spark, "log"), "written": _conversation_log(spark, sf_dir)}
    return spark.createDataFrame([(name, *audit_chain.head_of(spark, log)) for name, log in heads.items()], "log string, sequence_number long, entry_hash string")


@query("""WITH e AS (SELECT row_number() OVER (ORDER BY conv_id % 2, conv_id, turn) AS n FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL)
SELECT n AS sequence_number, CASE WHEN n % 70 = 0 THEN 'link' ELSE 'hash' END AS kind FROM e WHERE n % 70 = 0 OR n % 50 = 0""")
def audit_log_tampered(spark, sf_dir):
    """Lines of a written log, some with another content or another link; each is found by its own line, and no other."""
    n = F.col("sequence_number")
    log = audit_chain.read_log(spark, _conversation_log(spark, sf_dir))
    line = F.when(n % 70 == 0, F.regexp_replace("line", r'"previous_entry_hash": "\w+"', '"previous_entry_hash": "0"')).when(n % 50 == 0, F.replace(F.col("line"), F.lit('"n_chars": '), F.lit('"n_chars": 1'))).otherwise(F.col("line"))
    changed = _place(spark, "log")
    log.select(line.alias("value")).write.text(changed)
    return audit_chain.broken_entries(audit_chain.read_log(spark, changed))


_RACE = _LINES.replace("conv_id % 2, conv_id, turn) AS n", "1 - conv_id % 2, conv_id, turn) AS n").replace("1 + conv_id % 2) AS t", "2 - conv_id % 2) AS t")


@query(f"WITH RECURSIVE {_RACE} SELECT n AS sequence_number, a AS account_id, h AS entry_hash, prev AS previous_entry_hash, sha256(line) AS line_sha256 FROM l")
def audit_log_lost_race(spark, sf_dir):
    """Two writers chain their turns after the same head; the second to publish finds it taken, and its turns follow the other's."""
    ready, log = _conversation_records(spark, sf_dir), _place(spark, "log")
    options = {"order": ["conv_id", "turn"]}
    slow = audit_chain.draft(ready.where("conv_id % 2 = 0"), log, created_at="t2", **options)
    audit_chain.append(ready.where("conv_id % 2 = 1"), log, created_at="t1", **options)
    if audit_chain.publish(spark, slow):
        raise AuditError("two writers took one head")
    audit_chain.append(ready.where("conv_id % 2 = 0"), log, created_at="t2", **options)
    audit_chain.verify(spark, log)
    return audit_chain.read_log(spark, log).select("sequence_number", "account_id", "entry_hash", "previous_entry_hash", F.sha2("line", 256).alias("line_sha256"))


@query("""WITH e AS (SELECT row_number() OVER (ORDER BY conv_id % 2, conv_id, turn) AS n, count(*) OVER () AS total FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL)
SELECT n AS sequence_number FROM e WHERE n > total - total // 10""")
def audit_log_cut_tail(spark, sf_dir):
    """A log whose last segment was written again without the last tenth of all entries: what its heads promise and it lacks."""
    log = _conversation_log(spark, sf_dir)
    last = audit_chain.head_of(spark, log)[0]
    segment = log_store.heads(spark, log).orderBy(F.desc("version")).first()["segment"]
    shorter = audit_chain.read_log(spark, log).where(F.col("sequence_number") <= last - last // 10).where(F.get_json_object("line", "$.created_at") == "t2").select("line")
    rest = materialise(shorter)
    log_store.remove(spark, f"{log}/segment={segment}")
    rest.write.text(f"{log}/segment={segment}")
    return log_store.missing(spark, log, audit_chain.read_log(spark, log))


_TAMPERED = [
    ("content", "entry 2: the content was changed"), ("intact", "True"), ("link", "entry 3: the chain is broken"), ("malformed", "an entry is malformed"), ("missing", "entries are missing or repeated"),
    ("no_log", "True"), ("repeated", "entries are missing or repeated"),
]


@query(_rows_sql(_TAMPERED, "log", "outcome"))
def audit_verify_outcomes(spark, sf_dir):
    """What verify() says of logs that are intact, changed, cut or damaged."""
    record = lambda i: json.dumps({"account_id": f"a{i}", "verdict": "SAFE", "triggered_reasons": [], "metrics": {}, "regulatory_provisions": None, "corpus_is_verified_real_text": None})
    rows = spark.createDataFrame([(i, record(i)) for i in range(4)], "i int, record_json string")
    lines = [r["line"] for r in audit_chain.chain(rows, order=["i"], created_at="t").orderBy("sequence_number").collect()]
    previous = json.loads(lines[2])["previous_entry_hash"]
    logs = {
        "intact": lines, "content": [lines[0], lines[1].replace("SAFE", "FLAGGED"), *lines[2:]], "link": [*lines[:2], lines[2].replace(previous, "0" * 64), lines[3]], "missing": [lines[0], *lines[2:]], "repeated": [*lines, lines[3]],
        "malformed": [*lines, "{oops"], "no_log": None,
    }
    said = []
    for name, own in logs.items():
        path = _place(spark, "log")
        if own is not None:
            spark.createDataFrame([(x,) for x in own], "value string").coalesce(1).write.text(path)
        try:
            said.append((name, str(audit_chain.verify(spark, path))))
        except VeriledgerError as broken:
            said.append((name, str(broken)))
    return spark.createDataFrame(said, "log string, outcome string")


_PEOPLE = """p AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '  ' ELSE concat('A', c_custkey) END AS account_id, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_name END AS holder_name, c_custkey % 17 <> 0 AS opened,
  CASE WHEN c_custkey % 19 = 0 THEN 'NaN'::DOUBLE ELSE c_acctbal / 8000 END AS risk, CASE WHEN c_custkey % 23 = 0 THEN [] WHEN c_custkey % 29 = 0 THEN ['d', ' '] ELSE ['d'] END AS devices FROM customer)"""


@query(f"""WITH {_PEOPLE} SELECT c_custkey, 'blank_account_id' AS reason FROM p WHERE trim(account_id) = '' UNION ALL SELECT c_custkey, 'blank_holder_name' FROM p WHERE holder_name = ''
UNION ALL SELECT c_custkey, 'no_opening_time' FROM p WHERE NOT opened UNION ALL SELECT c_custkey, 'risk_out_of_range' FROM p WHERE isnan(risk) OR risk < 0 OR risk > 1
UNION ALL SELECT c_custkey, 'no_device' FROM p WHERE len(devices) = 0 UNION ALL SELECT c_custkey, 'blank_device' FROM p WHERE list_contains(devices, ' ')""")
def invalid_accounts(spark, sf_dir):
    key = F.col("c_custkey")
    people = _table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(key % 11 == 0, "  ").otherwise(F.concat(F.lit("A"), key.cast("string"))).alias("account_id"), F.when(key % 13 == 0, "").otherwise(F.col("c_name")).alias("holder_name"),
        F.when(key % 17 != 0, F.timestamp_seconds(key)).alias("opened_at"), F.when(key % 19 == 0, float("nan")).otherwise(F.col("c_acctbal") / 8000).alias("kyc_risk_score"),
        F.when(key % 23 == 0, F.array().cast("array<string>")).when(key % 29 == 0, F.array(F.lit("d"), F.lit(" "))).otherwise(F.array(F.lit("d"))).alias("device_ids"),
    )
    return validation.split(people, validation.account_reasons())[1].select("c_custkey", F.explode("reasons").alias("reason"))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS device_id, event_id % 10 <> 0 AS seen FROM events)
SELECT event_id, 'blank_device_id' AS reason FROM r WHERE coalesce(device_id, '') = '' UNION ALL SELECT event_id, 'no_first_seen' FROM r WHERE NOT seen""")
def invalid_devices(spark, sf_dir):
    n = F.col("event_id")
    rows = _table(spark, sf_dir, "events").select("event_id", F.when(n % 9 == 0, None).when(n % 4 == 0, "").otherwise(F.col("event_type")).alias("device_id"), F.when(n % 10 != 0, F.col("ts").cast("timestamp")).alias("first_seen"))
    return validation.split(rows, validation.device_reasons())[1].select("event_id", F.explode("reasons").alias("reason"))


@query(f"WITH {_D}, {_A} SELECT devices, count(*) AS n_accounts FROM (SELECT account_id, string_agg(device_id, ',' ORDER BY device_id) AS devices FROM d GROUP BY account_id) GROUP BY devices")
def device_sets(spark, sf_dir):
    """Distinct sets of devices, and how many accounts have just that set."""
    sets = _ledger(spark, sf_dir).account_devices.groupBy("account_id").agg(F.array_sort(F.collect_set("device_id")).alias("devices"))
    return sets.groupBy(F.array_join("devices", ",").alias("devices")).agg(F.count("*").alias("n_accounts"))


_CASES = [
    ("account_breaks_ledger", "LedgerError"), ("empty_string_device_id", "RecordError"), ("naive_timezone_timestamp", "RecordError"), ("nan_kyc_risk_score", "RecordError"), ("negative_transaction_amount", "RecordError"),
    ("self_loop_transaction", "RecordError"), ("threshold_out_of_range", "ThresholdError"), ("transfer_to_unknown_account", "LedgerError"), ("unknown_account", "SignalError"),
]


@query(_rows_sql([(case, kind, "typed_error", "typed_error", False) for case, kind in _CASES], "case_id", "exception_type", "expected_outcome", "outcome", "is_known_gap"))
def fuzz_outcomes(spark, sf_dir):
    """Malformed inputs, tried, and the kind of what each raised."""
    return evaluation.classify_outcomes(reports.fuzz_cases(spark).drop("exception_message"), reports.TYPED)


@query(f"SELECT {len(_CASES)} AS cases, 0 AS known_gaps, '' AS gap_ids, 1 AS gaps_if_one_were_accepted")
def fuzz_summary(spark, sf_dir):
    """Of the tried cases, and of the same cases had one been accepted."""
    cases = reports.fuzz_cases(spark)
    accepted = cases.withColumn("exception_type", F.when(F.col("case_id") != "unknown_account", F.col("exception_type")))
    more = reports.fuzz_summary(accepted).select(F.col("known_gaps").alias("gaps_if_one_were_accepted"))
    return reports.fuzz_summary(cases).withColumn("gap_ids", F.array_join("gap_ids", ",")).join(more)


@query("""SELECT 'ACC-ADV-LAYER-000' AS target_account_id, 'SAFE' AS firewall_verdict, 'FLAGGED' AS alternative_verdict, 0 AS shared_device_account_count, 3 AS max_multi_hop_velocity_hops, true AS is_false_negative, true AS has_cause, true AS has_remedy""")
def hub_findings(spark, sf_dir):
    """The finding of the hub attack, written as JSON and read again."""
    folder = _place(spark, "findings")
    reports.write_findings(reports.hub_finding(spark), folder)
    read = spark.read.schema("target_account_id string, firewall_verdict string, alternative_verdict string, shared_device_account_count long, max_multi_hop_velocity_hops long, is_false_negative boolean, root_cause string, remediation string").json(folder)
    return read.withColumns({"has_cause": F.col("root_cause").isNotNull(), "has_remedy": F.col("remediation").isNotNull()}).drop("root_cause", "remediation")


_SCORES = {"tp": 3, "fp": 0, "tn": 16, "fn": 0, "total": 19, "precision": 1.0, "recall": 1.0, "f1": 1.0, "accuracy": 1.0, "max_clustering_error": 0.0, "max_device_error": 0.0, "has_zero_degradation": True}


@query("SELECT line, unnest AS text FROM (SELECT generate_subscripts(l, 1) AS line, unnest(l) AS unnest FROM (SELECT string_split({!r}, '|') AS l))".format("|".join(["topology", *json.dumps(_SCORES, indent=2).split("\n")])))
def ring_scorecard(spark, sf_dir):
    """The printed report of the ring, line by line."""
    ring = ledgers.ring_ledger(spark)
    text = reports.scorecard(evaluation.topology_report(materialise(verdicts.verdicts(ring)), ring)[0])
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "line long, text string")
