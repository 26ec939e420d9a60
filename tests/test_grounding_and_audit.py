from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from veriledger.errors import AuditError, CorpusError, GroundingEvaluationError, IndexError_, RetrievalError
from veriledger.operators import audit_chain as A
from veriledger.operators import evaluation, retrieval
from veriledger.operators.verdicts import verdicts
from veriledger.plans import dossier
from veriledger.sources import corpus as C
from veriledger.sources import ledger as L
from veriledger.streaming import live

PROVISIONS = [
    {"citation_id": "R-1", "title": "Shared devices", "text": "Accounts that share a device need a closer look.", "keywords": ["device"]},
    {"citation_id": "R-2", "title": "Fast chains", "text": "Money that moves over several hops within hours is suspicious.", "keywords": ["hops", "velocity"]},
    {"citation_id": "R-3", "title": "Reports", "text": "Reports are filed within seven days."},
    {"citation_id": "R-4", "title": "Opening", "text": "New accounts state their purpose."},
]


@pytest.fixture()
def folder(tmp_path):
    path = tmp_path / "rules"
    path.mkdir()
    (path / "a.json").write_text(json.dumps({"verified_real_text": False, "provisions": PROVISIONS[:2]}))
    (path / "b.json").write_text(json.dumps({"verified_real_text": True, "provisions": PROVISIONS[2:]}))
    return path


def test_corpus(spark, folder):
    c = C.read_corpus(spark, str(folder))
    rows = c.provisions.orderBy("ordinal").collect()
    assert not c.verified and [r["citation_id"] for r in rows] == ["R-1", "R-2", "R-3", "R-4"] and rows[2]["keywords"] == [] and rows[2]["source_file"] == "b.json"
    assert C.scan_corpus(spark, str(folder)).count() == 4
    (folder / "a.json").unlink()
    assert C.read_corpus(spark, str(folder)).verified


@pytest.mark.parametrize("text", ["{", "[]", '{"provisions": 3}', '{"provisions": [{"citation_id": "x", "title": "t"}]}', '{"provisions": []}'])
def test_malformed_corpus(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(CorpusError):
        C.read_corpus(spark, str(tmp_path))


def test_corpus_of_many_files(spark, tmp_path):
    want = []
    for f in range(60):  # of files with none to seven provisions, some with null values and texts that are not ASCII
        own = [{"citation_id": f"F{f}-{i}", "title": "t" * i, "text": None if i == 3 else f"r\u00e8gle {i}", "keywords": ["k", None][: i % 3]} for i in range(f * 5 % 8)]
        (tmp_path / f"f{f:03}.json").write_text(json.dumps({"verified_real_text": True, "provisions": own}))
        want += [(p["citation_id"], p["title"], p["text"], p["keywords"], f"f{f:03}.json") for p in own]
    found = C.read_corpus(spark, str(tmp_path))
    assert found.verified and found.provisions.schema.simpleString() == spark.createDataFrame([], C.SCHEMA).schema.simpleString()
    assert [tuple(r) for r in found.provisions.orderBy("ordinal").collect()] == [(*w, i) for i, w in enumerate(want)]
    (tmp_path / "f030.json").write_text("[]")
    (tmp_path / "f045.json").write_text("{")
    with pytest.raises(CorpusError, match="f030.json: expected an object"):  # the first by name
        C.read_corpus(spark, str(tmp_path))


@pytest.mark.parametrize("content", [b'{"provisions": [{"citation_id": 1, "title": "t", "text": "x"}]}', b'{"provisions": [{"citation_id": "1", "title": "t", "text": "x", "keywords": null}]}', b"\xff{}"])
def test_values_of_another_type(spark, tmp_path, content):
    (tmp_path / "x.json").write_bytes(content)
    with pytest.raises(CorpusError):
        C.read_corpus(spark, str(tmp_path))


def test_missing_corpus(spark, tmp_path):
    for path in (tmp_path / "none", tmp_path):
        with pytest.raises(CorpusError):
            C.read_corpus(spark, str(path))


def test_search(spark, folder):
    index = retrieval.index(C.read_corpus(spark, str(folder)))
    found = retrieval.search(index, "accounts that share a device", top_k=2).collect()
    assert len(found) == 2 and found[0]["citation_id"] == "R-1" and -1 <= found[0]["score"] <= 1.0001
    assert len(retrieval.search(index, "device", top_k=99).collect()) == 4
    for text, k in ((" ", 3), ("device", 0)):
        with pytest.raises(IndexError_):
            retrieval.search(index, text, top_k=k)


def test_nearest_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 2)
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(12)], "row_id long, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(q, [float(q % 3), 1.0]) for q in range(5)], "query_id long, vector array<double>")
    for options in ({}, {"most_sent": 0, "large_block": 3}):
        got = {}
        for r in retrieval.nearest(queries, rows, 2, digits=9, **options).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["row_id"]))
        assert {q: sorted(v) for q, v in got.items()} == {q: [(1, q % 3), (2, q % 3 + 3)] for q in range(5)}
        assert retrieval.nearest(queries, rows.limit(0), 2, **options).count() == 0 and retrieval.nearest(queries.limit(0), rows, 2, **options).count() == 0


def test_grounding_is_for_flagged_accounts(spark, folder):
    corpus = C.read_corpus(spark, str(folder))
    index = retrieval.index(corpus)
    decided = verdicts(L.ring_ledger(spark), texts=True)
    found = retrieval.ground(decided, corpus, index).collect()
    assert sorted(r["account_id"] for r in found) == [f"ACC-LAYER-{i:03d}" for i in range(3)]
    assert all(len(r["provisions"]) == 3 and r["corpus_is_verified_real_text"] is False for r in found)
    with pytest.raises(RetrievalError):
        retrieval.ground(decided, corpus, index, strict=True)
    grounded = retrieval.ground(decided, corpus, index)
    report = evaluation.evaluate_grounding(grounded, corpus.provisions).collect()[0]
    assert (report["total_citations"], report["hallucinated_citations"], report["precision"], report["is_fully_grounded"]) == (9, 0, 1.0, True)
    with pytest.raises(GroundingEvaluationError):
        evaluation.evaluate_grounding(grounded.limit(0), corpus.provisions)


def test_details_tell_mismatch_from_unknown(spark):
    corpus = spark.createDataFrame([("a", "old", 0), ("a", "new", 1)], "citation_id string, text string, ordinal long")
    cited = spark.createDataFrame([("a", "new"), ("a", "old"), ("b", "x")], "citation_id string, text string")
    assert sorted(r["status"] for r in evaluation.grounding_details(cited, corpus).collect()) == ["citation_id_not_in_corpus", "text_mismatch", "verified"]


def test_whole_run(spark, folder, tmp_path):
    log = str(tmp_path / "log")
    ring, corpus = L.ring_ledger(spark), C.read_corpus(spark, str(folder))
    assert A.verify(spark, log) and A.head_of(spark, log) == (0, A.GENESIS)
    dossier.run(ring, corpus, log, created_at="t1")
    dossier.run(ring, corpus, log, created_at="t2", account_id="ACC-LAYER-001")
    lines = sorted((json.loads(x["value"]) for x in spark.read.text(log).collect()), key=lambda x: x["sequence_number"])
    assert [x["sequence_number"] for x in lines] == list(range(1, 21)) and lines[0]["previous_entry_hash"] == A.GENESIS
    assert all(b["previous_entry_hash"] == a["entry_hash"] for a, b in zip(lines, lines[1:]))
    flagged = [x for x in lines if x["verdict"] == "FLAGGED"]
    assert len(flagged) == 4 and all(A.WARNING_KEY in x and len(x["regulatory_provisions"]) == 3 for x in flagged)
    safe = next(x for x in lines if x["verdict"] == "SAFE")
    assert A.WARNING_KEY not in safe and safe["regulatory_provisions"] is None and safe["corpus_is_verified_real_text"] is None and safe["triggered_reasons"] == []
    assert A.verify(spark, log)


def _write(path, lines):
    path.mkdir()
    (path / "part-0.txt").write_text("\n".join(lines) + "\n\n")
    return str(path)


def test_changes_are_found(spark, tmp_path):
    records = spark.createDataFrame([(f"a{i}", json.dumps({"account_id": f"a{i}", "verdict": "SAFE", "triggered_reasons": [], "metrics": {}, "regulatory_provisions": None, "corpus_is_verified_real_text": None})) for i in range(4)], "account_id string, record_json string")
    lines = [r["line"] for r in A.chain(records, order=["account_id"], created_at="t").orderBy("sequence_number").collect()]
    assert A.verify(spark, _write(tmp_path / "good", lines))
    broken = {
        "content was changed": [lines[0], lines[1].replace("SAFE", "FLAGGED"), *lines[2:]],
        "chain is broken": [*lines[:2], lines[2].replace(json.loads(lines[2])["previous_entry_hash"], "0" * 64), lines[3]],
        "missing or repeated": [lines[0], *lines[2:]],
        "malformed": [*lines, "{oops"],
    }
    for n, (text, changed) in enumerate(broken.items()):
        with pytest.raises(AuditError, match=text):
            A.verify(spark, _write(tmp_path / f"bad{n}", changed))
    with pytest.raises(AuditError):
        A.head_of(spark, str(tmp_path / "bad3"))


def test_stream(spark, tmp_path):
    accounts, transfers = L.ring_rows()
    source = str(tmp_path / "in")
    frame = spark.createDataFrame(transfers, L.TRANSFERS)
    frame.limit(14).coalesce(1).write.parquet(source)
    people = spark.createDataFrame(accounts, L.ACCOUNTS)
    stream = lambda: spark.readStream.schema(L.TRANSFERS).parquet(source)
    start = lambda: live.score_stream(stream(), people, str(tmp_path / "ledger"), str(tmp_path / "log"), checkpoint=str(tmp_path / "cp"))
    start().awaitTermination()
    frame.exceptAll(frame.limit(14)).coalesce(1).write.mode("append").parquet(source)
    start().awaitTermination()
    assert A.verify(spark, str(tmp_path / "log"))
    log = A.read_log(spark, str(tmp_path / "log"))
    last = log.withColumn("verdict", F.get_json_object("line", "$.verdict")).groupBy("account_id").agg(F.max_by("verdict", "sequence_number").alias("verdict"))
    assert sorted(r["account_id"] for r in last.where("verdict = 'FLAGGED'").collect()) == [f"ACC-LAYER-{i:03d}" for i in range(3)]


def test_windowed_volume(spark):
    ring = L.ring_ledger(spark)
    assert live.windowed_volume(ring.transfers).agg(F.sum("n_transfers")).first()[0] == 28
