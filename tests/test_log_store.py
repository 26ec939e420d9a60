"""Appends by more than one writer, and logs that lost their tail or a head record."""

from __future__ import annotations

import json
import pathlib
import shutil
import threading

import pytest
from pyspark.sql import functions as F

from veriledger.errors import AuditError
from veriledger.operators import audit_chain as A
from veriledger.operators import log_store as S


def records(spark, names):
    record = lambda a: json.dumps({"account_id": a, "verdict": "SAFE", "triggered_reasons": [], "metrics": {}, "regulatory_provisions": None, "corpus_is_verified_real_text": None})
    return spark.createDataFrame([(a, record(a)) for a in names], "account_id string, record_json string")


def append(spark, log, names, stamp="t"):
    return A.append(records(spark, names), log, order=["account_id"], created_at=stamp)


def heads_of(log):
    return sorted(pathlib.Path(log, S.HEADS).glob("*.json"))


def test_files_are_created_once(spark, tmp_path):
    (tmp_path / "h").mkdir()
    assert S.create_once(spark, f"{tmp_path}/h/a.json", "one") and not S.create_once(spark, f"{tmp_path}/h/a.json", "two")
    assert (tmp_path / "h/a.json").read_text() == "one" and not [p for p in (tmp_path / "h").iterdir() if p.name.startswith(".") and p.suffix != ".crc"]


def test_only_one_writer_gets_a_head(spark, tmp_path):
    log = str(tmp_path / "log")
    one, two = (A.draft(records(spark, n), log, order=["account_id"], created_at="t") for n in (["a", "b"], ["c"]))
    assert A.read_log(spark, log).count() == 0
    assert A.publish(spark, two) and not A.publish(spark, one)
    assert not pathlib.Path(one.folder).exists() and [r["account_id"] for r in A.read_log(spark, log).collect()] == ["c"]
    append(spark, log, ["a", "b"])
    rows = A.read_log(spark, log).orderBy("sequence_number").collect()
    assert [r["account_id"] for r in rows] == ["c", "a", "b"] and rows[1]["previous_entry_hash"] == rows[0]["entry_hash"]
    assert A.verify(spark, log) and A.head_of(spark, log) == (3, rows[2]["entry_hash"])


def test_writers_at_once(spark, tmp_path):
    log, failed = str(tmp_path / "log"), []

    def write(i):
        try:
            for j in range(2):
                append(spark, log, [f"w{i}-{j}-{k}" for k in range(3)], f"w{i}-{j}")
        except Exception as error:  # noqa: BLE001  shown by the assertion
            failed.append(error)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and A.verify(spark, log)
    rows = A.read_log(spark, log).orderBy("sequence_number").collect()
    assert [r["sequence_number"] for r in rows] == list(range(1, 19)) and len({r["account_id"] for r in rows}) == 18
    assert len(heads_of(log)) == 6 and A.has_run(spark, log, "w2-1") and not A.has_run(spark, log, "w9-1")


def test_a_head_needs_no_lines(spark, tmp_path):
    log = str(tmp_path / "log")
    append(spark, log, ["a", "b"])
    head = A.head_of(spark, log)
    for lines in pathlib.Path(log).glob("segment=*/*.txt"):
        lines.unlink()
    assert A.head_of(spark, log) == head and head[0] == 2
    with pytest.raises(AuditError):
        A.verify(spark, log)


def test_what_is_lost_is_found(spark, tmp_path):
    log = str(tmp_path / "log")
    for names in (["a", "b"], ["c", "d"], ["e"]):
        append(spark, log, names)
    known = A.head_of(spark, log)
    assert A.verify(spark, log, known=known)
    # lines of uncommitted appends do not count
    A.draft(records(spark, ["x"]), log, order=["account_id"], created_at="t")
    assert A.verify(spark, log) and A.read_log(spark, log).count() == 5
    copy = lambda name: shutil.copytree(log, tmp_path / name)
    segments = [json.loads(p.read_text())["segment"] for p in heads_of(log)]
    cut = copy("cut")
    shutil.rmtree(cut / f"segment={segments[2]}")
    with pytest.raises(AuditError, match="entry 5: promised"):
        A.verify(spark, str(cut))
    assert [r[0] for r in S.missing(spark, str(cut), A.read_log(spark, str(cut))).collect()] == [5]
    between = copy("between")
    heads_of(between)[1].unlink()
    with pytest.raises(AuditError, match="head record"):
        A.verify(spark, str(between))
    both = copy("both")
    heads_of(both)[2].unlink()
    shutil.rmtree(both / f"segment={segments[2]}")
    assert A.verify(spark, str(both))
    with pytest.raises(AuditError, match="known"):
        A.verify(spark, str(both), known=known)
    with pytest.raises(AuditError, match="gone"):
        A.verify(spark, str(tmp_path / "none"), known=known)


def test_appends_of_nothing_and_to_foreign_lines(spark, tmp_path):
    log = str(tmp_path / "log")
    assert append(spark, log, []).count() == 0 and A.verify(spark, log) and A.head_of(spark, log) == (0, A.GENESIS)
    append(spark, log, ["a"])
    assert A.verify(spark, log) and S.heads(spark, log).agg(F.max("version")).first()[0] == 1
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign/lines.txt").write_text("{}\n")
    with pytest.raises(AuditError):
        append(spark, str(tmp_path / "foreign"), ["a"])
