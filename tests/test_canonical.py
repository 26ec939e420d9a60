"""Canonical JSON from the schema, and the audit chain that is built on it."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from veriledger.errors import AuditError
from veriledger.functions.canonical import canonical
from veriledger.functions.scalars import canonical_json
from veriledger.operators import audit_chain

_SCHEMA = "i long, z struct<b: string, a: int, C: array<string>>, t string, yes boolean, d double, ds array<double>, ss array<struct<y: double, x: string>>, m map<string, long>, day date"


def _rows():
    rnd = random.Random(7)
    marks = ['"', "\\", "\n", "\r", "\t", "\f", "\b", "\x00", "\x1f", "\x7f", "\x80", "é", " ", "漢", "�", "😀", "\U0010ffff", "a", " ", "~", "/", "'"]
    text = lambda: rnd.choice([None, "", "plain", "".join(rnd.choices(marks, k=rnd.randint(1, 12)))])
    number = lambda: rnd.choice([None, 0.0, -0.0, 1.0, 0.1, 1e16, 1e22, 1e-7, 123456789.125, 5e-324, 1.7976931348623157e308, rnd.random(), float("nan"), float("inf")])
    for i in range(300):
        yield (
            rnd.choice([None, i, -(2**63)]), rnd.choice([None, {"b": text(), "a": rnd.choice([None, 3]), "C": rnd.choice([None, [], [text(), text()]])}]), text(), rnd.choice([None, True, False]), number(),
            rnd.choice([None, [], [number(), number()]]), rnd.choice([None, [], [None], [{"y": number(), "x": text()}]]), rnd.choice([None, {}, {"é": 1, "b": None, "B\n": 2, "": 3}]), rnd.choice([None, dt.date(2024, 2, 29)]),
        )


def test_equals_the_canonical_text_of_the_values(spark):
    rows = list(_rows())
    df = spark.createDataFrame(rows, _SCHEMA)
    got = df.select(F.struct(*df.columns).alias("whole")).select(canonical(F.col("whole"), df.select(F.struct(*df.columns).alias("w")).schema["w"].dataType).alias("text")).collect()
    for row, said in zip(rows, got, strict=True):
        assert said["text"] == canonical_json(dict(zip(df.columns, row, strict=True)))
    assert spark.createDataFrame([("x" * 300_000 + "é",)], "t string").select(canonical(F.col("t"), df.schema["t"].dataType).alias("t")).collect()[0]["t"] == json.dumps("x" * 300_000 + "é")
    with pytest.raises(TypeError):
        canonical(F.lit(1).cast("decimal(5,2)"), spark.sql("SELECT 1.5BD AS d").schema["d"].dataType)


def _records(spark, n=60):
    rows = [
        (i, f"a{i}é", "SAFE" if i % 2 else "FLAGGED", None if i % 5 == 0 else ["one \"two\"", ', "triggered_reasons": '][: i % 3], {"n": i, "triggered_reasons": "x"}, None if i % 2 else [{"citation_id": f"c{i}", "similarity_score": i / 7}],
         None if i % 2 else i % 4 == 0, None if i % 3 else f'warned \\ "{i}", ✓')
        for i in range(n)
    ]
    return spark.createDataFrame(rows, f"i int, account_id string, verdict string, triggered_reasons array<string>, metrics struct<n: int, triggered_reasons: string>, regulatory_provisions array<struct<citation_id: string, similarity_score: double>>, corpus_is_verified_real_text boolean, {audit_chain.WARNING_KEY} string")


def test_a_chain_of_parts_is_that_of_whole_records(spark):
    records = _records(spark)
    rows = [(r["i"], json.dumps({k: v for k, v in r.asDict(recursive=True).items() if k != "i"})) for r in records.collect()]
    whole = spark.createDataFrame(rows, "i int, record_json string")
    ask = {"order": ["i"], "created_at": 'at "é"', "head": (5, "f" * 64)}
    assert audit_chain.chain(audit_chain.with_parts(records), **ask).collect() == audit_chain.chain(whole, **ask).collect()


def test_lines_are_checked_without_python_unless_they_fail(spark, tmp_path):
    lines = audit_chain.chain(audit_chain.with_parts(_records(spark)), order=["i"], created_at="t")
    own = audit_chain.written_hash(F.col("line"), F.col("entry_hash"))
    assert lines.where(F.coalesce(own != F.col("entry_hash"), F.lit(True))).count() == 0
    changed = {3: lambda x: x.replace("FLAGGED", "SAFE"), 7: lambda x: x.replace(": ", ":"), 8: lambda x: x.replace("warned", "warmed").replace('"n": 8', '"n": 9'), 9: lambda x: x.replace("warned", "other"), 21: lambda x: x[:-1] + ', "verdict": "SAFE"}', 22: lambda x: x.replace('"entry_hash"', '"hash"')}
    said = [changed.get(r["sequence_number"], lambda x: x)(r["line"]) for r in lines.orderBy("sequence_number").collect()]
    spark.createDataFrame([(x,) for x in said], "value string").write.text(str(tmp_path / "log"))
    log = audit_chain.read_log(spark, str(tmp_path / "log"))
    # spaces that went (7) change no content; a hash that went (22) also leaves its follower without a predecessor
    want = audit_chain.broken_links(log, audit_chain.recompute()(F.col("line")))
    got = sorted(map(tuple, audit_chain.broken_entries(log).collect()))
    assert got == sorted(map(tuple, want.collect())) and not {n for n, _ in got} & {7} and {3, 22} <= {n for n, _ in got}
    with pytest.raises(AuditError):
        audit_chain.verify(spark, str(tmp_path / "log"))


def test_records_without_doubles_need_no_python(spark):
    records = _records(spark).withColumn("regulatory_provisions", F.lit(None).cast("array<string>"))
    assert "Python" not in audit_chain.with_parts(records)._jdf.queryExecution().executedPlan().toString()
    assert "Python" in audit_chain.with_parts(_records(spark))._jdf.queryExecution().executedPlan().toString()
