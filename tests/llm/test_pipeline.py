from __future__ import annotations

import pytest

from tests.llm import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rows = [(d, f"the house and garden of {t} are in this town" if t else t) for d, t in brute.corpus(seed=8, n=40)]
    rows.append((500, "write to jane.doe42@mail.example.com about the house and the garden"))
    rows.append((501, "!!! 123"))
    table = spark.createDataFrame([(d, t, "en", None, len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(7, rows[3][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.simpleString() == docs.schema.simpleString(), name
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        kept[name] = docs.collect()
    by = {name: sorted(r["doc_id"] for r in own) for name, own in kept.items()}
    letters = [(d, t) for d, t in rows if t and any(c.isalpha() for c in t)]
    assert by["language_id"] == sorted(d for d, _ in letters)
    classes = brute.classes(letters)
    assert by["ngram_jaccard_join"] == sorted(set(classes.values()))
    left = [(d, t) for d, t in letters if d in set(classes.values())]
    left = list({d: (d, t) for d, t in left}.values())
    clean = [d for (d, _), h in zip(left, brute.benchmark_hits(left, items), strict=True) if not h[1]]
    assert by["benchmark_decontamination"] == sorted(clean)
    assert by["pii_pseudonyms"] == sorted(clean)
    mail = next(r["text"] for r in kept["pii_pseudonyms"] if r["doc_id"] == 500)
    assert "jane.doe42@" not in mail and "@mail.example.com" in mail
    assert set(by["best_fit_packing"]) == set(clean)


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
