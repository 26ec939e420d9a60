"""Encoding and decoding through a table of distinct words, against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from veriledger.llm import word_table as W

pytest.importorskip("public_tokenizers")
ODD = [
    None, "", " ", "\n\n  x", "It's  they'll 'S don't''ve", "a<|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext|", "<<|endoftext|>>", "x" * 30_000, "ab " * 20_000,
    "héllo wörld ß İ", "日本語のテキスト", "👩‍👩‍👧 🇩🇪 é", "１２３ ½ 12345678901234567890", "   tab\t\r\n", "\x00\x01 nul", "  leading", "trailing  ", "ﷺ ـ ﻿ bom", "\U0001f600" * 50,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(W.vocabulary())


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(9)
    signs = [chr(c) for c in (*range(32, 127), 0xE9, 0x4E2D, 0x1F600, 0x301, 0xA0, 0x2028, 0x660, 0x1F1E9)]
    return ODD + ["".join(rnd.choice(signs) for _ in range(rnd.randrange(60))) for _ in range(300)] + ["same text twice"] * 3


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i if i % 5 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, part long").withColumn("words", F.lit(None).cast("binary")).repartition(3)


@pytest.mark.parametrize("options", [{}, {"part_words": 300, "bucket_bytes": 64}])
def test_ids_and_texts_equal_the_library(spark, library, texts, docs, options):
    done = W.decode(W.encode(docs, **options)).collect()
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    key = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert key([(r["doc_id"], r["token_ids"], r["decoded"]) for r in done]) == key([(i if i % 5 else None, ids, library.decode(ids, skip_special_tokens=False)) for i, ids in enumerate(want)])


def test_each_word_is_encoded_once_and_sent_once_a_part(spark, docs):
    parts = W.materialise(W.parts_of(docs.repartition(2), W.vocabulary())).cache()
    lists = parts.where("words IS NOT NULL").count()
    answers = W.encoded_words(parts, W.vocabulary(), bucket_bytes=1 << 20).collect()
    assert lists == 2 and len({(r["part"], r["bucket"]) for r in answers}) == len(answers)
    sizes = parts.where("words IS NOT NULL").select("lengths").collect()
    assert sum(len(W.ints(r["counts"])) for r in answers) == sum(len(W.ints(r["lengths"])) for r in sizes)


def test_decoding_of_any_ids(spark, library):
    lists = [[0, 1, 2], [50256, 50256], [], None, [220, 50255, 128, 129], [99_999, 15, -1], [187, 188, 189], [None, 40]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "doc_id long, own array<int>")
    known = [[i for i in (x or []) if i is not None and 0 <= i < 50257] for x in lists]
    assert [r["decoded"] for r in W.decode(rows, ids="own").orderBy("doc_id").collect()] == [library.decode(x, skip_special_tokens=False) for x in known]


def test_query(spark, library, texts, tmp_path):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in W.op11_distinct_word_bpe(spark, str(tmp_path)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert got == {i: (len(x), digest(",".join(map(str, x))), digest(library.decode(x, skip_special_tokens=False))) for i, x in want.items()}
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert W.op11_distinct_word_bpe(spark, f"{tmp_path}/none").collect() == []
