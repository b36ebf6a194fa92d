import hashlib

import pytest
import regex

from platewise.llm import bpe, queries
from tests.conftest import SF_SMALL

from .helpers import DOC_SCHEMA, odd_docs, prose


@pytest.fixture(scope="module")
def vocabulary():
    return queries.vocabulary("byte_bpe_50k.tiktoken")


def ids_of(df):
    return sorted(((r["doc_id"], list(r["ids"])) for r in df.collect()), key=lambda x: (x[0] is None, x))


def test_whole_table_round_trips(spark, vocabulary):
    enc = bpe.encoding(*vocabulary)
    rows = {r["doc_id"]: r for r in queries.op2_byte_bpe(spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids, r = enc.encode_ordinary(d["text"] or ""), rows[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (200, 40), (32_768, 1024)])
def test_chunks_resynchronise(spark, vocabulary, chunk, overlap):
    texts = [
        prose(300), "a" * 1000, "'re" * 400, " \n" * 300 + "x", "x   " * 200, "word " + "!" * 500 + "'ll" * 30,
        "日本語のテキスト" * 60, "日本語、" * 90, "ab1" * 200, "a\n\n b \r\n\tc" * 70, "!'re !'s " * 60, " " * 700,
        "\x1c \x1d'd" * 90, "x" * 62 + "'re" + "y" * 300,
    ]
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOC_SCHEMA)
    enc = bpe.encoding(*vocabulary)
    encoded = bpe.encode(docs, *vocabulary, chunk=chunk, overlap=overlap)
    assert ids_of(encoded) == [(i, enc.encode_ordinary(t)) for i, t in enumerate(texts)]
    assert {r["doc_id"]: bytes(r["data"]) for r in bpe.decode(encoded, *vocabulary).collect()} == \
        {i: t.encode() for i, t in enumerate(texts)}


def test_long_prose_is_cut_into_pieces(spark, vocabulary):
    from pyspark.sql import functions as F

    text = prose(2000)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("_row", F.lit(0).cast("long"))
    got = sorted(bpe.pieces(docs, vocabulary[1], 512, 64).collect(), key=lambda r: r["piece_no"])
    assert len(got) > 20 and "".join(r["text"] for r in got) == text
    starts = {m.start() for m in regex.finditer(vocabulary[1], text)}
    at = 0
    for r in got:
        assert at in starts
        at += len(r["text"])


def test_odd_rows(spark, vocabulary):
    enc = bpe.encoding(*vocabulary)
    docs = odd_docs(spark)
    want = sorted(((r["doc_id"], enc.encode_ordinary(r["text"] or "")) for r in docs.collect()),
                  key=lambda x: (x[0] is None, x))
    assert ids_of(bpe.encode(docs, *vocabulary, chunk=100, overlap=20)) == want


def test_empty(spark, vocabulary):
    docs = spark.createDataFrame([], DOC_SCHEMA)
    assert bpe.digest(bpe.encode(docs, *vocabulary), *vocabulary).collect() == []
