import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from platewise.llm import queries, sentencepieces
from tests.conftest import SF_SMALL

from .helpers import DOC_SCHEMA, ODD_ROWS, odd_docs, prose


@pytest.fixture(scope="module")
def path():
    return queries.vocabulary("piece_bpe_32k.model")[0]


@pytest.fixture(scope="module")
def library(path):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def expected(rows, library):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = []
    for doc, text in rows:
        ids = library.encode(text or "")
        out.append((doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in df.collect()), key=str)


TRICKY = ["a  b", " a", "a ", " ", "  ", "a \n\nb", "\t\n\r", "▁a▁▁b▁", "<s> </s> <0x0A>", "x\0y", "日本 語　x　　y", "é  è é", "a" * 5000 + "  " + "b" * 40,
          "   " * 400, "word " * 3000]


def test_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert found(queries.op12_sentencepiece(spark, SF_SMALL)) == expected([tuple(d) for d in docs], library)


@pytest.mark.parametrize("block_bytes", [300, 1 << 22])
def test_odd_rows(spark, path, library, block_bytes):
    rows = [(r[0], r[1]) for r in ODD_ROWS] + [(100 + i, t) for i, t in enumerate(TRICKY)] + [(200, prose(60_000))] + [(300 + i, "same text") for i in range(50)]
    docs = odd_docs(spark, extra=("block", "bucket", "words", "places", "ids")).unionByName(
        spark.createDataFrame([(d, t, "", "", 0) for d, t in rows[len(ODD_ROWS):]], DOC_SCHEMA), allowMissingColumns=True)
    encoded = sentencepieces.encode(docs.repartition(3), path, block_bytes=block_bytes)
    assert found(sentencepieces.digest(encoded, path)) == expected(rows, library)


def test_decoding(spark, path, library):
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(TRICKY)], DOC_SCHEMA)
    got = {r["doc_id"]: r["text"] for r in sentencepieces.decode(sentencepieces.encode(docs, path), path).collect()}
    assert got == {i: library.decode(library.encode(t)) for i, t in enumerate(TRICKY)}


def test_empty(spark, path):
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert sentencepieces.digest(sentencepieces.encode(empty, path), path).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab ▁\n.é日 x", max_size=40))
def test_words_stand_alone(path, library, text):
    words = sentencepieces.marked_words(text)
    assert [i for ids in sentencepieces.segment(library, words) for i in ids] == library.encode(text)


def test_other_models_are_refused(monkeypatch, library):
    class Crossing:
        def __getattr__(self, name):
            return getattr(library, name)

        def id_to_piece(self, i):
            return "a▁b" if i == 500 else library.id_to_piece(i)

    import sentencepiece

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", lambda model_file: Crossing())
    with pytest.raises(ValueError, match="crosses"):
        sentencepieces.model(f"other-{random.random()}")


def test_blocks_come_from_one_shuffle(spark, path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    encoded = sentencepieces.encode(docs, path)
    encoded.collect()
    assert "ReusedExchange" in encoded._jdf.queryExecution().executedPlan().toString()
