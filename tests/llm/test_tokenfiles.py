import uuid
import zlib

import numpy as np
import pytest

from platewise.llm import common, queries, tokenfiles
from tests.conftest import SF_SMALL

from .helpers import DOC_SCHEMA, ODD_ROWS, odd_docs, prose


@pytest.fixture(scope="module")
def path():
    return queries.vocabulary("byte_bpe_50k.json")[0]


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def expected(rows, library):
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = np.array([*library(text), 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def rows_of(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=lambda r: r[1])


def test_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(queries.op8_token_files(spark, SF_SMALL)) == expected([tuple(d) for d in docs], library)


TRICKY = ["a  b", " a", "a ", "a \n\nb", "a\n\n", "\x1c\x1d!! \x1ea", "don't 're", "<|endoftext|> x <|endoftext|>", "日本 語", "　x　　y",
          "x" * 3000 + " " + "y" * 60, "\t\tcode(  a )\r\n", "é  è", "a​b ​ c"]


def test_segments_encode_as_in_the_text(path, library):
    enc = tokenfiles.encoder(path)
    for _ in range(2):  # also from memory
        assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode([*TRICKY, prose(500)])] == [library(t) for t in [*TRICKY, prose(500)]]


def test_segments_reach_the_library_without_separators(path, library):
    class Watched:
        def __init__(self, tokenizer):
            self.tokenizer, self.texts = tokenizer, []

        def encode_batch_fast(self, texts, **options):
            self.texts += texts
            return self.tokenizer.encode_batch_fast(texts, **options)

    enc = tokenfiles.SegmentEncoder(path)
    enc.tokenizer = watched = Watched(enc.tokenizer)
    between = enc.separator[0]
    for text in [prose(500) + "\né\n日本 語 x\x1c \x1e!y z", f"one {between}two{between} three"]:
        watched.texts.clear()
        assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == library(text)
        # only the text that has it, and what has no place in a run, such as a text's first word
        assert sum(t.count(between) for t in watched.texts) <= (2 if between not in text else 10)


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_odd_rows_and_one_document(spark, path, library, block_bytes):
    rows = [(r[0], r[1]) for r in ODD_ROWS] + [(100 + i, t) for i, t in enumerate(TRICKY)]
    docs = odd_docs(spark, extra=("range_no", "data", "offsets")).unionByName(
        spark.createDataFrame([(100 + i, t, "", "", 0) for i, t in enumerate(TRICKY)], DOC_SCHEMA), allowMissingColumns=True)
    out = f"{common.shared_folder(spark)}/test-{uuid.uuid4().hex}"
    tokenfiles.write(docs, out, path, 2, block_bytes=block_bytes)
    assert rows_of(tokenfiles.read(spark, out)) == expected(rows, library)
    one = tokenfiles.read(spark, out, with_ids=True, doc_ids=[103]).collect()
    assert [(r["doc_id"], r["ids"]) for r in one] == [(103, [*library(TRICKY[3]), 2])]


def test_dictionary_is_trained_and_checked(spark, path):
    docs = spark.createDataFrame([(i, prose(60, i), "", "", 0) for i in range(400)], DOC_SCHEMA)
    out = f"{common.shared_folder(spark)}/test-{uuid.uuid4().hex}"
    tokenfiles.write(docs, out, path, 2, dictionary_size=4096)
    head = spark.read.parquet(f"{out}/dictionary").first()
    assert 0 < len(head["dictionary"]) <= 4096
    with pytest.raises(ValueError, match="dictionary"):
        tokenfiles._opened(bytes(head["dictionary"]) + b"x", head["dict_sha256"])


def test_empty(spark, path):
    out = f"{common.shared_folder(spark)}/test-{uuid.uuid4().hex}"
    tokenfiles.write(spark.createDataFrame([], DOC_SCHEMA), out, path, 2)
    assert tokenfiles.read(spark, out).collect() == []
