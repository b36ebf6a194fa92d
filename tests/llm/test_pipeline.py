import hashlib

import pytest

import corpus_pipeline
from platewise.llm import bpe, neardup, quality, queries, secrets
from tests.conftest import SF_SMALL

from . import test_decontaminate, test_neardup, test_secrets
from .helpers import DOC_SCHEMA, ODD_ROWS, prose


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before the first stage and after each one."""
    root = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_SMALL).write.parquet(f"{root}/{i}")
        docs = spark.read.parquet(f"{root}/{i}")
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_are_those_of_documents(stages):
    assert [name for name, _ in corpus_pipeline.STAGES][1] == "MinHash near-dedup"
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality_stage_equals_scoring_each_text(spark, stages):
    model = quality.train(stages[0], spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    want = {d for d, t in texts(stages[0]).items() if model.score(quality.features(t or "")) >= 0.5}
    assert set(texts(stages[1])) == want
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    assert not any(labels.get(d) == 0 for d in want)
    assert sum(labels.get(d) == 1 for d in want) >= 0.98 * sum(labels.get(d) == 1 for d in texts(stages[0]))


def test_dedup_stage_equals_all_pairs(stages):
    before = texts(stages[1])
    groups = test_neardup.brute(sorted(before.items()), 5)
    assert texts(stages[2]) == {d: t for d, t in before.items() if groups[d][1] == d}


def test_decontamination_stage_equals_all_stretches(spark, stages):
    before = texts(stages[2])
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    held = {d for d, _ in test_decontaminate.brute(before.items(), items)}
    assert held and texts(stages[3]) == {d: t for d, t in before.items() if d not in held}


def test_secret_stage_equals_replacing_spans(stages):
    before = texts(stages[3])
    want = {d: secrets.redacted(t, [(s, e, k) for k, s, e in test_secrets.brute_base(t) + test_secrets.brute_linked(t)]) for d, t in before.items()}
    assert texts(stages[4]) == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())


def test_last_stage_encodes_every_text(stages):
    enc = bpe.encoding(*queries.vocabulary("byte_bpe_50k.tiktoken"))
    before, rows = texts(stages[4]), stages[5].collect()
    assert len(rows) == len(before)
    for r in rows:
        assert r["ids"] == enc.encode_ordinary(before[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(before[r["doc_id"]].encode()).hexdigest()


def test_run_is_the_stages_in_order(spark, stages):
    got = corpus_pipeline.run(spark, SF_SMALL).drop("ids")
    assert sorted(got.collect()) == sorted(stages[5].drop("ids").collect())


def test_one_row_of_each_group_stays(spark):
    long = prose(60)
    rows = [(5, long), (5, long), (3, long + " x"), (None, long), (None, "only without id " * 4), (7, ""), (8, None), (7, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOC_SCHEMA)
    kept = sorted(((r["doc_id"] or 0, r["text"]) for r in neardup.deduplicated(docs).collect()), key=str)
    assert kept == sorted([(3, long + " x"), (0, "only without id " * 4), (7, ""), (8, None)], key=str)


def test_stages_take_odd_rows_and_empty_tables(spark):
    for rows in (ODD_ROWS, []):
        docs = spark.createDataFrame(rows, DOC_SCHEMA)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_SMALL)
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() <= len(rows)
