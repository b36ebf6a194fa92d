import zlib

import numpy as np

from platewise.llm import quality, queries
from tests.conftest import SF_MEDIUM

from .helpers import DOC_SCHEMA, ODD_ROWS, odd_docs, prose


def test_held_out_accuracy(spark):
    rows = queries.op5_quality(spark, SF_MEDIUM).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_MEDIUM}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF_MEDIUM}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, _, y in held if y == 1], [s for s, _, y in held if y == 0]
    wins = np.mean([[g > b for b in bad] for g in good])
    assert np.mean([p == y for _, p, y in held]) > 0.97 and wins > 0.99


def test_labels_of_the_fold_are_never_read(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{SF_MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(docs, x, where=~fold) for x in (labels, flipped))
    assert (a.weights == b.weights).all() and a.threshold == b.threshold


def test_pairs_are_learnt_and_the_bound_holds(spark):
    docs = spark.createDataFrame([(i, prose(80, i) if i % 2 else "BUY!! " * 60 + str(i), "", "", 0) for i in range(200)], DOC_SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] * 2 + [(5, None), (None, 1), (7, 3)], "doc_id long, quality int")
    x, y = quality.labelled(docs, labels, bound=50)
    assert len(x) == len(y) == 50
    model = quality.train(docs, labels, bound=100)
    assert all((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in quality.score(docs, model).collect())
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(1, 200, 2))


def test_one_label_only_scores_a_half(spark):
    docs = spark.createDataFrame([(1, "a b", "", "", 0)], DOC_SCHEMA)
    model = quality.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert [r["score"] for r in quality.score(docs, model).collect()] == [0.5]


def test_odd_rows_and_empty(spark):
    model = quality.fit(np.array([quality.features(prose(50, i) if i % 2 else "X!! " * 50) for i in range(40)]), np.arange(40) % 2)
    got = quality.score(odd_docs(spark, extra=("score", "label", "h")), model).collect()
    assert len(got) == len(ODD_ROWS) and all(0 <= r["score"] <= 1 for r in got)
    kept = quality.accepted(odd_docs(spark, extra=("score",)), model)
    assert "score" in kept.columns and kept.count() > 0
    assert quality.score(spark.createDataFrame([], DOC_SCHEMA), model).collect() == []
