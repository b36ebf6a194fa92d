import zlib
from collections import Counter, defaultdict

import pytest

from platewise.llm import queries, sharding
from tests.conftest import SF_SMALL

from .helpers import DOC_SCHEMA, odd_docs


def check_shards(rows, docs, n):
    counts = Counter(r["shard"] for r in rows)
    total = len(docs)
    assert len(rows) == total
    assert max(counts.values()) - min(counts[s] for s in range(n)) <= 1
    for s in range(n):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    # every prefix of the interleaved order holds each source's share, so every shard does
    by_source, sizes = defaultdict(Counter), Counter(r["source"] for r in rows)
    for r in rows:
        by_source[r["shard"]][r["source"]] += 1
    for s in range(n):
        for source, size in sizes.items():
            assert abs(by_source[s][source] - size * counts[s] / total) <= 2


def test_documents_follow_the_mixture(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    rows = queries.op1_sharding(spark, SF_SMALL).collect()
    check_shards(rows, docs, 16)
    of = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    assert all(r["size"] == len(of[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(of[r["doc_id"]]) for r in rows)
    assert {r["law"] for r in rows} == {"rows"}


def test_interleaving_equals_brute_force(spark):
    rows = [(i, f"t{i}", None, "hot" if i % 3 else f"s{i % 7}", 1) for i in range(200)]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOC_SCHEMA), 5, seed=3).collect()
    order = {r["doc_id"]: (r["shard"], r["slot"]) for r in got}
    placed = [d for d, _ in sorted(order.items(), key=lambda x: x[1])]
    # fractional ranks rise along the global order
    sizes, seen, last = Counter(r[3] for r in rows), Counter(), 0.0
    for d in placed:
        source = rows[d][3]
        fraction = (seen[source] + 0.5) / sizes[source]
        seen[source] += 1
        assert fraction >= last
        last = fraction
    assert order == {r["doc_id"]: (r["shard"], r["slot"]) for r in
                     sharding.shard_documents(spark.createDataFrame(rows, DOC_SCHEMA).repartition(7), 5, seed=3).collect()}


@pytest.mark.parametrize("n", [1, 4, 16])
def test_odd_rows(spark, n):
    docs = odd_docs(spark)
    rows = sharding.shard_documents(docs, n).collect()
    check_shards(rows, docs.collect(), n)
    null = next(r for r in rows if r["doc_id"] == 3)
    assert (null["size"], null["text_crc32"], null["source"]) == (1, 0, None)


def test_empty(spark):
    assert sharding.digest(sharding.shard_documents(spark.createDataFrame([], DOC_SCHEMA))).collect() == []
