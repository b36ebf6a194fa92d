"""Every registered query gives the same rows whatever the shuffle partitioning."""

import pytest

from platewise.plans import registry
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_same_result_for_1_and_37_shuffle_partitions(spark, key):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for parts in ("1", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            results.append(sorted(registry.QUERIES[key](spark, SF_SMALL).collect(), key=repr))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]
