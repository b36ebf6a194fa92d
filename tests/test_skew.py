"""Hot keys: one account, caterer, promotion and experiment user each hold a third of their rows.

A skewed copy of the sf0.001 tables is derived in a scratch folder and every
registered query must still equal its DuckDB oracle on it.
"""

import os
import tempfile

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from platewise.plans import check, registry
from tests.conftest import SF_SMALL

TABLES = check.ORACLE_TABLES


@pytest.fixture(scope="module")
def skewed_dir():
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    t = {name: pq.read_table(os.path.join(SF_SMALL, f"{name}.parquet")) for name in TABLES}

    orders = t["orders"]
    cust = [1 if k % 3 == 0 else c for k, c in zip(orders["o_orderkey"].to_pylist(), orders["o_custkey"].to_pylist())]
    t["orders"] = orders.set_column(orders.schema.get_field_index("o_custkey"), "o_custkey",
                                    pa.array(cust, type=orders["o_custkey"].type))

    part = t["part"]
    promo_parts = [p for p, ty in zip(part["p_partkey"].to_pylist(), part["p_type"].to_pylist())
                   if ty == "PROMO"]
    li = t["lineitem"]
    lkey, lnum = li["l_orderkey"].to_pylist(), li["l_linenumber"].to_pylist()
    supp = [1 if k % 3 == 0 else s for k, s in zip(lkey, li["l_suppkey"].to_pylist())]
    partk = [promo_parts[0] if (k % 3 == 0 and n == 1) else p
             for k, n, p in zip(lkey, lnum, li["l_partkey"].to_pylist())]
    li = li.set_column(li.schema.get_field_index("l_suppkey"), "l_suppkey", pa.array(supp, type=li["l_suppkey"].type))
    li = li.set_column(li.schema.get_field_index("l_partkey"), "l_partkey", pa.array(partk, type=li["l_partkey"].type))
    t["lineitem"] = li

    ev = t["events"]
    users = [1 if e % 3 == 0 else u for e, u in zip(ev["event_id"].to_pylist(), ev["user_id"].to_pylist())]
    t["events"] = ev.set_column(ev.schema.get_field_index("user_id"), "user_id", pa.array(users, type=ev["user_id"].type))

    for name, table in t.items():
        pq.write_table(table, os.path.join(out, f"{name}.parquet"))
    return out


@pytest.fixture(scope="module")
def duck(skewed_dir):
    return check.duck_connection(skewed_dir)


def test_fixture_is_skewed(skewed_dir):
    orders = pq.read_table(os.path.join(skewed_dir, "orders.parquet"))
    share = pc.sum(pc.equal(orders["o_custkey"], 1)).as_py() / orders.num_rows
    assert share > 0.3


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_matches_oracle_under_skew(spark, duck, skewed_dir, key):
    ok, info = check.compare(spark, duck, key, skewed_dir)
    assert ok, info
