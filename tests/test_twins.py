"""Registered queries against their SQL twins on the smallest given tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from check import TABLES, rows  # noqa: E402
from vayuspark.catalog import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")
# without a single whole forecast window in these tables, forecast queries run at larger ones (scripts/check.py)
LEARNING = ("m4", "m8", "m9", "m10", "m11", "m12", "m15", "g8", "g9", "g10_res", "g11", "g12", "g13", "s5", "f16", "w3", "w9", "w11", "w16", "m2_")
NAMES = [n for n in ORACLES if not n.startswith(LEARNING)]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())
