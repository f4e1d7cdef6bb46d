"""Every operator with an oracle: Spark result == DuckDB result (names, types,
row multiset) on the fixture views at sf0.001."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tests.parity import compare, duck_connect

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, con, key):
    r = compare(spark, key, QUERIES[key], ORACLES[key], SF_SMALL, con)
    assert r["ok"], r


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["provincia", "code", "frecuencia"]
