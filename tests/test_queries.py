from __future__ import annotations

import oracle
import pytest

from sheetweave.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, con, name):
    ok, why = oracle.same(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert ok, why


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    assert len(QUERIES[name](spark, sf_dir).collect()) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["c_mktsegment", "orders", "revenue"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
