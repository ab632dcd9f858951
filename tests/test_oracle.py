"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import pytest

import __spark_entry__ as E
from tierlens.plans import catalog
from tools.oracle_check import rows_of

from .conftest import SF_SMALL

ORACLE = catalog.ORACLE
NAMES = sorted(ORACLE)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sdf = catalog.QUERIES[name](spark, SF_SMALL)
    scols, srows = sdf.columns, [tuple(r) for r in sdf.collect()]
    cur = duck.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert rows_of(scols, srows, True) == rows_of(dcols, drows, True)


def test_every_query_is_registered_with_a_callable():
    q = E.queries()
    assert len(q) >= 60
    assert set(ORACLE) <= set(q)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["day", "cost", "gpt4o_baseline_cost"]
    assert len(rows) > 0
