"""Every named query against its SQL on the smallest tables."""

import pytest

import check_results
from rateline.plans.oracle import SQL
from rateline.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check_results.connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_result(spark, con, name):
    frame = QUERIES[name](spark, FOLDER)
    want = con.sql(SQL[name])
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    assert kinds == {
        c: check_results.TYPE_NAMES[str(k)] for c, k in zip(want.columns, want.types)
    }
    assert check_results.differences(frame.toPandas(), want.df()) is None
