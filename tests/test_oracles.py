import pytest

from compare import rows
from conftest import DATA

import kithgraph.plans.catalog as catalog

ORACLES = catalog.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).columns
