"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest
from conftest import SMALL, same

from chronofit.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    if name in SQL:
        same(df, duck.execute(SQL[name]).fetchdf())
    else:
        assert df.toPandas().shape[1] > 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
