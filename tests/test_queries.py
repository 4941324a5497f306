"""Every named query against its SQL twin; those without one must give rows."""

import harness
import pytest

from loomline.plans import catalog

SF = f"{harness.DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return harness.connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        assert harness.compare(df, con, catalog.ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
