import pytest

from tickforge.plans import catalog

from .util import assert_same


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    assert_same(df, duck, catalog.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
