"""Every query of the library against its SQL, over whole tables; those without SQL must at least give rows."""

import pytest
from conftest import rows_of

from leafmill.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in SQL:
        assert len(got)
        return
    assert rows_of(got) == rows_of(duck.execute(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
