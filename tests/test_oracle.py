"""Every query with SQL gives the same rows in DuckDB; the others give rows."""

import pytest

from notegrove.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import difference


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    if name in ORACLE_SQL:
        assert difference(spark, sf, name, QUERIES[name], ORACLE_SQL[name]) is None
    else:
        assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
