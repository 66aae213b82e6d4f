"""Every registered query of the engine against its SQL oracle."""

import pytest

from leafmill.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck, same_rows):
    ours = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        same_rows(ours, duck.sql(ORACLES[name]).df())
    else:
        assert len(ours) == 50


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["cn", "part"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
