import pytest

from leafmill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, sf_dir, duck, same_rows):
    same_rows(QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df())


def test_registered():
    import __spark_entry__ as entry

    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 11)) and "pipeline" in entry.queries()
