import pytest

from tests.oracle import agree, connect
from tidewheel.plans import operator_queries  # noqa: F401
from tidewheel.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(spark, data, name):
    df = QUERIES[name](spark, data)
    assert name in ORACLES
    agree(df, connect(data), ORACLES[name])


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
