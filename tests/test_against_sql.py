"""Every query with SQL returns the rows and types of that SQL; the others return rows."""

import pytest

import __spark_entry__ as entry
from checks.compare import connect, difference

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, connection, sf, name):
    assert difference(spark, connection, sf, entry.queries()[name], ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    trend = entry.entry(spark)
    assert trend.columns == ["year", "topic_number", "count", "topic_name"]
    rows = trend.collect()
    years, topics = {r[0] for r in rows}, {r[1] for r in rows}
    assert len(rows) == len(years) * len(topics)
