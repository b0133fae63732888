"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import pytest

from stratalith.plans.catalogue import ORACLES, QUERIES
from tests.differ import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    names, rows = spark_rows(QUERIES[name](spark, data))
    assert names
    if name in ORACLES:
        expected_names, expected = duck_rows(data, ORACLES[name])
        assert names == expected_names
        assert rows == expected, (list((rows - expected).items())[:3], list((expected - rows).items())[:3])
