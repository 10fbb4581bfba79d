"""Every registered query of the library against DuckDB over the same tables."""

import pytest

from episodia.plans.catalogue import ORACLES, QUERIES
from oracle import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    assert spark_rows(QUERIES[name](spark, sf)) == duck_rows(ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
