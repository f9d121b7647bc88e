"""Every registered query against its DuckDB text at the smallest scale."""

import pytest
from settings import SF_DIR
from parity import compare, connect

from palisade.plans.catalog import CATALOG


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_matches_oracle(spark, duck, name):
    assert compare(CATALOG[name], spark, duck, SF_DIR) is None


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 120
