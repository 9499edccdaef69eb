"""Every registered query of the retrieval engine against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from gleaner.plans import registry
from tests.oracle import same

SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, name):
    same(spark, sf, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, sf, name):
    """Every value is computed, twice: the rows must be the same both times."""
    one, two = (sorted(map(str, QUERIES[name](spark, sf).collect())) for _ in range(2))
    assert one and one == two


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
