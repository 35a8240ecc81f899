"""Every registered query of the log engine against its SQL."""

from __future__ import annotations

import pytest
from oracle import check

from sentrylake.queries import ORACLE_SQL, QUERIES, entry


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    check(spark, QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    assert entry(spark).count() == 12
