"""Every query of the catalog against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from keepstone import catalog
from tests.compare import duck_rows, spark_rows
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, f"{DATA}/sf0.001")
    assert name in catalog.ORACLES
    assert spark_rows(df) == duck_rows(duck, catalog.ORACLES[name])


def test_entry_and_names(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
