"""Every query of the core against its SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from folioscope.plans import catalog
from tests.oracle import DATA, compare

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark: SparkSession, name: str) -> None:
    if name in catalog.ORACLE:
        compare(spark, catalog.QUERIES[name], catalog.ORACLE[name])
    else:
        catalog.QUERIES[name](spark, str(DATA)).collect()


def test_every_sql_has_a_query() -> None:
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


def test_entry(spark: SparkSession) -> None:
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
