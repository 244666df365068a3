"""Every registered query against its SQL twin."""

import pytest

from tests.compare import compare
from tests.conftest import FOLDER
from trailmark.catalog import registry

import __spark_entry__


@pytest.mark.parametrize("name", list(registry.load()))
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, FOLDER, name)
    assert ok, note


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert sum(r["count"] for r in rows) == spark.read.parquet(f"{FOLDER}/pages.parquet").count()


def test_names_fit():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
