"""Every registered query against its SQL on the smallest given tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import compare
from retally.catalog.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return compare.duck(FOLDER)


def test_every_query_has_its_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 20


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    query, sql = entry.queries()[name], entry.oracle_sql()[name]
    assert compare.difference(query, sql, spark, FOLDER, duck) is None
