from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_module
from check_oracles import compare, database
from factweave.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    ok, note = compare(name, spark, db, FOLDER)
    assert ok, note


def test_entry(spark):
    row = entry_module.entry(spark).first()
    assert row.n > 0 and 0 < row.f1 <= 1
