"""Every registered query next to its SQL twin on the smallest tables."""

import pytest
from compare import compare, open_tables

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return open_tables(FOLDER)


@pytest.mark.parametrize("key", sorted(entry.queries()))
def test_query(spark, tables, key):
    ok, text = compare(spark, tables, FOLDER, key, entry.queries()[key], entry.oracle_sql().get(key))
    assert ok, text


def test_entry(spark):
    assert entry.entry(spark).columns == ["mol_id", "atom_index", "shift_ppm", "std_ppm", "contributing_engines"]
