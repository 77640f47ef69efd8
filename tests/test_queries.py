"""Every registered query gives the rows of its SQL statement."""

import pytest

import __spark_entry__ as entry_points
from listprep.plans import catalog
from compare import connect, difference

# Too few rows repeat an address at the smallest size.
LARGER = {"address_dup_groups": "/root/testdata/sf0.01"}


@pytest.fixture(scope="module")
def statements():
    return entry_points.oracle_sql()


@pytest.mark.parametrize("name", list(catalog.REGISTERED))
def test_same_rows(spark, sf_dir, statements, name):
    folder = LARGER.get(name, sf_dir)
    assert difference(spark, connect(folder), folder, entry_points.queries()[name], statements[name]) is None


def test_every_query_has_a_statement(statements):
    assert set(catalog.REGISTERED) <= set(statements)


def test_entry(spark):
    table = entry_points.entry(spark)
    assert "seq8" in table.columns and table.count() > 0
