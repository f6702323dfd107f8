"""Every registered query of the library against its SQL, and the driver's contract."""

import pytest

import __spark_entry__
from inkmesh.plans.catalogue import catalogue

from .conftest import DATA, same

ALL = catalogue()


@pytest.mark.parametrize("name", [n for n, q in ALL.items() if q.sql])
def test_matches_sql(spark, duck, name):
    same(ALL[name].run(spark, DATA), duck, ALL[name].sql)


def test_every_query_has_sql():
    assert [n for n, q in ALL.items() if not q.sql] == []


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
