import pytest

from ledgerline.plans import catalogue
from tests.compare import duck, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, tables, name):
    out = catalogue.queries()[name](spark, SF)
    sql = catalogue.oracle_sql().get(name)
    if sql:
        same(out, tables, sql)
    else:
        assert out.count() > 0


def test_every_query_without_sql_says_why():
    for name, fn in catalogue.queries().items():
        assert name in catalogue.oracle_sql() or fn.__doc__
