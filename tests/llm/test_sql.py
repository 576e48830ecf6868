"""The corpus operators' queries against their SQL, over whole tables."""

import pytest

from palimpsest.llm import queries
from tests.compare import spark_rows, sql_rows

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert spark_rows(queries.queries()[name](spark, DATA)) == sql_rows(DATA, queries.oracle_sql()[name])
