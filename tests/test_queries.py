"""Every query of the revision log against its SQL, on the smallest tables."""

import pytest

from palimpsest import catalog
from tests.compare import spark_rows, sql_rows

DATA = "/root/testdata/sf0.001"
ROWS_ONLY = {"shard_skew", "zipf_sample", "bootstrap_ci"}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    rows = spark_rows(catalog.queries()[name](spark, DATA))
    if name in ROWS_ONLY:
        assert rows
    else:
        assert rows == sql_rows(DATA, catalog.oracle_sql()[name])


def test_control_totals(spark):
    from palimpsest.plans import fixtures

    log = fixtures.events_log(spark, DATA)
    assert (log.count(), log.where("kind = 1").count(), log.select("key").distinct().count()) == (957, 158, 15)
    assert fixtures.lineitem_log(spark, DATA).agg({"sub": "max"}).first()[0] == 11


def test_key_filter_reaches_the_scan(spark):
    from palimpsest.operators.history import visible_at

    log = spark.read.parquet(f"{DATA}/lineitem.parquet").selectExpr("l_returnflag AS key", "l_orderkey AS main", "cast(l_linenumber as bigint) AS sub", "0 AS kind", "l_linestatus AS value")
    plan = visible_at(log.where("key = 'A'"), 100)._jdf.queryExecution().toString()
    assert "EqualTo(l_returnflag,A)" in plan and "LessThanOrEqual(l_orderkey,100)" in plan
