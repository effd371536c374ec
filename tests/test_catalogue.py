"""Every query with a SQL twin, on the smallest tables."""

import pytest
from sqltwin import check

from tagwise.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    check(spark, name, SF, catalogue.queries(), catalogue.oracle_sql())


def test_missing_fields_reports_every_scan(spark):
    got = {r["scan_id"]: set(r["missing"].split(",")) for r in catalogue.queries()["missing_fields"](spark, SF).collect()}
    keys = [r["o_orderkey"] for r in spark.read.parquet(f"{SF}/orders.parquet").collect()]
    fields = {"MRP": 5, "NET_QUANTITY": 7, "MANUFACTURER_ADDRESS": 3, "MANUFACTURING_DATE": 13, "CONSUMER_CARE": 17}
    want = {k: {f for f, n in fields.items() if k % n == 0} for k in keys}
    assert got == {k: v for k, v in want.items() if v} and set().union(*got.values()) == set(fields)


def test_entry(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).head(3)) == 3
    assert set(e.oracle_sql()) <= set(e.queries())
