"""Every query against its SQL, and the entry points."""

import pytest
from oracle import difference

import __spark_entry__
from spindle import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert difference(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SMALL) == ""
    assert not catalogue.QUERIES[name](spark, SMALL).isEmpty()


def test_entry_and_names(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["page_id", "ordinal", "raw_url", "url", "type", "save_path", "replace_path", "key"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scan_reads_only_what_is_asked(spark):
    plan = catalogue.save_path(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan.split("ReadSchema")[1] and "Exchange" not in plan
