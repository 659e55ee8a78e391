"""Every registered query against its oracle on whole tables."""

import os

import pytest
from oracle import connect, differences

import __spark_entry__
from goldweave.plans.all_queries import CATALOG
from goldweave.plans.catalog import Tables

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_matches_oracle(spark, con, name):
    entry = CATALOG[name]
    df = entry.build(Tables(spark, FOLDER))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if entry.sql is None:
        assert df.count() > 0
    else:
        found = differences(df, con, entry.sql)
        # At the smallest scale a few reports are empty on both sides.
        assert [d for d in found if d != "no rows"] == []


def test_driver_contract(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    assert __spark_entry__.entry(spark).columns[0] == "cluster_id"


def test_scans_read_only_what_they_need(spark):
    tables = Tables(spark, FOLDER)
    wanted = {
        "clean_text_documents": "ReadSchema: struct<doc_id:bigint,text:string>",
        "discrepancies": "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz,o_orderpriority:string>",
        "value_counts": "ReadSchema: struct<p_brand:string>",
    }
    for name, schema in wanted.items():
        assert schema in CATALOG[name].build(tables)._jdf.queryExecution().executedPlan().toString()
    plan = CATALOG["audit_search"].build(tables)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan
