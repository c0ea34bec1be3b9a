"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from lumispan.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(frame, columns):
    plain = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, float) else int(v) if hasattr(v, "__index__") and not isinstance(v, bool) else str(v)
    return sorted(repr([plain(v) for v in r]) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_otlp_keeps_all_events_of_a_hot_user(spark, tmp_path):
    # one user's events are longer than the largest request; another's few are spread over all ids
    hot = "cast(case when id % 4000 = 1 then 2 else 1 end as bigint) user_id"
    spark.range(40_000).selectExpr("id event_id", hot, "timestamp'2025-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) ts", "'view' event_type").write.parquet(str(tmp_path / "events.parquet"))
    found = {name: catalog.queries()[name](spark, str(tmp_path)).toPandas() for name in ("otlp_spans", "otlp_rejections")}
    assert len(found["otlp_spans"]) == 32_000 and len(found["otlp_rejections"]) == 8_000
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for name, got in found.items():
        want = con.sql(catalog.oracle_sql()[name]).df()
        assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    from lumispan.functions.predicates import SpanFilter, TimeRange
    from lumispan.operators import live, scans
    from lumispan.plans.views import KEY, SEQUENCE, lineitem_log

    log = lineitem_log(spark, SF)
    plan = live.resolve(log.drop("_deleted"), log.limit(5), 5, KEY, SEQUENCE).filter("l_quantity > 40").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40.0)" in plan and "BroadcastHashJoin" in plan
    spans = spark.createDataFrame([], "trace_id string, start_ns long, model string")
    assert scans.matching(spans, SpanFilter(TimeRange(1, 2), model="x")).count() == 0
