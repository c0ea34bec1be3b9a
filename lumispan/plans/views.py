"""Views of the driver's tables as spans and as an upsert log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The same expressions in Spark SQL and DuckDB.
SPAN_COLUMNS = {
    "trace_id": "'t' || cast(user_id as varchar(20))",
    "span_id": "'s' || cast(event_id as varchar(20))",
    "agent": "case when user_id % 11 = 0 then '' else 'agent-' || cast(user_id % 11 as varchar(20)) end",
    "model": "case when user_id % 5 = 0 then '' else 'model-' || cast(user_id % 5 as varchar(20)) end",
    "tool": "event_type",
    "team": "case when user_id % 7 = 0 then '' else 'team-' || cast(user_id % 7 as varchar(20)) end",
    "status": "case event_type when 'error' then 'ERROR' when 'view' then 'unset' when 'signup' then '' when 'click' then 'OK' else 'success' end",
    "tokens_in": "cast(event_id % 500 as int)",
    "tokens_out": "cast(event_id % 100 as int)",
    "cost_usd": "value / 1000",
    "latency_ms": "(event_id * 37) % 1000",
}
START = {"spark": "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) * 1000", "duckdb": "epoch_us(ts) * 1000"}
#: The fixed range of the range queries: 2024-01-08 to 2024-01-22, UTC.
FROM_NS, TO_NS = 1_704_672_000_000_000_000, 1_705_881_600_000_000_000
KEY = ["l_orderkey", "l_linenumber"]
SEQUENCE = ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey"]
SPLIT = "2001-06-01"


#: Known schemas save a job that would read file footers just to infer them.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span per event; keys are unique."""
    exprs = [f"{e} as {c}" for c, e in SPAN_COLUMNS.items()] + [f"{START['spark']} as start_ns", "'' as parent_span_id", "props as payload"]
    return read(spark, sf_dir, "events").selectExpr(*exprs)


def span_cte() -> str:
    exprs = ", ".join([*(f"{e} {c}" for c, e in SPAN_COLUMNS.items()), f"{START['duckdb']} start_ns", "'' parent_span_id", "props payload"])
    return f"sp as (select {exprs} from events)"


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated keys are overwrites in the order of SEQUENCE; return flag R is a deletion."""
    return read(spark, sf_dir, "lineitem").withColumn("_deleted", F.col("l_returnflag") == "R")
