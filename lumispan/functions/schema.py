"""The span table. ``start_ns`` (Unix nanoseconds) is the canonical time; missing strings are empty, never null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT_VERSION = 2
KEY = ["trace_id", "span_id"]
DIMENSIONS = ("agent", "model", "tool", "team", "status")

SPAN_SCHEMA = T.StructType(
    [
        T.StructField("trace_id", T.StringType(), False),
        T.StructField("span_id", T.StringType(), False),
        T.StructField("parent_span_id", T.StringType(), False),
        T.StructField("start_ns", T.LongType(), False),
        T.StructField("latency_ms", T.LongType(), False),
        T.StructField("agent", T.StringType(), False),
        T.StructField("model", T.StringType(), False),
        T.StructField("tool", T.StringType(), False),
        T.StructField("team", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("tokens_in", T.IntegerType(), False),
        T.StructField("tokens_out", T.IntegerType(), False),
        T.StructField("cost_usd", T.DoubleType(), False),
        T.StructField("payload", T.StringType(), True),
    ]
)
PUBLIC = SPAN_SCHEMA.fieldNames()
#: Arrival order: the batch, then the row's index in it. The later write of a key wins, whatever its start.
ARRIVAL = ["_batch", "_index"]
LOG_SCHEMA = T.StructType([*SPAN_SCHEMA.fields, T.StructField("_deleted", T.BooleanType(), False), T.StructField("_batch", T.LongType(), False), T.StructField("_index", T.LongType(), False), T.StructField("day", T.DateType(), True)])


def fill(df: DataFrame) -> DataFrame:
    """The span columns of ``df`` with missing columns and nulls as empty strings or zeros; other columns stay."""
    made = {}
    for f in SPAN_SCHEMA:
        value = F.col(f.name) if f.name in df.columns else F.lit(None)
        value = value.cast(f.dataType)
        made[f.name] = value if f.name == "payload" else F.coalesce(value, F.lit("" if isinstance(f.dataType, T.StringType) else 0).cast(f.dataType))
    return df.select(*(c.alias(k) for k, c in made.items()), *(c for c in df.columns if c not in made))


def start_ts(ns: Column | None = None) -> Column:
    """The start as a timestamp (microseconds), for windows, watermarks and display."""
    return F.timestamp_micros(F.expr("start_ns div 1000") if ns is None else (ns - F.pmod(ns, F.lit(1000))) / 1000)


def day() -> Column:
    """UTC day of the start, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.expr("cast(start_ns div 86400000000000 as int)"))
