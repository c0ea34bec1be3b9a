"""Rollups as a streaming aggregation.

Buckets leave the state once the watermark passes their end plus the retention. The watermark follows
the largest event time seen; a store's eviction follows the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import start_ts
from ..operators.rollups import WINDOWS, scale_cost, unscale_cost, window_ns

# Windows as intervals.
INTERVALS = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}
assert INTERVALS.keys() == WINDOWS.keys()


def stream_rollup(spans: DataFrame, window: str, retention: str = "7 days") -> DataFrame:
    """Updating buckets (window_start, model, ...) of a stream of span rows; write it in update mode."""
    window_ns(window)
    timed = spans.withColumn("start_ts", start_ts()).withWatermark("start_ts", retention)
    out = timed.groupBy(F.window("start_ts", INTERVALS[window]).alias("w"), "model").agg(
        F.count("*").alias("spans"),
        F.sum(scale_cost(F.col("cost_usd"))).alias("micros"),
        F.sum(F.col("tokens_in").cast("long")).alias("tokens_in"),
        F.sum(F.col("tokens_out").cast("long")).alias("tokens_out"),
        F.sum("latency_ms").alias("ms"),
        F.min("latency_ms").alias("latency_min_ms"),
        F.max("latency_ms").alias("latency_max_ms"),
    )
    return out.select(F.col("w.start").alias("window_start"), "model", "spans", unscale_cost(F.col("micros")).alias("cost_usd"), "tokens_in", "tokens_out", F.expr("ms div spans").alias("latency_avg_ms"), "latency_min_ms", "latency_max_ms")
