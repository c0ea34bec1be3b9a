"""Tumbling-window rollups per model.

They count the append log as it arrives, so a span that is written twice counts twice and a delete
takes nothing away; give them the log, never live spans. Cost is kept in millionths of a dollar,
rounded per span. Buckets of longer windows are merged from one-minute partials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.errors import UnsupportedWindow
from ..functions.predicates import TimeRange

# Windows and their nanoseconds.
WINDOWS = {"1m": 60_000_000_000, "5m": 300_000_000_000, "1h": 3_600_000_000_000, "1d": 86_400_000_000_000}
BUCKET = ["window_start_ns", "model", "spans", "sum_cost_micros", "tokens_in", "tokens_out", "sum_latency_ms", "latency_min_ms", "latency_max_ms"]


def window_ns(window: str) -> int:
    if window not in WINDOWS:
        raise UnsupportedWindow(window)
    return WINDOWS[window]


def scale_cost(cost: Column) -> Column:
    """Dollars as millionths, halves away from zero."""
    return F.round(cost * 1e6).cast("long")


def unscale_cost(micros: Column) -> Column:
    return micros / F.lit(1e6)


def bucket_start(window: str) -> Column:
    return F.col("start_ns") - F.col("start_ns") % F.lit(window_ns(window))


def partials(log: DataFrame, window: str = "1m") -> DataFrame:
    """Buckets (BUCKET columns) of log rows; tombstones add nothing."""
    rows = log.filter(~F.col("_deleted")) if "_deleted" in log.columns else log
    return rows.groupBy(bucket_start(window).alias("window_start_ns"), "model").agg(
        F.count("*").alias("spans"),
        F.sum(scale_cost(F.col("cost_usd"))).alias("sum_cost_micros"),
        F.sum(F.col("tokens_in").cast("long")).alias("tokens_in"),
        F.sum(F.col("tokens_out").cast("long")).alias("tokens_out"),
        F.sum("latency_ms").alias("sum_latency_ms"),
        F.min("latency_ms").alias("latency_min_ms"),
        F.max("latency_ms").alias("latency_max_ms"),
    )


def merge(buckets: DataFrame, window: str) -> DataFrame:
    """Buckets of a window from partial buckets of any window that divides it."""
    start = F.col("window_start_ns") - F.col("window_start_ns") % F.lit(window_ns(window))
    sums = ("spans", "sum_cost_micros", "tokens_in", "tokens_out", "sum_latency_ms")
    return buckets.groupBy(start.alias("window_start_ns"), "model").agg(*(F.sum(c).alias(c) for c in sums), F.min("latency_min_ms").alias("latency_min_ms"), F.max("latency_max_ms").alias("latency_max_ms"))


def within(buckets: DataFrame, window: str, span: TimeRange | None = None) -> DataFrame:
    """Buckets of ``window`` whose start is in [from, to), from partials. Partials outside are skipped at the scan."""
    size = window_ns(window)
    low, high = (span or TimeRange()).bounds()
    first = -(-low // size) * size
    last = (high - 1) // size * size  # the last start below the end
    if last < first:
        return merge(buckets.filter(F.lit(False)), window)
    start = F.col("window_start_ns")
    return merge(buckets.filter((start >= first) & (start <= min(last + size - 1, (1 << 63) - 1))), window)


def present(buckets: DataFrame) -> DataFrame:
    """Buckets as they are shown: dollars and the whole-millisecond average."""
    return buckets.select(
        "window_start_ns", "model", "spans", unscale_cost(F.col("sum_cost_micros")).alias("cost_usd"), "tokens_in", "tokens_out",
        F.expr("sum_latency_ms div spans").alias("latency_avg_ms"), "latency_min_ms", "latency_max_ms",
    )


def rollup(log: DataFrame, window: str, span: TimeRange | None = None) -> DataFrame:
    """Shown buckets straight from a log, ordered by start and model."""
    size = window_ns(window)
    low, high = (span or TimeRange()).bounds()
    # whole buckets only: rows before the first whole bucket, or from the first bucket start at the end on, are skipped at the scan
    first, beyond = -(-low // size) * size, min(-(-high // size) * size, (1 << 63) - 1)
    rows = log.filter((F.col("start_ns") >= first) & (F.col("start_ns") < beyond))
    return present(partials(rows, window)).orderBy("window_start_ns", "model")


def bucket(buckets: DataFrame, window: str, start_ns: int, model: str) -> DataFrame:
    """One bucket."""
    return merge(buckets.filter((F.col("model") == model) & (F.col("window_start_ns") >= start_ns) & (F.col("window_start_ns") < start_ns + window_ns(window))), window).filter(F.col("window_start_ns") == start_ns)


def evict(buckets: DataFrame, cutoff_ns: int) -> DataFrame:
    """Buckets that retention keeps: those that start at or after the cutoff."""
    return buckets.filter(F.col("window_start_ns") >= cutoff_ns)


def by_root(spans: DataFrame, window: str, span: TimeRange | None = None) -> DataFrame:
    """Extension: buckets over all spans of a trace by its root span's team and model."""
    root = spans.filter("parent_span_id = ''").groupBy("trace_id").agg(F.min(F.struct("start_ns", "span_id", "team", "model")).alias("r")).select("trace_id", F.col("r.team").alias("root_team"), F.col("r.model").alias("root_model"))
    low, high = (span or TimeRange()).bounds()
    joined = spans.join(root, "trace_id").withColumn("window_start_ns", bucket_start(window)).filter((F.col("window_start_ns") >= low) & (F.col("window_start_ns") < high))
    return joined.groupBy("window_start_ns", "root_team", "root_model").agg(F.count("*").alias("spans"), unscale_cost(F.sum(scale_cost(F.col("cost_usd")))).alias("cost_usd"))
