"""Totals, rankings and listings over live spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import TooManyValues, UnsupportedGroup
from ..functions.predicates import TimeRange, clamp, failed, in_range

#: An unlimited distinct listing stops here.
MAX_DISTINCT = 10_000


def costs(spans: DataFrame, by: str, span: TimeRange | None = None) -> DataFrame:
    """(by, cost_usd) for ``by`` model or team, without spans that have none."""
    if by not in ("model", "team"):
        raise UnsupportedGroup(by)
    return spans.filter(in_range(span) & (F.col(by) != "")).groupBy(by).agg(F.sum("cost_usd").alias("cost_usd"))


def tokens_by_model(spans: DataFrame, span: TimeRange | None = None) -> DataFrame:
    t_in, t_out = F.col("tokens_in").cast("long"), F.col("tokens_out").cast("long")
    return spans.filter(in_range(span) & (F.col("model") != "")).groupBy("model").agg(F.sum(t_in).alias("tokens_in"), F.sum(t_out).alias("tokens_out"), F.sum(t_in + t_out).alias("tokens_total"))


def top_teams_by_cost(spans: DataFrame, n: int = 0, span: TimeRange | None = None) -> DataFrame:
    return costs(spans, "team", span).orderBy(F.col("cost_usd").desc(), "team").limit(clamp(n))


def top_models_by_spans(spans: DataFrame, n: int = 0, span: TimeRange | None = None) -> DataFrame:
    found = spans.filter(in_range(span) & (F.col("model") != ""))
    return found.groupBy("model").agg(F.count("*").alias("spans")).orderBy(F.col("spans").desc(), "model").limit(clamp(n))


def error_rate(spans: DataFrame, model: str = "", span: TimeRange | None = None) -> DataFrame:
    """One row with the share of failed spans in [0, 1], 0 without spans. Without a model, spans of no model count too."""
    found = spans.filter(in_range(span) & (F.col("model") == model)) if model else spans.filter(in_range(span))
    return found.agg(F.coalesce(F.avg(F.when(failed(), F.lit(1).cast("double")).otherwise(F.lit(0).cast("double"))), F.lit(0).cast("double")).alias("error_rate"))


def distinct_values(spans: DataFrame, dimension: str, span: TimeRange | None = None, limit: int = 0) -> DataFrame:
    """The smallest ``limit`` (1000 by default, 10000 at most) values of model, team or agent, in byte order."""
    if dimension not in ("model", "team", "agent"):
        raise UnsupportedGroup(dimension)
    found = spans.filter(in_range(span) & (F.col(dimension) != ""))
    return found.select(dimension).distinct().orderBy(dimension).limit(clamp(limit, 1000, MAX_DISTINCT))


def all_distinct(spans: DataFrame, dimension: str, span: TimeRange | None = None) -> DataFrame:
    """All values; raises TooManyValues at MAX_DISTINCT."""
    if dimension not in ("model", "team", "agent"):
        raise UnsupportedGroup(dimension)
    found = spans.filter(in_range(span) & (F.col(dimension) != "")).select(dimension).distinct()
    if found.limit(MAX_DISTINCT).count() >= MAX_DISTINCT:
        raise TooManyValues(dimension)
    return found.orderBy(dimension)


def percentiles(spans: DataFrame, by: str = "model", at: tuple[float, ...] = (0.5, 0.95, 0.99), span: TimeRange | None = None, accuracy: int = 10_000) -> DataFrame:
    """Extension: approximate latency percentiles by a dimension."""
    return spans.filter(in_range(span)).groupBy(by).agg(F.percentile_approx("latency_ms", [float(p) for p in at], accuracy).alias("latency_ms"))
