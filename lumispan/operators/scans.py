"""Lookups, filtered scans, pages and listings over live spans. All are lazy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.errors import InvalidCursor
from ..functions.predicates import SpanFilter, TimeRange, clamp, failed, in_range


def order(newest_first: bool = False) -> list[Column]:
    """The total order of spans. Newest first turns only the time around."""
    start = F.col("start_ns")
    return [start.desc() if newest_first else start.asc(), F.col("trace_id").asc(), F.col("span_id").asc()]


def span_lookup(spans: DataFrame, trace_id: str, span_id: str) -> DataFrame:
    return spans.filter((F.col("trace_id") == trace_id) & (F.col("span_id") == span_id)).limit(1)


def trace_lookup(spans: DataFrame, trace_id: str) -> DataFrame:
    return spans.filter(F.col("trace_id") == trace_id).orderBy(*order())


def matching(spans: DataFrame, where: SpanFilter) -> DataFrame:
    return spans.filter(where.column())


def parse_cursor(cursor: str) -> int:
    """The offset of a cursor; an empty one is the first page."""
    if cursor == "":
        return 0
    digits = cursor[1:] if cursor[:1] == "+" else cursor
    if not (digits.isascii() and digits.isdigit()) or int(digits) >= 1 << 31:
        raise InvalidCursor(cursor)
    return int(digits)


def page(spans: DataFrame, where: SpanFilter, limit: int = 0, cursor: str = "", newest_first: bool = False) -> DataFrame:
    """One row more than the page holds, if there is a next page: see ``cut_page``."""
    offset, n = parse_cursor(cursor), clamp(limit)
    return matching(spans, where).orderBy(*order(newest_first)).limit(offset + n + 1).offset(offset)


def cut_page(rows: list, limit: int = 0, cursor: str = "") -> tuple[list, str]:
    """(the page's rows, the next cursor or an empty string)."""
    n = clamp(limit)
    return rows[:n], str(parse_cursor(cursor) + n) if len(rows) > n else ""


def page_after(spans: DataFrame, where: SpanFilter, after: tuple[int, str, str] | None, limit: int = 0, newest_first: bool = False) -> DataFrame:
    """Extension: keyset paging after a span's (start_ns, trace_id, span_id), stable under inserts and cheap on deep pages."""
    found = matching(spans, where)
    if after:
        start, trace, span = after
        later = F.col("start_ns") < start if newest_first else F.col("start_ns") > start
        ids = (F.col("trace_id") > trace) | ((F.col("trace_id") == trace) & (F.col("span_id") > span))
        found = found.filter(later | ((F.col("start_ns") == start) & ids))
    return found.orderBy(*order(newest_first)).limit(clamp(limit))


def traces(spans: DataFrame, where: SpanFilter, limit: int | None = 0, newest_first: bool = False) -> DataFrame:
    """Distinct trace ids in the order of their first matching span; ``limit`` None lists all."""
    found = matching(spans, where)
    if newest_first:
        out = found.groupBy("trace_id").agg(F.max("start_ns").alias("first")).orderBy(F.col("first").desc(), "trace_id")
    else:
        out = found.groupBy("trace_id").agg(F.min(F.struct("start_ns", "trace_id", "span_id")).alias("first")).orderBy("first")
    return (out if limit is None else out.limit(clamp(limit))).select("trace_id")


def failed_spans(spans: DataFrame, span: TimeRange | None = None, limit: int | None = 0) -> DataFrame:
    """Failed spans, newest first; ``limit`` None gives all, in no order."""
    found = spans.filter(in_range(span) & failed())
    return found if limit is None else found.orderBy(*order(True)).limit(clamp(limit))
