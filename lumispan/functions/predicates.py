"""Time ranges and filters, as column expressions that reach the Parquet scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_NS = (1 << 63) - 1
#: Statuses, lower-cased, that are not failures.
NOT_FAILED = ("", "ok", "success", "unset")


@dataclass(frozen=True)
class TimeRange:
    """A closed range of start times; a bound of 0 or None is open."""

    start_ns: int | None = 0
    end_ns: int | None = None

    def bounds(self) -> tuple[int, int]:
        return self.start_ns or 0, self.end_ns or MAX_NS

    @staticmethod
    def last(seconds: float, now_ns: int | None = None) -> TimeRange:
        import time

        now = time.time_ns() if now_ns is None else now_ns
        return TimeRange(now - int(seconds * 1_000_000_000), now)


def in_range(span: TimeRange | None) -> Column:
    low, high = (span or TimeRange()).bounds()
    return F.col("start_ns").between(F.lit(low), F.lit(high))


@dataclass(frozen=True)
class SpanFilter:
    """All given conditions hold; an empty string is no condition. Equality is exact and case-sensitive."""

    range: TimeRange | None = None
    agent: str = ""
    model: str = ""
    tool: str = ""
    team: str = ""
    status: str = ""

    def column(self) -> Column:
        wanted = {k: getattr(self, k) for k in ("agent", "model", "tool", "team", "status")}
        return reduce(lambda a, b: a & b, [in_range(self.range), *(F.col(k) == F.lit(v) for k, v in wanted.items() if v)])


def failed() -> Column:
    """Whether a status, in any case, is a failure."""
    return ~F.lower("status").isin(*NOT_FAILED)


def clamp(limit: int, default: int = 100, most: int = 1000) -> int:
    return default if limit <= 0 else min(limit, most)
