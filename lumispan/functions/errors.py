"""Exceptions of the span store and its queries."""


class SpanError(Exception):
    """Base of all errors raised here."""


class NotFound(SpanError):
    """No live span or trace with that id."""


class InvalidSpan(SpanError):
    """A span breaks a rule."""


class ValidationError(InvalidSpan):
    """The first rule that a span breaks."""

    def __init__(self, field: str, reason: str):
        super().__init__(f"{field}: {reason}")
        self.field, self.reason = field, reason


class InvalidCursor(SpanError):
    """A page cursor that no page has given out."""


class Closed(SpanError):
    """The store is closed."""


class UnsupportedWindow(SpanError):
    """A rollup window other than 1m, 5m, 1h and 1d."""


class UnsupportedGroup(SpanError):
    """Costs are grouped by model or team only."""


class InvalidOtlp(SpanError):
    """A request that is not OTLP/JSON; none of it is stored."""


class TooLarge(SpanError):
    """A request beyond the size limit; none of it is stored."""


class Ended(SpanError):
    """The traced span has been ended before."""


class TooManyValues(SpanError):
    """An unlimited distinct listing met too many values."""


class Conflict(SpanError):
    """Another writer committed first; the operation can be tried again."""
