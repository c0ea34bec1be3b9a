"""A tracer for Python code: nested spans, kept in a context variable and ingested when they end."""

from __future__ import annotations

import json
import secrets
import time
from contextvars import ContextVar

from ..functions.errors import Ended, ValidationError

_current: ContextVar[ActiveSpan | None] = ContextVar("lumispan_active_span", default=None)


def new_trace_id() -> str:
    return secrets.token_hex(16)


def new_span_id() -> str:
    return secrets.token_hex(8)


def current_span() -> ActiveSpan | None:
    return _current.get()


class ActiveSpan:
    """A span that has started. As a context manager it is current within, ends on leaving, and takes exceptions as errors."""

    def __init__(self, store, name: str, trace_id: str = "", parent_span_id: str = "", start_ns: int | None = None):
        parent = current_span()
        self.store, self.name = store, name
        self.trace_id = trace_id or (parent.trace_id if parent else new_trace_id())
        self.parent_span_id = parent_span_id or (parent.span_id if parent and parent.trace_id == self.trace_id else "")
        self.span_id = new_span_id()
        self.start_ns = time.time_ns() if start_ns is None else start_ns
        self.fields: dict = {}
        self.attributes: dict = {}
        self.message, self.ended, self._token = "", False, None

    def set_agent(self, v: str) -> None:
        self.fields["agent"] = v

    def set_model(self, v: str) -> None:
        self.fields["model"] = v

    def set_tool(self, v: str) -> None:
        self.fields["tool"] = v

    def set_team(self, v: str) -> None:
        self.fields["team"] = v

    def set_tokens(self, tokens_in: int, tokens_out: int) -> None:
        self.fields |= {"tokens_in": tokens_in, "tokens_out": tokens_out}

    def set_cost(self, usd: float) -> None:
        self.fields["cost_usd"] = usd

    def set_status(self, v: str) -> None:
        self.fields["status"] = v

    def set_error(self, error: BaseException | str | None) -> None:
        if error is not None:
            self.fields["status"], self.message = "error", str(error)

    def set_attribute(self, key: str, value) -> None:
        self.attributes[key] = value

    def end(self, end_ns: int | None = None) -> None:
        """Ingest the span. A second end raises Ended; an end that failed can be tried again."""
        if self.ended:
            raise Ended(self.span_id)
        parts = {"name": self.name, "status_message": self.message, "attributes": self.attributes}
        try:
            payload = json.dumps({k: v for k, v in parts.items() if v}, allow_nan=False)
        except (TypeError, ValueError) as e:
            raise ValidationError("payload", str(e)) from e
        stop = time.time_ns() if end_ns is None else end_ns
        self.store.ingest({"trace_id": self.trace_id, "span_id": self.span_id, "parent_span_id": self.parent_span_id, "start_ns": self.start_ns, "duration_ns": max(0, stop - self.start_ns), "status": "ok", "payload": None if payload == "{}" else payload} | self.fields)
        self.ended = True

    def __enter__(self) -> ActiveSpan:
        self._token = _current.set(self)
        return self

    def __exit__(self, kind, error, trace) -> None:
        _current.reset(self._token)
        self.set_error(error)
        if not self.ended:
            self.end()


def start_span(store, name: str, trace_id: str = "", parent_span_id: str = "", start_ns: int | None = None) -> ActiveSpan:
    return ActiveSpan(store, name, trace_id, parent_span_id, start_ns)
