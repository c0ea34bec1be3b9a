"""Validation as one expression: the first broken rule, or null."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of a span.
MAX_STRING_BYTES = 256
MAX_PAYLOAD_BYTES = 65536
FIRST_NS = 946_684_800_000_000_000
BEYOND_NS = 4_102_444_800_000_000_000


def valid_json(text: str) -> bool:
    """Strict JSON, with numbers of any length."""

    def refuse(name):
        raise ValueError(name)

    try:
        json.loads(text, parse_constant=refuse, parse_int=str, parse_float=str)
    except (ValueError, RecursionError):
        return False
    return True


def _payload_ok(unread: Column) -> Column:
    """Whether the payloads of rows that are ``unread`` are JSON; only those reach Python, each distinct text of a batch once."""

    @F.pandas_udf("boolean")
    def ok(texts):
        known = {t: valid_json(t) for t in texts.dropna().unique()}
        return texts.map(known).fillna(True).astype(bool)

    return ok(F.when(unread, F.col("payload")))


def broken_rule(duration_ns: str | None = None) -> Column:
    """struct(field, reason) of the first broken rule, or null, over the columns of ``fill``.

    ``duration_ns``: a column with the exact duration, if there is one; a negative part of a
    millisecond counts. JSON is parsed in Python, at ingest only, after all other rules.
    """
    bad = lambda when, field, reason: F.when(when, F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason")))
    long = [("TraceID", "trace_id"), ("SpanID", "span_id"), ("ParentSpanID", "parent_span_id"), ("Agent", "agent"), ("Model", "model"), ("Tool", "tool"), ("Team", "team"), ("Status", "status")]
    cost = F.col("cost_usd")
    return F.coalesce(
        bad(F.col("trace_id") == "", "TraceID", "is empty"),
        bad(F.col("span_id") == "", "SpanID", "is empty"),
        *(bad(F.octet_length(c) > MAX_STRING_BYTES, name, f"has more than {MAX_STRING_BYTES} bytes") for name, c in long),
        bad((F.col("start_ns") < FIRST_NS) | (F.col("start_ns") >= BEYOND_NS), "Start", "is outside of the years 2000 to 2099"),
        bad(F.col(duration_ns or "latency_ms") < 0, "Duration", "is negative"),
        bad((F.col("tokens_in") < 0) | (F.col("tokens_out") < 0), "Tokens", "is negative"),
        bad((cost < 0) | F.isnan(cost) | (cost == F.lit(float("inf"))), "CostUSD", "is negative or not finite"),
        bad(F.octet_length("payload") > MAX_PAYLOAD_BYTES, "Payload", f"has more than {MAX_PAYLOAD_BYTES} bytes"),
    )


def validate(df: DataFrame, duration_ns: str | None = None, built_payload: bool = False) -> DataFrame:
    """``df`` with ``error``: struct(field, reason) or null. A payload built by this library needs no parsing."""
    first = df.withColumn("error", broken_rule(duration_ns))
    if built_payload:
        return first
    unread = F.col("error").isNull() & F.col("payload").isNotNull() & (F.col("payload") != "")
    checked = first.withColumn("_json", _payload_ok(unread))
    return checked.withColumn("error", F.coalesce("error", F.when(~F.col("_json"), F.struct(F.lit("Payload").alias("field"), F.lit("is no JSON").alias("reason"))))).drop("_json")


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows without ``error``, rejections with all columns)."""
    return validated.filter("error is null").drop("error"), validated.filter("error is not null")


def first_broken(span: dict) -> tuple[str, str] | None:
    """(field, reason) of the first rule that one span breaks, without a Spark job; the rules of ``validate``."""
    long = (("TraceID", "trace_id"), ("SpanID", "span_id"), ("ParentSpanID", "parent_span_id"), ("Agent", "agent"), ("Model", "model"), ("Tool", "tool"), ("Team", "team"), ("Status", "status"))
    size = lambda k: len((span.get(k) or "").encode())
    cost, payload = span.get("cost_usd") or 0.0, span.get("payload") or ""
    for field, key in long[:2]:
        if not span.get(key):
            return field, "is empty"
    for field, key in long:
        if size(key) > MAX_STRING_BYTES:
            return field, f"has more than {MAX_STRING_BYTES} bytes"
    if not FIRST_NS <= (span.get("start_ns") or 0) < BEYOND_NS:
        return "Start", "is outside of the years 2000 to 2099"
    if (span.get("duration_ns", span.get("latency_ms")) or 0) < 0:
        return "Duration", "is negative"
    if (span.get("tokens_in") or 0) < 0 or (span.get("tokens_out") or 0) < 0:
        return "Tokens", "is negative"
    if not 0 <= cost < math.inf:
        return "CostUSD", "is negative or not finite"
    if size("payload") > MAX_PAYLOAD_BYTES:
        return "Payload", f"has more than {MAX_PAYLOAD_BYTES} bytes"
    return None if not payload or valid_json(payload) else ("Payload", "is no JSON")
