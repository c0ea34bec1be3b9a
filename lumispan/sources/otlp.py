"""OTLP/JSON trace requests as spans, in column expressions.

A request whose lists and objects are not where they belong is a problem as a whole, none of its spans
is read. Differences from a strict decoder: field names match case-sensitively; in frames of requests,
scalars of another type are read as text (``decodable`` is strict, for single requests). A NaN or
infinite cost is rejected by validation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import PUBLIC, fill
from ..functions.validation import validate

MAX_BYTES = 16 << 20
# Attribute keys, in order of priority.
MODEL_KEYS = ["gen_ai.response.model", "gen_ai.request.model"]
TOKENS_IN_KEYS = ["gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens"]
TOKENS_OUT_KEYS = ["gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens"]
AGENT_KEYS = ["gen_ai.agent.id", "gen_ai.agent.name"]
TOOL_KEYS = ["gen_ai.tool.name"]
TEAM_KEYS = ["wisp.team"]
RESOURCE_TEAM_KEYS = ["wisp.team", "service.namespace"]
COST_KEYS = ["wisp.cost_usd"]
CONSUMED = MODEL_KEYS + TOKENS_IN_KEYS + TOKENS_OUT_KEYS + AGENT_KEYS + TOOL_KEYS + TEAM_KEYS + COST_KEYS

_ATTRIBUTES = "array<struct<key:string, value:struct<stringValue:string, intValue:string, doubleValue:string, boolValue:string, arrayValue:string, kvlistValue:string>>>"
_SPAN = f"struct<traceId:string, spanId:string, parentSpanId:string, name:string, startTimeUnixNano:string, endTimeUnixNano:string, attributes:{_ATTRIBUTES}, status:struct<code:string, message:string>>"
REQUEST = f"resourceSpans array<struct<resource:struct<attributes:{_ATTRIBUTES}>, scopeSpans:array<struct<spans:array<{_SPAN}>>>>>, _corrupt string"


def _attribute(attributes: Column, key: str) -> Column:
    """The value of the last attribute of a key, or null."""
    return F.try_element_at(F.filter(attributes, lambda a: a["key"] == key), F.lit(-1))["value"]


def _integer(text: Column) -> Column:
    """A whole number that may be written as a float; null if it is neither."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def _nanos(text: Column) -> Column:
    return F.when(text.isNull() | (text == ""), F.lit(0).cast("bigint")).otherwise(_integer(text))


def _first(values: dict[str, Column], keys: list[str], read) -> Column:
    return F.coalesce(*(read(values[k]) for k in keys))


def _as_string(v: Column) -> Column:
    return F.nullif(F.coalesce(v["stringValue"], v["intValue"]), F.lit(""))


def _as_integer(v: Column) -> Column:
    whole = v["doubleValue"].try_cast("double").try_cast("bigint")
    return F.when(v["intValue"].isNotNull(), _nanos(v["intValue"])).when(v["doubleValue"].isNotNull(), whole).otherwise(v["stringValue"].try_cast("bigint"))


def _as_double(v: Column) -> Column:
    return F.when(v["doubleValue"].isNotNull(), v["doubleValue"].try_cast("double")).when(v["intValue"].isNotNull(), _nanos(v["intValue"]).cast("double")).otherwise(v["stringValue"].try_cast("double"))


def _tokens(n: Column) -> Column:
    """Clamped to 32 bits; a negative count becomes -1, which validation rejects."""
    return F.coalesce(F.when(n < 0, F.lit(-1)).when(n > 2147483647, F.lit(2147483647)).otherwise(n), F.lit(0)).cast("int")


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def _json_value(v: Column) -> Column:
    number = _integer(v["intValue"])
    return (
        F.when(v["stringValue"].isNotNull(), _quoted(v["stringValue"]))
        .when(v["intValue"].isNotNull(), F.coalesce(number.cast("string"), _quoted(v["intValue"])))
        .when(v["doubleValue"].isNotNull(), F.when(v["doubleValue"].rlike(r"^-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][-+]?[0-9]+)?$"), v["doubleValue"]).otherwise(_quoted(v["doubleValue"])))
        .when(v["boolValue"].isNotNull(), F.when(v["boolValue"].isin("true", "false"), v["boolValue"]).otherwise(_quoted(v["boolValue"])))
        .otherwise(F.coalesce(v["arrayValue"], v["kvlistValue"], F.lit("null")))
    )


def free_attributes(attributes: Column) -> Column:
    """(k, i, value) of the attributes that have no column of their own, sorted by key and position."""
    free = F.filter(attributes, lambda a: ~F.coalesce(a["key"], F.lit("")).isin(*CONSUMED))
    return F.sort_array(F.transform(free, lambda a, i: F.struct(F.coalesce(a["key"], F.lit("")).alias("k"), i.alias("i"), _json_value(a["value"]).alias("v"))))


def payload(name: Column, message: Column, free: Column) -> Column:
    """{name, status_message, attributes} as JSON, without empty parts; null if all are empty. Valid by construction.

    ``free``: a column with ``free_attributes``; of equal keys, which are neighbours there, the last one counts.
    """
    last = F.filter(free, lambda e, i: ~F.get(free, i + 1)["k"].eqNullSafe(e["k"]))
    items = F.transform(last, lambda e: F.concat(_quoted(e["k"]), F.lit(":"), F.coalesce(e["v"], F.lit("null"))))
    part = lambda key, text: F.concat(F.lit(f'"{key}":'), text)
    parts = F.array_compact(
        F.array(
            F.when(F.size(items) > 0, part("attributes", F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}")))),
            F.when(name != "", part("name", _quoted(name))),
            F.when(message != "", part("status_message", _quoted(message))),
        )
    )
    return F.when(F.size(parts) > 0, F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))


def parse(requests: DataFrame, body: str = "body") -> DataFrame:
    """``requests`` with ``request`` (parsed) and ``problem``: ``too large``, ``invalid`` or null."""
    read = F.from_json(F.col(body), REQUEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = requests.withColumn("_big", F.octet_length(body) > MAX_BYTES).withColumn("request", F.when(~F.col("_big"), read))
    problem = F.when(F.col("_big"), "too large").when(F.col("request").isNull() | F.col("request._corrupt").isNotNull(), "invalid")
    return out.withColumn("problem", problem).drop("_big")


def decodable(request) -> bool:
    """Whether a parsed request has strings, numbers, lists and objects where they belong; anything may be missing or null."""
    text = lambda *keys: lambda d: all(d.get(k) is None or isinstance(d[k], str) for k in keys)

    def value(v: dict) -> bool:
        number, flag = v.get("doubleValue"), v.get("boolValue")
        return text("stringValue")(v) and (number is None or isinstance(number, (int, float)) and not isinstance(number, bool)) and (flag is None or isinstance(flag, bool))

    def objects(v, each) -> bool:
        return v is None or isinstance(v, list) and all(x is None or isinstance(x, dict) and each(x) for x in v)

    def one(v, each) -> bool:
        return v is None or isinstance(v, dict) and each(v)

    attributes = lambda v: objects(v, lambda a: text("key")(a) and one(a.get("value"), value))
    span = lambda s: text("traceId", "spanId", "parentSpanId", "name")(s) and attributes(s.get("attributes")) and one(s.get("status"), text("message"))
    scope = lambda s: objects(s.get("spans"), span)
    resource = lambda r: one(r.get("resource"), lambda x: attributes(x.get("attributes"))) and objects(r.get("scopeSpans"), scope)
    return one(request, lambda r: objects(r.get("resourceSpans"), resource)) and request is not None


def _once(made: list[str]) -> Column:
    """The columns ``made``, through a generator. Filters move below projections and compute again what they read, but not below a generator."""
    return F.inline(F.array(F.struct(*made)))


def problems_of(requests: DataFrame, body: str = "body") -> DataFrame:
    """The requests of which nothing is read, without their bodies, and ``problem``."""
    kept = [c for c in requests.columns if c != body]
    return parse(requests, body).select(*kept, _once(["problem"])).filter("problem is not null")


def rejections_of(requests: DataFrame, body: str = "body") -> DataFrame:
    """Everything that is not stored: (the request's other columns, index, field, reason); a whole request has no index and field ``request``."""
    kept = [c for c in requests.columns if c != body]
    return checked(requests, body).filter("error is not null").select(*kept, "index", "error.field", "error.reason")


def spans_of(requests: DataFrame, body: str = "body") -> DataFrame:
    """All spans of whole requests (others are in ``problems_of``), with the request's other columns, ``index`` (request order) and ``error`` (first broken rule or null)."""
    return checked(requests, body).filter("index is not null")


def checked(requests: DataFrame, body: str = "body") -> DataFrame:
    """``spans_of`` in one pass, and a row without index for each request that has none; its ``error`` has field ``request`` and the problem, if there is one.

    Each layer computes its columns once: a body is parsed once, an attribute looked up once.
    """
    kept = [c for c in requests.columns if c != body]
    nested = F.flatten(F.transform(F.coalesce("request.resourceSpans", F.array().cast(f"array<struct<resource:struct<attributes:{_ATTRIBUTES}>, scopeSpans:array<struct<spans:array<{_SPAN}>>>>>")), lambda r: F.transform(F.flatten(F.transform(r["scopeSpans"], lambda s: F.coalesce(s["spans"], F.array().cast(f"array<{_SPAN}>")))), lambda s: F.struct(r["resource"]["attributes"].alias("resource"), s.alias("s")))))
    # outer, as the optimizer would compute the list of an inner one before, to skip empty ones
    rows = parse(requests, body).select(*kept, "problem", F.posexplode_outer(F.when(F.col("problem").isNull(), nested)).alias("index", "x"))
    rows = rows.select(*kept, "problem", F.col("index").cast("long").alias("index"), "x.resource", "x.s.*")
    none = F.array().cast(_ATTRIBUTES)
    rows = rows.withColumns({"attributes": F.coalesce("attributes", none), "resource": F.coalesce("resource", none), "t0": _nanos(F.col("startTimeUnixNano")), "t1": _nanos(F.col("endTimeUnixNano"))})
    # few attributes are left for the lookups, and the others are sorted once
    rows = rows.withColumns({"known": F.filter("attributes", lambda a: a["key"].isin(*CONSUMED)), "free": free_attributes(F.col("attributes"))})
    own, shared = {k: f"_own{i}" for i, k in enumerate(CONSUMED)}, {k: f"_shared{i}" for i, k in enumerate(RESOURCE_TEAM_KEYS)}
    rows = rows.withColumns({c: _attribute(F.col("known"), k) for k, c in own.items()} | {c: _attribute(F.col("resource"), k) for k, c in shared.items()})
    a, resource, code = {k: F.col(c) for k, c in own.items()}, {k: F.col(c) for k, c in shared.items()}, F.upper(F.trim(F.coalesce("status.code", F.lit(""))))
    mapped = rows.select(
        *kept,
        "problem",
        "index",
        F.coalesce("traceId", F.lit("")).alias("trace_id"),
        F.coalesce("spanId", F.lit("")).alias("span_id"),
        F.coalesce("parentSpanId", F.lit("")).alias("parent_span_id"),
        F.coalesce("t0", F.lit(0)).alias("start_ns"),
        F.when((F.col("t1") > F.col("t0")) & (F.col("t0") > 0), F.expr("(t1 - t0) div 1000000")).otherwise(F.lit(0)).cast("long").alias("latency_ms"),
        _first(a, AGENT_KEYS, _as_string).alias("agent"),
        _first(a, MODEL_KEYS, _as_string).alias("model"),
        _first(a, TOOL_KEYS, _as_string).alias("tool"),
        F.coalesce(_first(a, TEAM_KEYS, _as_string), _first(resource, RESOURCE_TEAM_KEYS, _as_string)).alias("team"),
        F.when((code == "1") | code.endswith("OK"), "ok").when((code == "2") | code.endswith("ERROR"), "error").otherwise("unset").alias("status"),
        _tokens(_first(a, TOKENS_IN_KEYS, _as_integer)).alias("tokens_in"),
        _tokens(_first(a, TOKENS_OUT_KEYS, _as_integer)).alias("tokens_out"),
        _first(a, COST_KEYS, _as_double).alias("cost_usd"),
        payload(F.coalesce("name", F.lit("")), F.coalesce("status.message", F.lit("")), F.col("free")).alias("payload"),
        F.coalesce(*(F.when(F.col(c).isNull(), F.struct(F.lit(f).alias("field"), F.lit("is no whole number").alias("reason"))) for c, f in (("t0", "startTimeUnixNano"), ("t1", "endTimeUnixNano")))).alias("unread"),
    )
    made = fill(mapped).select(*kept, "problem", "index", _once([*PUBLIC, "unread"]))
    whole = F.when(F.col("problem").isNotNull(), F.struct(F.lit("request").alias("field"), F.col("problem").alias("reason")))
    out = validate(made, built_payload=True)
    return out.withColumn("error", F.when(F.col("index").isNull(), whole).otherwise(F.coalesce("unread", "error"))).select(*kept, "index", *PUBLIC, "error")
