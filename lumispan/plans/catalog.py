"""Registered queries over the driver's tables, and their SQL oracles.

Each entry is a pair: a function of (spark, folder of tables) and DuckDB SQL with the same columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import SpanFilter, TimeRange, in_range
from ..functions.schema import SPAN_SCHEMA, fill
from ..functions.validation import split, validate
from ..operators import aggregates, live, rollups, scans
from ..sources import otlp
from ..sources.files import shared_folder
from ..sources.store import SpanStore
from . import maintenance
from .views import FROM_NS, KEY, SEQUENCE, SPLIT, TO_NS, lineitem_log, read, span_cte, spans

RANGE = TimeRange(FROM_NS, TO_NS)
IN_RANGE = f"start_ns between {FROM_NS} and {TO_NS}"
FAILED = "lower(status) not in ('', 'ok', 'success', 'unset')"
COLUMNS = ["trace_id", "span_id", "start_ns", "latency_ms", "agent", "model", "tool", "team", "status", "tokens_in", "tokens_out", "cost_usd"]
SHOWN = ", ".join(COLUMNS)
ORDER = "start_ns, trace_id, span_id"
NEWEST = "start_ns desc, trace_id, span_id"

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str) -> None:
    _QUERIES[name], _ORACLES[name] = query, sql


def _on_spans(name: str, query, sql: str) -> None:
    _add(name, lambda spark, d, q=query: q(spans(spark, d)), f"with {span_cte()} {sql}")


def _rounded(df: DataFrame, column: str = "cost_usd") -> DataFrame:
    """Sums of doubles differ in their last bits between partitionings."""
    return df.withColumn(column, F.round(column, 6))


# -- scans and lookups

for _name, _where, _sql in (
    ("range_time", SpanFilter(RANGE), IN_RANGE),
    ("range_query", SpanFilter(TimeRange(FROM_NS)), f"start_ns >= {FROM_NS}"),
    ("range_all_dims", SpanFilter(RANGE, agent="agent-8", model="model-3", tool="error", team="team-1", status="ERROR"), f"{IN_RANGE} and agent = 'agent-8' and model = 'model-3' and tool = 'error' and team = 'team-1' and status = 'ERROR'"),
    ("query_by_agent", SpanFilter(RANGE, agent="agent-3"), f"{IN_RANGE} and agent = 'agent-3'"),
    ("query_by_model", SpanFilter(RANGE, model="model-2"), f"{IN_RANGE} and model = 'model-2'"),
    ("query_by_tool", SpanFilter(RANGE, tool="purchase"), f"{IN_RANGE} and tool = 'purchase'"),
    ("query_by_team", SpanFilter(RANGE, team="team-4"), f"{IN_RANGE} and team = 'team-4'"),
    ("query_by_status", SpanFilter(RANGE, status="OK"), f"{IN_RANGE} and status = 'OK'"),
    ("query_status_case", SpanFilter(RANGE, status="ok"), f"{IN_RANGE} and status = 'ok'"),
):
    _on_spans(_name, lambda sp, w=_where: scans.matching(sp, w).select(*COLUMNS), f"select {SHOWN} from sp where {_sql}")

_on_spans("get_span", lambda sp: scans.span_lookup(sp, "t8", "s0").select(*COLUMNS), f"select {SHOWN} from sp where trace_id = 't8' and span_id = 's0'")
_on_spans("get_trace", lambda sp: scans.trace_lookup(sp, "t8").select(*COLUMNS), f"select {SHOWN} from sp where trace_id = 't8' order by {ORDER}")
# the row beyond the page tells whether there is a next one
_on_spans("query_page1", lambda sp: scans.page(sp, SpanFilter(RANGE, model="model-1"), 50).select(*COLUMNS), f"select {SHOWN} from sp where {IN_RANGE} and model = 'model-1' order by {ORDER} limit 51")
_on_spans("query_page2", lambda sp: scans.page(sp, SpanFilter(RANGE, model="model-1"), 50, "50").select(*COLUMNS), f"select {SHOWN} from sp where {IN_RANGE} and model = 'model-1' order by {ORDER} limit 51 offset 50")
_on_spans("query_past_end", lambda sp: scans.page(sp, SpanFilter(RANGE), 50, "2000000000").select(*COLUMNS), f"select {SHOWN} from sp where false")
_on_spans("query_newest", lambda sp: scans.page(sp, SpanFilter(RANGE), 0, "", True).select(*COLUMNS), f"select {SHOWN} from sp where {IN_RANGE} order by {NEWEST} limit 101")
_on_spans("query_keyset", lambda sp: scans.page_after(sp, SpanFilter(), (FROM_NS, "", ""), 50).select(*COLUMNS), f"select {SHOWN} from sp where start_ns >= {FROM_NS} order by {ORDER} limit 50")
_on_spans("traces", lambda sp: scans.traces(sp, SpanFilter(RANGE), 20), f"select trace_id from (select trace_id, min(start_ns) f, min(span_id) s from sp where {IN_RANGE} group by 1) order by f, trace_id limit 20")
_on_spans("traces_newest", lambda sp: scans.traces(sp, SpanFilter(RANGE), 20, True), f"select trace_id from (select trace_id, max(start_ns) f from sp where {IN_RANGE} group by 1) order by f desc, trace_id limit 20")
_on_spans("list_traces_all", lambda sp: scans.traces(sp, SpanFilter(RANGE, team="team-2"), None), f"select distinct trace_id from sp where {IN_RANGE} and team = 'team-2'")
_on_spans("failed_spans", lambda sp: scans.failed_spans(sp, RANGE, 50).select(*COLUMNS), f"select {SHOWN} from sp where {IN_RANGE} and {FAILED} order by {NEWEST} limit 50")
_on_spans("failed_all", lambda sp: scans.failed_spans(sp, RANGE, None).select(*COLUMNS), f"select {SHOWN} from sp where {IN_RANGE} and {FAILED}")

# -- totals, rankings, listings

for _by in ("model", "team"):
    _on_spans(f"cost_by_{_by}", lambda sp, by=_by: _rounded(aggregates.costs(sp, by, RANGE)), f"select {_by}, round(sum(cost_usd), 6) cost_usd from sp where {IN_RANGE} and {_by} <> '' group by 1")
_on_spans("tokens_by_model", lambda sp: aggregates.tokens_by_model(sp, RANGE), f"select model, sum(tokens_in)::bigint tokens_in, sum(tokens_out)::bigint tokens_out, sum(tokens_in::bigint + tokens_out)::bigint tokens_total from sp where {IN_RANGE} and model <> '' group by 1")
_on_spans("top_teams_by_cost", lambda sp: _rounded(aggregates.top_teams_by_cost(sp, 3, RANGE)), f"select team, round(sum(cost_usd), 6) cost_usd from sp where {IN_RANGE} and team <> '' group by 1 order by sum(cost_usd) desc, team limit 3")
_on_spans("top_models_by_spans", lambda sp: aggregates.top_models_by_spans(sp, 3, RANGE), f"select model, count(*) spans from sp where {IN_RANGE} and model <> '' group by 1 order by 2 desc, 1 limit 3")
_on_spans("error_rate_all", lambda sp: _rounded(aggregates.error_rate(sp, "", RANGE), "error_rate"), f"select round(coalesce(avg(case when {FAILED} then 1.0::double else 0.0::double end), 0.0::double), 6) error_rate from sp where {IN_RANGE}")
_on_spans("error_rate_model", lambda sp: _rounded(aggregates.error_rate(sp, "model-1", RANGE), "error_rate"), f"select round(coalesce(avg(case when {FAILED} then 1.0::double else 0.0::double end), 0.0::double), 6) error_rate from sp where {IN_RANGE} and model = 'model-1'")
_on_spans("error_rate_none", lambda sp: aggregates.error_rate(sp, "no-such-model", RANGE), "select 0.0::double error_rate")
for _dim in ("model", "team", "agent"):
    _on_spans(f"distinct_{_dim}s", lambda sp, d=_dim: aggregates.distinct_values(sp, d, RANGE, 5), f"select distinct {_dim} from sp where {IN_RANGE} and {_dim} <> '' order by 1 limit 5")

# -- rollups, over the append log


def _bucket_sql(window: str, source: str = "sp", where: str = "true") -> str:
    size = rollups.WINDOWS[window]
    return f"""select start_ns - start_ns % {size} window_start_ns, model, count(*) spans, sum(round(cost_usd * 1e6)::bigint)::bigint / 1e6 cost_usd,
      sum(tokens_in)::bigint tokens_in, sum(tokens_out)::bigint tokens_out, (sum(latency_ms) // count(*))::bigint latency_avg_ms,
      min(latency_ms) latency_min_ms, max(latency_ms) latency_max_ms from {source} where {where} group by 1, 2"""


for _w in rollups.WINDOWS:
    _on_spans(f"rollup_{_w}", lambda sp, w=_w: rollups.rollup(sp, w), _bucket_sql(_w))
_HALF = TimeRange(FROM_NS + 1_800_000_000_000, TO_NS - 1_800_000_000_000)
_on_spans("rollup_unaligned", lambda sp: rollups.rollup(sp, "1h", _HALF), f"select * from ({_bucket_sql('1h')}) where window_start_ns >= {_HALF.start_ns} and window_start_ns < {_HALF.end_ns}")
_on_spans("rollup_merged", lambda sp: rollups.present(rollups.within(rollups.partials(sp), "1d", RANGE)), f"select * from ({_bucket_sql('1d')}) where window_start_ns >= {FROM_NS} and window_start_ns < {TO_NS}")
_on_spans("rollup_bucket", lambda sp: rollups.present(rollups.bucket(rollups.partials(sp), "1h", FROM_NS, "model-1")), f"select * from ({_bucket_sql('1h')}) where window_start_ns = {FROM_NS} and model = 'model-1'")
_on_spans("rollup_evicted", lambda sp: rollups.present(rollups.evict(rollups.partials(sp, "1d"), FROM_NS + 1)), f"select * from ({_bucket_sql('1d')}) where window_start_ns >= {FROM_NS + 1}")


def _twice(sp: DataFrame) -> DataFrame:
    """Every third span written again, every seventh deleted."""
    again = sp.filter("cast(substring(span_id, 2) as bigint) % 3 = 0")
    gone = sp.filter("cast(substring(span_id, 2) as bigint) % 7 = 0")
    return sp.withColumn("_deleted", F.lit(False)).unionByName(again.withColumn("_deleted", F.lit(False))).unionByName(gone.withColumn("_deleted", F.lit(True)))


_on_spans("rollup_counts_duplicates", lambda sp: rollups.rollup(_twice(sp), "1d"), f", twice as (select * from sp union all select * from sp where cast(substr(span_id, 2) as bigint) % 3 = 0) {_bucket_sql('1d', 'twice')}")
_on_spans("latency_percentiles", lambda sp: aggregates.percentiles(sp, "team", (0.5,), RANGE, 1_000_000).select("team", F.col("latency_ms")[0].alias("p50")), f"select team, quantile_disc(latency_ms, 0.5) p50 from sp where {IN_RANGE} group by 1")
_on_spans("rollup_by_root", lambda sp: rollups.by_root(sp, "1d", RANGE), f""", roots as (select trace_id, arg_min(team, (start_ns, span_id)) root_team, arg_min(model, (start_ns, span_id)) root_model from sp group by 1)
  select start_ns - start_ns % 86400000000000 window_start_ns, root_team, root_model, count(*) spans, sum(round(cost_usd * 1e6)::bigint)::bigint / 1e6 cost_usd
  from sp join roots using (trace_id) where start_ns - start_ns % 86400000000000 >= {FROM_NS} and start_ns - start_ns % 86400000000000 < {TO_NS} group by 1, 2, 3""")

# -- live spans: base and log

_LAST = f"select * from (select *, row_number() over (partition by {', '.join(KEY)} order by {', '.join(f'{c} desc' for c in SEQUENCE)}) r from lineitem) where r = 1 and l_returnflag <> 'R'"
_LIVE = [*KEY, "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = lineitem_log(spark, sf_dir)
    old, new = log.filter(F.col("l_shipdate") < F.lit(SPLIT).cast("timestamp_ntz")), log.filter(F.col("l_shipdate") >= F.lit(SPLIT).cast("timestamp_ntz"))
    base = live.resolve(None, old, key=KEY, order=SEQUENCE)
    return live.resolve(base, new, key=KEY, order=SEQUENCE)


_add("live_spans", lambda s, d: _live(s, d).select(*_LIVE), f"select {', '.join(_LIVE)} from ({_LAST})")
_add("live_filtered", lambda s, d: _live(s, d).filter("l_extendedprice between 20000 and 30000").select(*_LIVE), f"select {', '.join(_LIVE)} from ({_LAST}) where l_extendedprice between 20000 and 30000")

def _written(sp: DataFrame, changes: DataFrame) -> DataFrame:
    """Live spans after ``changes`` (rows with _deleted, _batch) to a base of all spans."""
    return live.resolve(sp.select(*COLUMNS), changes.withColumn("_index", F.monotonically_increasing_id()).select(*COLUMNS, "_deleted", "_batch", "_index"))


def _deleted(sp: DataFrame, where: str, batch: int = 1) -> DataFrame:
    return sp.filter(where).withColumns({"_deleted": F.lit(True), "_batch": F.lit(batch)})


_on_spans("live_after_delete_span", lambda sp: _written(sp, _deleted(sp, "trace_id = 't8' and span_id = 's0'")), f"select {SHOWN} from sp where not (trace_id = 't8' and span_id = 's0')")
_on_spans("live_after_delete_trace", lambda sp: _written(sp, _deleted(sp, "trace_id = 't8'")), f"select {SHOWN} from sp where trace_id <> 't8'")
_on_spans("live_after_reinsert", lambda sp: _written(sp, _deleted(sp, "team = 'team-3'").unionByName(sp.filter("team = 'team-3' and tool = 'view'").withColumns({"model": F.lit("model-new"), "_deleted": F.lit(False), "_batch": F.lit(2)}))), f"select {SHOWN.replace('model,', 'case when team = ' + chr(39) + 'team-3' + chr(39) + ' then ' + chr(39) + 'model-new' + chr(39) + ' else model end model,')} from sp where team <> 'team-3' or tool = 'view'")

# -- validation

_BREAKS = {
    1: ("trace_id", "''", "TraceID", "is empty"),
    2: ("span_id", "''", "SpanID", "is empty"),
    3: ("model", "repeat('é', 129)", "Model", "has more than 256 bytes"),
    4: ("start_ns", "946684799999999999", "Start", "is outside of the years 2000 to 2099"),
    5: ("latency_ms", "-1", "Duration", "is negative"),
    6: ("tokens_in", "-1", "Tokens", "is negative"),
    7: ("cost_usd", "-0.01", "CostUSD", "is negative or not finite"),
    8: ("payload", "'{nope'", "Payload", "is no JSON"),
    9: ("cost_usd", "cast('NaN' as double)", "CostUSD", "is negative or not finite"),
}


def _broken(sp: DataFrame) -> DataFrame:
    """Each ninth of most spans breaks one rule."""
    n = F.expr("cast(substring(span_id, 2) as bigint)")
    made = {c: F.col(c) for c in sp.columns}
    for k, (column, value, *_) in _BREAKS.items():
        made[column] = F.when(n % 13 == k, F.expr(value)).otherwise(made[column])
    return validate(fill(sp.select(n.alias("index"), *(v.alias(c) for c, v in made.items()))))


_on_spans("validate_accepted", lambda sp: split(_broken(sp))[0].select("index", "trace_id", "start_ns"), "select cast(substr(span_id, 2) as bigint) \"index\", trace_id, start_ns from sp where cast(substr(span_id, 2) as bigint) % 13 not between 1 and 9")
_on_spans(
    "validate_rejections",
    lambda sp: split(_broken(sp))[1].select("index", "error.field", "error.reason"),
    "select i \"index\", " + " ".join(["case i % 13", *(f"when {k} then '{f}'" for k, (_, _, f, _) in _BREAKS.items())]) + " end field, " + " ".join(["case i % 13", *(f"when {k} then '{r}'" for k, (_, _, _, r) in _BREAKS.items())]) + " end reason from (select cast(substr(span_id, 2) as bigint) i from sp) where i % 13 between 1 and 9",
)

# -- OTLP


#: Event ids of one slice, whose events are counted together; a request has less than twice as many events.
SLICE = 8192


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as spans, in requests of less than 2 * SLICE events (ids are unique); some have an empty trace id or a start that is no number.

    ``first``: the user's events in earlier requests.
    """
    start = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") * 1000
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", start.alias("start"), F.expr(f"event_id div {SLICE}").alias("slice"))
    # only counts of slices meet in a window of their user
    counts = e.groupBy("user_id", "slice").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("user_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("user_id").alias("_user"), F.col("slice").alias("_slice"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    numbered = e.join(starts, F.col("user_id").eqNullSafe(F.col("_user")) & F.col("slice").eqNullSafe(F.col("_slice")))
    listed = numbered.groupBy("user_id", F.expr(f"first div {SLICE}").alias("request")).agg(F.min("first").alias("first"), F.sort_array(F.collect_list(F.struct("event_id", "event_type", "start"))).alias("all"))

    def span(e: Column) -> Column:
        trace = F.when(e["event_id"] % 10 == 7, "").otherwise(F.concat(F.lit("t"), F.col("user_id")))
        start = F.when(e["event_id"] % 10 == 3, "not-a-number").otherwise(e["start"].cast("string"))
        end = e["start"] + (e["event_id"] % 1000) * 1_000_000 + 999_999
        return F.concat(
            F.lit('{"traceId":"'), trace, F.lit('","spanId":"'), F.concat(F.lit("s"), e["event_id"]), F.lit('","name":"'), e["event_type"], F.lit('","startTimeUnixNano":"'), start,
            F.lit('","endTimeUnixNano":'), end.cast("string"), F.lit(',"unknown":[1],"attributes":[{"key":"gen_ai.request.model","value":{"stringValue":"model-'), (F.col("user_id") % 5).cast("string"),
            F.lit('"}},{"key":"gen_ai.usage.input_tokens","value":{"intValue":"'), (e["event_id"] % 500).cast("string"), F.lit('"}},{"key":"gen_ai.usage.completion_tokens","value":{"intValue":'), (e["event_id"] % 100).cast("string"),
            F.lit('}},{"key":"gen_ai.agent.name","value":{"stringValue":"agent-'), (F.col("user_id") % 11).cast("string"), F.lit('"}}],"status":{"code":'), F.when(e["event_type"] == "error", "2").otherwise("1"), F.lit("}}"),
        )

    # texts are made where they are read: only the columns of the events are shuffled
    head = F.concat(F.lit('{"resourceSpans":[{"resource":{"attributes":[{"key":"service.namespace","value":{"stringValue":"team-'), (F.col("user_id") % 7).cast("string"), F.lit('"}}]},"scopeSpans":[{"spans":['))
    return listed.select("user_id", "first", F.concat(head, F.array_join(F.transform("all", span), ","), F.lit("]}]}]}")).alias("body"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return otlp.spans_of(_requests(spark, sf_dir)).withColumn("index", F.col("index") + F.col("first"))


_OTLP = f"""with e as (select *, epoch_us(ts) * 1000 start, row_number() over (partition by user_id order by event_id) - 1 i from events)
"""
_add(
    "otlp_spans",
    lambda s, d: split(_spans(s, d))[0].select("user_id", "index", "trace_id", "span_id", "start_ns", "latency_ms", "agent", "model", "team", "status", "tokens_in", "tokens_out", "payload"),
    _OTLP + """select user_id, i "index", 't' || user_id trace_id, 's' || event_id span_id, start start_ns, event_id % 1000 latency_ms, 'agent-' || (user_id % 11) agent, 'model-' || (user_id % 5) model,
      'team-' || (user_id % 7) team, case when event_type = 'error' then 'error' else 'ok' end status, (event_id % 500)::int tokens_in, (event_id % 100)::int tokens_out, '{"name":"' || event_type || '"}' payload
      from e where event_id % 10 not in (3, 7)""",
)
_add(
    "otlp_rejections",
    lambda s, d: split(_spans(s, d))[1].select("user_id", "index", "error.field", "error.reason"),
    _OTLP + """select user_id, i "index", case event_id % 10 when 3 then 'startTimeUnixNano' else 'TraceID' end field, case event_id % 10 when 3 then 'is no whole number' else 'is empty' end reason
      from e where event_id % 10 in (3, 7)""",
)

# whole requests that cannot be read, and what becomes of spans in one frame with them
_SHAPES = ("'{}'", """'{"resourceSpans":5}'""", """'{"resourceSpans":[5]}'""", """'{"resourceSpans":[{"scopeSpans":[{"spans":"x"}]}]}'""", "'{nope'", "'[]'", """'{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"","spanId":"s"}]}]}]}'""", """'{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"t","spanId":"s' || cast(event_id as varchar(20)) || '","startTimeUnixNano":1704067200000000000}]}]}]}'""")
_BODY = " ".join(["case event_id % 8", *(f"when {i} then {x}" for i, x in enumerate(_SHAPES)), "end"])


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("event_id", f"{_BODY} as body")


_add("otlp_problems", lambda s, d: otlp.rejections_of(_shaped(s, d)).withColumn("index", F.coalesce("index", F.lit(-1))), """select event_id, case event_id % 8 when 6 then 0::bigint else -1 end "index", case event_id % 8 when 6 then 'TraceID' else 'request' end field,
  case event_id % 8 when 6 then 'is empty' else 'invalid' end reason from events where event_id % 8 between 1 and 6""")


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request an event, with costs, repeated keys, attributes of all kinds and token counts beyond 32 bits."""
    attributes = """concat_ws(',', '{"key":"wisp.cost_usd","value":{' || case event_id % 4 when 0 then '"doubleValue":0.25' when 1 then '"intValue":"3"' when 2 then '"stringValue":"1.5"' else '"boolValue":true' end || '}}',
      '{"key":"note","value":{"stringValue":"first"}}', '{"key":"flag","value":{"boolValue":' || case when event_id % 2 = 0 then 'true' else 'false' end || '}}',
      '{"key":"note","value":{"stringValue":"say \\\\"' || event_type || '\\\\""}}', '{"key":"ratio","value":{"doubleValue":0.5}}', '{"key":"many","value":{"arrayValue":{"values":[1,2]}}}',
      '{"key":"gen_ai.request.model","value":{"stringValue":"early"}}', '{"key":"gen_ai.request.model","value":{"stringValue":"model-' || cast(user_id % 5 as varchar(20)) || '"}}',
      '{"key":"gen_ai.response.model","value":{"stringValue":""}}', '{"key":"gen_ai.usage.prompt_tokens","value":{' || case event_id % 3 when 0 then '"intValue":"99999999999"' when 1 then '"doubleValue":7.9' else '"stringValue":"41"' end || '}}',
      '{"key":"gen_ai.usage.output_tokens","value":{"intValue":' || case when event_id % 5 = 0 then '-1' else '2' end || '}}', '{"key":"wisp.team","value":{"stringValue":"own"}}')"""
    body = f"""'{{"resourceSpans":[{{"resource":{{"attributes":[{{"key":"wisp.team","value":{{"stringValue":"shared"}}}}]}},"scopeSpans":[{{"spans":[{{"traceId":"t","spanId":"s' || cast(event_id as varchar(20)) || '","startTimeUnixNano":"1.7e18","name":"call","attributes":[' || {attributes} || ']}}]}}]}}]}}'"""
    return otlp.spans_of(read(spark, sf_dir, "events").selectExpr("event_id", f"{body} as body"))


_add(
    "otlp_costs",
    lambda s, d: _priced(s, d).select("event_id", "start_ns", "model", "team", "tokens_in", "cost_usd", "payload", F.col("error.field").alias("rejected")),
    """select event_id, 1700000000000000000::bigint start_ns, 'model-' || (user_id % 5) model, 'own' team, (case event_id % 3 when 0 then 2147483647 when 1 then 7 else 41 end)::int tokens_in,
      (case event_id % 4 when 0 then 0.25 when 1 then 3 when 2 then 1.5 else 0 end)::double cost_usd,
      '{"attributes":{"flag":' || (event_id % 2 = 0) || ',"many":{"values":[1,2]},"note":"say \\"' || event_type || '\\"","ratio":0.5},"name":"call"}' payload, case when event_id % 5 = 0 then 'Tokens' end rejected from events""",
)

# -- through a store in the shared folder: ingest, overwrite, delete, compaction, retention, check

_CUTOFF = FROM_NS + 43_200_000_000_000
_LATER = "trace_id <> 't8' and (cast(substr(span_id, 2) as bigint) % 3 <> 0 or tool <> 'view')"
_MOVED = "cast(substr(span_id, 2) as bigint) % 3 = 0 and tool = 'click'"


def _new_store(spark: SparkSession, **options) -> SpanStore:
    return SpanStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", **({"retention_days": 0} | options))


def _filled(spark: SparkSession, sf_dir: str, compact_first: bool = True) -> SpanStore:
    """All spans, then a third of the clicks again one day later with another model, a third of the views deleted, and trace t8 deleted."""
    store, sp = _new_store(spark), spans(spark, sf_dir)
    store.ingest_frame(sp)
    if compact_first:
        maintenance.compact(store)
    third = F.expr("cast(substring(span_id, 2) as bigint) % 3 = 0")
    again = sp.filter(third & (F.col("tool") == "click")).withColumns({"model": F.lit("model-new"), "start_ns": F.col("start_ns") + 86_400_000_000_000})
    store.ingest_frame(again)
    store._delete(sp.filter(third & (F.col("tool") == "view")))
    store.delete_trace("t8")
    return store


_NOW = f"""live as (select trace_id, span_id, case when {_MOVED} then start_ns + 86400000000000 else start_ns end start_ns, latency_ms, agent, case when {_MOVED} then 'model-new' else model end model, tool, team, status, tokens_in, tokens_out, cost_usd from sp where {_LATER})"""


def _through(name: str, query, sql: str) -> None:
    _add(name, query, f"with {span_cte()}, {_NOW}{'' if sql.startswith(',') else ' '}{sql}")


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    maintenance.compact(store)
    return store.spans().select(*COLUMNS)


def _partly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest two of four batches merged, the others still in the log; only the days of a range are opened."""
    store = _filled(spark, sf_dir, compact_first=False)
    maintenance.compact(store, 2)
    return store.spans(RANGE).filter(in_range(RANGE)).select(*COLUMNS)


def _expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _new_store(spark, retention_days=7, clock=lambda: _CUTOFF + 7 * 86_400_000_000_000)
    store.ingest_frame(spans(spark, sf_dir))
    maintenance.compact(store)
    maintenance.expire(store)
    return store.spans().select(*COLUMNS)


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    report = maintenance.check(store)
    store.folder.remove(store.state["log"][-1]["path"])
    damaged = maintenance.check(store)
    return spark.createDataFrame([(report.ok, report.superseded, len(damaged.errors))], "ok boolean, superseded long, errors_when_damaged long")


def _stored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _new_store(spark)
    n, bad = store.ingest_otlp_frame(_requests(spark, sf_dir).select("body"))
    counted = bad.groupBy("field").agg(F.count("*").alias("n")).unionAll(spark.createDataFrame([("accepted", n)], "field string, n long"))
    return counted.unionAll(store.spans().agg(F.lit("live").alias("field"), F.count("*").alias("n")))


_through("store_live", lambda s, d: _filled(s, d).spans().select(*COLUMNS), f"select {SHOWN} from live")
_through("compacted", _compacted, f"select {SHOWN} from live")
_through("compacted_partly", _partly, f"select {SHOWN} from live where {IN_RANGE}")
_through("store_get_trace", lambda s, d: s.createDataFrame([tuple(r[c] for c in COLUMNS) for r in _filled(s, d).trace("t9")], ", ".join(f"{f.name} {f.dataType.simpleString()}" for c in COLUMNS for f in SPAN_SCHEMA if f.name == c)), f"select {SHOWN} from live where trace_id = 't9'")
_through("store_rollup", lambda s, d: _filled(s, d).rollup("1d", RANGE), f", written as (select * from sp union all select * replace (start_ns + 86400000000000 as start_ns, 'model-new' as model) from sp where {_MOVED}) select * from ({_bucket_sql('1d', 'written')}) where window_start_ns >= {FROM_NS} and window_start_ns < {TO_NS}")
_through("expired", _expired, f"select {SHOWN} from sp where start_ns // 86400000000000 in (select start_ns // 86400000000000 from sp group by 1 having max(start_ns) >= {_CUTOFF})")
_through("integrity_report", _checked, f"select true ok, count(*) superseded, 1::bigint errors_when_damaged from sp where not ({_LATER}) or {_MOVED}")
_add("otlp_stored", _stored_requests, """select case event_id % 10 when 3 then 'startTimeUnixNano' when 7 then 'TraceID' else 'accepted' end field, count(*) n from events group by 1
  union all select 'live', count(*) from events where event_id % 10 not in (3, 7)""")
_on_spans("distinct_all_values", lambda sp: aggregates.all_distinct(sp, "agent", RANGE), f"select distinct agent from sp where {IN_RANGE} and agent <> ''")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
