import math

import pytest
from pyspark.sql import functions as F

from lumispan.functions.errors import Closed, Conflict, InvalidCursor, InvalidOtlp, InvalidSpan, NotFound, TooLarge, UnsupportedGroup, UnsupportedWindow, ValidationError
from lumispan.functions.predicates import SpanFilter, TimeRange
from lumispan.plans import maintenance
from lumispan.sources import otlp
from lumispan.sources.store import SpanStore

from .conftest import HOUR, MINUTE, NOW, good

BAD = {
    "TraceID": [{"trace_id": ""}],
    "SpanID": [{"span_id": ""}],
    "Start": [{"start_ns": 0}, {"start_ns": None}, {"start_ns": 7_258_118_400_000_000_000}, {"start_ns": 946_684_799_999_999_999}, {"start_ns": 4_102_444_800_000_000_000}],
    "Duration": [{"duration_ns": -1}],
    "Tokens": [{"tokens_in": -1}, {"tokens_out": -1}],
    "CostUSD": [{"cost_usd": -0.01}, {"cost_usd": math.nan}, {"cost_usd": math.inf}],
    "Model": [{"model": "m" * 257}, {"model": "é" * 129}],
    "Payload": [{"payload": '"' + "x" * 65536 + '"'}, {"payload": "{nope"}, {"payload": '{"a":NaN}'}, {"payload": '{"a":1} x'}],
}


def test_validation_rules(store):
    cases = [(f, c) for f, changes in BAD.items() for c in changes]
    fine = [{"model": "é" * 128}, {"start_ns": 946_684_800_000_000_000}, {"payload": None}, {"payload": ""}, {"payload": "[" + "1" * 5000 + "]"}, {"duration_ns": 0}]
    n, bad = store.ingest_batch([good("t", f"s{i}", **c) for i, (_, c) in enumerate(cases)] + [good("u", f"s{i}", **c) for i, c in enumerate(fine)])
    assert n == len(fine)
    assert [(i, e.field) for i, e in bad] == [(i, f) if "trace_id" not in c and "span_id" not in c else (i, f) for i, (f, c) in enumerate(cases)]
    with pytest.raises(InvalidSpan):
        store.ingest(good("", "s"))


def test_batch_rejects_single_rows_and_round_trip(store):
    n, bad = store.ingest_batch([good("t", "1"), good("", "x"), good("t", "2", duration_ns=1_999_999)])
    assert n == 2 and [i for i, _ in bad] == [1]
    row = store.span("t", "1").asDict()
    assert {k: row[k] for k in good("t", "1")} == good("t", "1") and row["parent_span_id"] == ""
    assert store.span("t", "2")["latency_ms"] == 1
    for call in (lambda: store.span("t", "none"), lambda: store.trace("none")):
        with pytest.raises(NotFound):
            call()
    assert store.ingest_batch([]) == (0, [])


@pytest.fixture
def seeded(store):
    rows = [("q7", "root", "mini", "search", "crawler", "Success", 0.125), ("q7", "leaf", "mini", "search", "crawler", "TIMEOUT", 0.125), ("q9", "root", "large", "billing", "planner", "", 2.5), ("r1", "root", "mini", "", "", "unset", 0.25), ("r2", "root", "", "search", "crawler", "failed", 0.5)]
    store.ingest_batch([good(t, s, model=m, team=g, agent=a, status=st, cost_usd=c, start_ns=NOW + i) for i, (t, s, m, g, a, st, c) in enumerate(rows)])
    return store


def test_query_surface(seeded):
    s = seeded
    assert s.error_rate() == 0.4 and s.error_rate("large") == 0 and s.error_rate("none") == 0
    assert [r["trace_id"] + r["span_id"] for r in s.failed_spans()] == ["r2root", "q7leaf"]
    assert s.traces(SpanFilter(model="mini")) == ["q7", "r1"]
    assert [r["team"] for r in s.top_teams_by_cost(1)] == ["billing"]
    assert [(r["model"], r["spans"]) for r in s.top_models_by_spans()] == [("mini", 3), ("large", 1)]
    assert s.distinct("model") == ["large", "mini"] and s.distinct("team") == ["billing", "search"] and s.distinct("agent", limit=1) == ["crawler"]
    assert {r["model"]: r["cost_usd"] for r in s.costs("model").collect()} == {"mini": 0.5, "large": 2.5}
    assert {r["model"]: r["tokens_total"] for r in s.tokens_by_model().collect()} == {"mini": 450, "large": 150}
    assert s.sql("select count(*) n from spans").first()["n"] == 5
    for call in (lambda: s.costs("tool"), lambda: s.distinct("tool")):
        with pytest.raises(UnsupportedGroup):
            call()


def test_paging(store):
    store.ingest_batch([good(x, "only", start_ns=NOW - 7 * MINUTE + i * MINUTE // 3) for i, x in enumerate(("maple", "ash", "oak", "fir", "elm", "yew", "box"))])
    pages, cursor = [], ""
    while True:
        rows, cursor = store.query(limit=3, cursor=cursor)
        pages.append([r["trace_id"] for r in rows])
        if not cursor:
            break
    assert pages == [["maple", "ash", "oak"], ["fir", "elm", "yew"], ["box"]]
    assert [r["trace_id"] for r in store.query(limit=2, newest_first=True)[0]] == ["box", "yew"]
    assert store.query(cursor="50") == ([], "")
    for bad in ("garbage", "-1", "1.5", "²"):
        with pytest.raises(InvalidCursor):
            store.query(SpanFilter(TimeRange(NOW + HOUR, NOW + 2 * HOUR)), cursor=bad)


def test_order_and_ties(store):
    store.ingest_batch([good("t", x, start_ns=NOW + i * 1_000_000_000) for i, x in enumerate("zma")] + [good("u", x, team=x, cost_usd=0.01, start_ns=NOW - 5) for x in "bac"])
    assert [r["span_id"] for r in store.trace("t")] == ["z", "m", "a"]
    assert [r["team"] for r in store.top_teams_by_cost(2, TimeRange(0, NOW - 1))] == ["a", "b"]
    assert [r["span_id"] for r in store.query(SpanFilter(TimeRange(NOW - 5, NOW - 5)), newest_first=True)[0]] == ["a", "b", "c"]
    assert store.traces(limit=1, newest_first=True) == ["t"]


def test_last_write_wins_whatever_the_start(store):
    store.ingest_batch([good("t", "s", model="A")])
    store.ingest_batch([good("t", "s", model="B", start_ns=NOW - HOUR), good("t", "s", model="C", start_ns=NOW - 2 * HOUR)])
    assert store.span("t", "s")["model"] == "C" and store.query(SpanFilter(model="A"))[0] == []
    maintenance.compact(store)
    assert store.span("t", "s")["model"] == "C"
    store.ingest(good("t", "s", model="D"))
    assert [r["model"] for r in store.query()[0]] == ["D"] and store.query(SpanFilter(model="C"))[0] == []


def test_deletes_and_reinsert(store):
    store.ingest_batch([good("t1", "a"), good("t1", "b"), good("t2", "a")])
    maintenance.compact(store)
    store.delete_span("t1", "a")
    store.delete_span("none", "none")
    assert [r["span_id"] for r in store.trace("t1")] == ["b"]
    store.delete_trace("t1")
    with pytest.raises(NotFound):
        store.trace("t1")
    assert len(store.trace("t2")) == 1
    store.ingest(good("t1", "a", model="new"))
    assert [r["model"] for r in store.trace("t1")] == ["new"]
    for call in (lambda: store.delete_span("", "x"), lambda: store.delete_trace("")):
        with pytest.raises(ValidationError):
            call()
    assert maintenance.compact(store) == 2 and maintenance.check(store).ok
    assert sum(r["spans"] for r in store.rollup("1d").collect()) == 4  # deletes take nothing away, the second write of a key counts


def test_rollups(store):
    rows = [(3, "mini", 0.5, 41, 6, 1), (58, "mini", 0.125, 80, 9, 8), (61, "large", 1.0, 7, 2, 2), (118, "", 0.0, 0, 1, 0)]
    base = NOW - 4 * HOUR
    store.ingest_batch([good("t", str(i), start_ns=base + m * MINUTE, model=model, cost_usd=c, latency_ms=ms, tokens_in=a, tokens_out=b) for i, (m, model, c, ms, a, b) in enumerate(rows)])
    got = store.rollup("1h", TimeRange(base, base + 2 * HOUR)).collect()
    assert [(r["window_start_ns"] - base, r["model"], r["spans"]) for r in got] == [(0, "mini", 2), (HOUR, "", 1), (HOUR, "large", 1)]
    assert tuple(got[0])[3:] == (0.625, 15, 9, 60, 41, 80)
    assert len(store.rollup("1h", TimeRange(base + 30 * MINUTE, base + 2 * HOUR)).collect()) == 2
    assert len(store.rollup("1h", TimeRange(base, base + HOUR)).collect()) == 1
    assert sum(r["spans"] for r in store.rollup("1d").collect()) == 4
    with pytest.raises(UnsupportedWindow):
        store.rollup("7m")
    reopened = SpanStore(store.spark, store.path, clock=store.clock)
    assert reopened.rollup("5m").count() == 4
    late = SpanStore(store.spark, store.path, retention_days=1, clock=lambda: base + 25 * HOUR)
    assert [r["window_start_ns"] for r in late.rollup("1h").select("window_start_ns").distinct().collect()] == [base + HOUR]


def test_retention_drops_whole_days(store):
    day = 24 * HOUR
    store.ingest_batch([good("old", "1", start_ns=NOW - 9 * day), good("mid", "1", start_ns=NOW - 5 * day)])
    assert maintenance.expire(store) == 0  # one batch, its newest span is young
    maintenance.compact(store)
    assert maintenance.expire(store) == 1 and store.traces() == ["mid"]
    store.ingest(good("mid", "1", start_ns=NOW - 8 * day))  # an old start hides the young base row
    assert maintenance.expire(store) == 1 and store.traces() == [] and maintenance.check(store).ok


def test_compaction_runs_by_itself(spark, tmp_path):
    store = SpanStore(spark, str(tmp_path / "s"), compact_batches=2, clock=lambda: NOW)
    for i in range(3):
        store.ingest(good("t", str(i)))
    # the oldest half of the log is merged, the rest stays
    assert len(store.state["log"]) == 2 and [d["rows"] for d in store.state["base"].values()] == [1] and len(store.trace("t")) == 3


def test_reopen_conflict_and_interrupted_write(spark, store):
    store.ingest(good("t", "1"))
    other = SpanStore(spark, store.path, clock=store.clock)
    assert len(other.trace("t")) == 1
    # a writer that dies before its commit leaves an orphan folder only
    other.spans().withColumn("_deleted", F.lit(False)).write.parquet(f"{store.path}/log/999-dead")
    assert len(SpanStore(spark, store.path).trace("t")) == 1
    report = maintenance.check(store)
    assert report.ok and report.warnings == ["log/999-dead is not in the commit"]
    store.ingest(good("t", "2"))
    with pytest.raises(Conflict):
        other.ingest(good("t", "3"))
    other.ingest(good("t", "3"))
    store.sync()
    assert [r["span_id"] for r in store.trace("t")] == ["1", "2", "3"]


def test_check_finds_damage(store):
    store.ingest_batch([good("t", "1")])
    store.ingest_batch([good("t", "1", model="x")])
    maintenance.compact(store)
    store.ingest(good("t", "1", model="y"))
    report = maintenance.check(store)
    assert report.ok and "superseded" in report.warnings[0]
    store.folder.remove(store.state["log"][0]["path"])
    assert not maintenance.check(store).ok


def test_close(store):
    store.ingest(good("t", "1"))
    store.flush()
    store.close()
    store.close()
    for call in (lambda: store.trace("t"), lambda: store.ingest(good("t", "2")), store.flush, store.sync):
        with pytest.raises(Closed):
            call()


def test_otlp(store):
    span = {"traceId": "t", "spanId": "s", "parentSpanId": "p", "name": "call <x>", "startTimeUnixNano": str(NOW), "endTimeUnixNano": NOW + 300_000_000, "status": {"code": "STATUS_CODE_ERROR", "message": "boom"}}
    values = {"gen_ai.request.model": {"stringValue": "gpt-4"}, "gen_ai.response.model": {"stringValue": ""}, "gen_ai.usage.input_tokens": {"stringValue": "120"}, "gen_ai.usage.output_tokens": {"intValue": 30}, "gen_ai.agent.id": {"stringValue": "agent-7"}, "wisp.cost_usd": {"doubleValue": 0.002}, "custom.flag": {"boolValue": True}, "n": {"intValue": "7"}, "d": {"doubleValue": 1.5}, "q": {"stringValue": 'a"b'}}
    span["attributes"] = [{"key": "custom.flag", "value": {"stringValue": "earlier"}}, *({"key": k, "value": v} for k, v in values.items())]
    import json

    wrap = lambda *spans: json.dumps({"resourceSpans": [{"resource": {"attributes": [{"key": "service.namespace", "value": {"stringValue": "platform"}}]}, "scopeSpans": [{"spans": list(spans)}]}], "more": 1})
    assert store.ingest_otlp(wrap(span)) == (1, [])
    row = store.span("t", "s").asDict()
    payload = json.loads(row.pop("payload"))
    assert row == {"trace_id": "t", "span_id": "s", "parent_span_id": "p", "start_ns": NOW, "latency_ms": 300, "agent": "agent-7", "model": "gpt-4", "tool": "", "team": "platform", "status": "error", "tokens_in": 120, "tokens_out": 30, "cost_usd": 0.002}
    assert payload == {"name": "call <x>", "status_message": "boom", "attributes": {"custom.flag": True, "n": 7, "d": 1.5, "q": 'a"b'}}
    n, bad = store.ingest_otlp(wrap({"traceId": "ok", "spanId": "1", "startTimeUnixNano": 1.7e18}, {"traceId": "", "spanId": "1"}, {"traceId": "x", "spanId": "1", "startTimeUnixNano": "not-a-number"}))
    assert n == 1 and [(i, e.field) for i, e in bad] == [(1, "TraceID"), (2, "startTimeUnixNano")]
    assert store.span("ok", "1")["status"] == "unset" and store.span("ok", "1")["payload"] is None
    assert store.ingest_otlp("{}") == (0, [])
    misplaced = ['{"resourceSpans":5}', '{"resourceSpans":[5]}', '{"resourceSpans":[{"scopeSpans":[{"spans":"x"}]}]}', '{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":5}]}]}]}', '{"resourceSpans":[{"resource":[]}]}', wrap({"traceId": "t", "attributes": [{"key": "k", "value": {"doubleValue": "1"}}]}), "null"]
    for body, error in (("{nope", InvalidOtlp), ("[]", InvalidOtlp), *((x, InvalidOtlp) for x in misplaced), (b" " * (otlp.MAX_BYTES + 1), TooLarge)):
        with pytest.raises(error):
            store.ingest_otlp(body)
    n, bad = store.ingest_otlp(wrap({"traceId": "neg", "spanId": "1", "startTimeUnixNano": NOW, "attributes": [{"key": "gen_ai.usage.input_tokens", "value": {"intValue": -5}}]}, {"traceId": "big", "spanId": "1", "startTimeUnixNano": NOW, "attributes": [{"key": "gen_ai.usage.prompt_tokens", "value": {"intValue": "99999999999"}}]}))
    assert n == 1 and bad[0][1].field == "Tokens" and store.span("big", "1")["tokens_in"] == 2147483647


def test_requests_are_parsed_once(spark):
    requests = spark.range(3).selectExpr("id", """'{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"t","spanId":"s"}]}]}]}' || id body""")
    for frame in (otlp.spans_of(requests).filter("error is null"), otlp.spans_of(requests).filter("error is not null"), otlp.rejections_of(requests), otlp.problems_of(requests)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_json(") == 1 and plan.count("= gen_ai.agent.id)") <= 1


def test_frames_of_requests_are_read_once(spark, tmp_path):
    now, read = [NOW], spark.sparkContext.accumulator(0)

    def body(n):
        read.add(1)
        return '{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"%s","spanId":"s","startTimeUnixNano":%d}]}]}]}' % ("t" * (n % 2) + str(n) * (n % 2), NOW)

    requests = spark.range(0, 6, 1, 2).select("id", F.udf(body, "string")("id").alias("body")).union(spark.sql("select 6L, '{nope' union all select 7L, '{}'"))
    store = SpanStore(spark, str(tmp_path / "s"), clock=lambda: now[0], grace_seconds=60)
    n, bad = store.ingest_otlp_frame(requests)
    assert n == 3 and sorted(r["trace_id"] for r in store.spans().collect()) == ["t1", "t3", "t5"]
    assert sorted((r["id"], r["index"], r["field"], r["reason"]) for r in bad.collect()) == [(0, 0, "TraceID", "is empty"), (2, 0, "TraceID", "is empty"), (4, 0, "TraceID", "is empty"), (6, None, "request", "invalid")]
    assert bad.columns == otlp.rejections_of(requests).columns and read.value == 6
    assert not maintenance.check(store).warnings
    assert store.ingest_otlp_frame(requests.limit(0))[0] == 0 and len(store.folder.names("incoming")) == 2
    now[0] += 61_000_000_000
    assert maintenance.vacuum(store) == 2 and store.folder.names("incoming") == [] and maintenance.check(store).ok and len(store.trace("t1")) == 1


def test_buffered_ingest(spark, tmp_path):
    store = SpanStore(spark, str(tmp_path / "s"), buffer_rows=3, buffer_seconds=1000, clock=lambda: NOW)
    for i in range(4):
        store.ingest(good("t", str(i), payload={"i": i}))
    assert store.state["batch"] == 1 and len(store._buffer) == 1  # three written together, one waits
    assert [r["span_id"] for r in store.trace("t")] == ["0", "1", "2", "3"] and store.state["batch"] == 2  # reads see it
    store.ingest(good("t", "4"))
    store.close()
    assert len(SpanStore(spark, store.path).trace("t")) == 5


def test_one_span_is_checked_like_a_frame(spark, tmp_path):
    from lumispan.functions.validation import first_broken

    fine = [{}, {"model": "é" * 128}, {"payload": ""}, {"payload": None}, {"duration_ns": 0}]
    assert [first_broken(good("t", "s", **c)) for c in fine] == [None] * len(fine)
    for name, changes in BAD.items():
        assert {first_broken(good("t", "s", **c))[0] for c in changes} == {name}


def test_ranges_open_their_days_alone(store):
    day = 24 * HOUR
    store.ingest_batch([good("t", str(i), start_ns=NOW - i * day) for i in range(4)])
    maintenance.compact(store)
    assert len(store.state["base"]) == 4
    span = TimeRange(NOW - 2 * day, NOW - 2 * day + 5)
    files = store.spans(span).inputFiles()
    assert len(files) == 1 and "day=2024-12-30" in files[0]
    assert [r["span_id"] for r in store.query(SpanFilter(span))[0]] == ["2"]
    # an overwrite that leaves a day takes the old row with it, and other days stay as they are
    before = {d: x["path"] for d, x in store.state["base"].items()}
    store.ingest(good("t", "2", start_ns=NOW))
    assert store.query(SpanFilter(span))[0] == []
    maintenance.compact(store)
    after = {d: x["path"] for d, x in store.state["base"].items()}
    assert set(after) == set(before) - {"2024-12-30"} and [d for d in after if after[d] != before[d]] == ["2025-01-01"]
    assert len(store.trace("t")) == 4 and maintenance.check(store).ok


def test_vacuum_waits_for_readers(spark, tmp_path):
    now = [NOW]
    store = SpanStore(spark, str(tmp_path / "s"), clock=lambda: now[0], grace_seconds=60)
    store.ingest_batch([good("t", "1")])
    lazy = store.spans()
    maintenance.compact(store)
    assert lazy.count() == 1 and maintenance.vacuum(store) == 0 and not maintenance.check(store).warnings
    now[0] += 61_000_000_000
    assert maintenance.vacuum(store) == 1 and store.folder.names("log") == [] and len(store.trace("t")) == 1 and maintenance.check(store).ok


def test_retention_runs_by_itself(spark, tmp_path):
    now = [NOW]
    store = SpanStore(spark, str(tmp_path / "s"), retention_days=1, clock=lambda: now[0])
    store.ingest(good("a", "1"))
    maintenance.compact(store)
    now[0] += 48 * HOUR
    store.ingest(good("b", "1", start_ns=now[0]))
    assert store.traces() == ["b"] and store.state["base"] == {}
