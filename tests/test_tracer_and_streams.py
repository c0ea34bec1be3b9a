import json

import pytest

from lumispan.functions.errors import Ended, ValidationError
from lumispan.sources import tracer
from lumispan.sources.store import SpanStore
from lumispan.streaming import ingest, rollups

from .conftest import HOUR, MINUTE, NOW, good


def test_ids():
    assert len(tracer.new_trace_id()) == 32 and len(tracer.new_span_id()) == 16 and tracer.new_trace_id() != tracer.new_trace_id()


def test_nesting_and_errors(store):
    with tracer.start_span(store, "outer", start_ns=NOW) as a:
        assert tracer.current_span() is a
        with tracer.start_span(store, "middle", start_ns=NOW) as b, tracer.start_span(store, "inner", start_ns=NOW) as c:
            c.set_model("gpt-4")
            c.set_tokens(3, 4)
            c.set_cost(0.5)
    with pytest.raises(RuntimeError), tracer.start_span(store, "bad", start_ns=NOW) as d:
        raise RuntimeError("boom")
    assert tracer.current_span() is None
    assert {a.trace_id} == {b.trace_id, c.trace_id} and (b.parent_span_id, c.parent_span_id, a.parent_span_id) == (a.span_id, b.span_id, "")
    row = store.span(c.trace_id, c.span_id)
    assert (row["model"], row["tokens_out"], row["status"], row["cost_usd"]) == ("gpt-4", 4, "ok", 0.5)
    bad = store.span(d.trace_id, d.span_id)
    assert bad["status"] == "error" and json.loads(bad["payload"]) == {"name": "bad", "status_message": "boom"}


def test_end_twice_retry_and_options(store):
    s = tracer.start_span(store, "x", trace_id="mine", parent_span_id="p", start_ns=NOW)
    s.set_attribute("bad", object())
    with pytest.raises(ValidationError):
        s.end(NOW + 5_000_000)
    s.set_attribute("bad", 1)
    s.end(NOW - 5)  # an end before the start is no duration
    with pytest.raises(Ended):
        s.end()
    row = store.span("mine", s.span_id)
    assert row["latency_ms"] == 0 and row["parent_span_id"] == "p" and json.loads(row["payload"])["attributes"] == {"bad": 1}


def test_stream_into_store_once(spark, store, tmp_path):
    source = SpanStore(spark, str(tmp_path / "source"), clock=store.clock)
    source.ingest_batch([good("t", str(i)) for i in range(3)])
    folder = f"{source.path}/{source.state['log'][0]['path']}"
    for _ in range(2):  # the second run finds nothing new
        ingest.start_ingest(ingest.read_spans(spark, folder), store, str(tmp_path / "cp")).awaitTermination()
    assert len(store.trace("t")) == 3 and store.rollup("1d").first()["spans"] == 3
    assert store.ingest_frame(spark.read.parquet(folder), stream=("ingest", 0))[0] == 0  # the same batch again
    assert store.rollup("1d").first()["spans"] == 3


def test_stream_of_requests(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.json").write_text('{"resourceSpans":[7]}')
    (tmp_path / "in" / "a.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "t", "spanId": "s", "startTimeUnixNano": NOW}, {"traceId": "", "spanId": "s"}]}]}]}))
    ingest.start_otlp_ingest(ingest.read_requests(spark, str(tmp_path / "in")), store, str(tmp_path / "cp"), rejected=str(tmp_path / "bad")).awaitTermination()
    assert [r["span_id"] for r in store.trace("t")] == ["s"]
    assert sorted((r["field"], r["index"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == [("TraceID", 1, "is empty"), ("request", None, "invalid")]


def test_streaming_rollup(spark, store, tmp_path):
    store.ingest_batch([good("t", str(i), start_ns=NOW - HOUR + i * 40 * MINUTE) for i in range(3)])
    stream = ingest.read_spans(spark, f"{store.path}/{store.state['log'][0]['path']}")
    q = rollups.stream_rollup(stream, "1h").writeStream.outputMode("update").format("memory").queryName("buckets").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert [(r["spans"], r["cost_usd"]) for r in spark.table("buckets").orderBy("window_start").collect()] == [(2, 0.003), (1, 0.0015)]
