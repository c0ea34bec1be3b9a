"""The span store: Parquet files and a chain of commit files.

``log/`` holds batches in arrival order, ``base/`` the compacted live rows by day, ``rollups/``
one-minute partial buckets of every batch, ``incoming/`` OTLP spans as they were read. A commit file lists what is live, with the rows and times of
each day and batch; only listed paths are read, so an interrupted write leaves an orphan folder and no
trace in results, and queries over a time range open just its days. A commit is published under the
next number, which only one writer can take. Folders that a commit leaves behind stay for a while, so
that frames which still read them do not break, and go by ``maintenance.vacuum``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.errors import Closed, Conflict, InvalidOtlp, InvalidSpan, NotFound, TooLarge, ValidationError
from ..functions.predicates import SpanFilter, TimeRange
from ..functions.schema import FORMAT_VERSION, LOG_SCHEMA, PUBLIC, SPAN_SCHEMA, day, fill
from ..functions.validation import first_broken, split, validate
from ..operators import aggregates, live, rollups, scans
from . import otlp
from .files import Folder

#: Log batches above which ingest compacts on its own.
COMPACT_BATCHES = 10
DAY_SECONDS = 86_400


class SpanStore:
    """An open store. ``retention_days`` bounds the age of spans and buckets; 0 keeps all.

    Every batch is visible and durable once its call returns. With ``buffer_rows``, spans given to
    ``ingest`` one by one are checked at once but written together: when that many wait, when the oldest
    has waited ``buffer_seconds`` at the next call, and before anything is read, flushed or closed. They
    are seen by all reads of this store, and lost if its process dies before.
    """

    def __init__(self, spark: SparkSession, path: str, retention_days: float = 7, compact_batches: int = COMPACT_BATCHES, clock=time.time_ns, buffer_rows: int = 0, buffer_seconds: float = 5, grace_seconds: float = 3600):
        self.spark, self.path = spark, path.rstrip("/")
        self.retention_days, self.compact_batches, self.clock = retention_days, compact_batches, clock
        self.buffer_rows, self.buffer_seconds, self.grace_seconds = buffer_rows, buffer_seconds, grace_seconds
        self.folder = Folder(spark, self.path)
        self.closed = False
        self._buffer: list[dict] = []
        self._since = 0.0
        self._read_commit()

    # -- commits

    def _read_commit(self) -> None:
        numbers = [int(n[:-5]) for n in self.folder.names("commits") if n.endswith(".json") and n[:-5].isdigit()]
        self.version = max(numbers, default=0)
        self.state = self.folder.read_json(f"commits/{self.version:012d}.json") if numbers else {"format": FORMAT_VERSION, "batch": 0, "base": {}, "log": [], "rollups": [], "streams": {}, "dropped": []}
        if self.state["format"] != FORMAT_VERSION:
            raise InvalidSpan(f"the store has format {self.state['format']}")

    def _commit(self, state: dict) -> None:
        if not self.folder.publish_json(f"commits/{self.version + 1:012d}.json", state):
            self._read_commit()
            raise Conflict("another writer committed first")
        self.version, self.state = self.version + 1, state

    def _open(self) -> None:
        if self.closed:
            raise Closed(self.path)

    # -- frames

    def _parquet(self, paths: list[str], schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*(f"{self.path}/{p}" for p in paths))

    def log(self) -> DataFrame | None:
        """Rows written since the last compaction, tombstones included."""
        self._settle()
        return self._parquet([b["path"] for b in self.state["log"]], LOG_SCHEMA) if self.state["log"] else None

    def days_within(self, span: TimeRange | None) -> list[str]:
        """Days of the base that may hold spans of a time range."""
        low, high = (span or TimeRange()).bounds()
        return [d for d, facts in self.state["base"].items() if facts["low"] <= high and facts["high"] >= low]

    def base(self, days: list[str]) -> DataFrame | None:
        return self._parquet([self.state["base"][d]["path"] for d in days], SPAN_SCHEMA).select(*PUBLIC) if days else None

    def spans(self, span: TimeRange | None = None) -> DataFrame:
        """All live spans; with a time range at least those in it, from its days alone. A log hides rows of any day, so it is read whole."""
        self._settle()
        log, old = self.log(), self.base(self.days_within(span))
        if old is None and log is None:
            return self.spark.createDataFrame([], SPAN_SCHEMA)
        rows = sum(b["rows"] for b in self.state["log"])
        return live.resolve(old, log, rows).select(*PUBLIC)

    def partial_buckets(self) -> DataFrame:
        self._settle()
        if not self.state["rollups"]:
            return rollups.partials(self.spark.createDataFrame([], SPAN_SCHEMA))
        found = self._parquet([p["path"] for p in self.state["rollups"]])
        return rollups.evict(found, self.cutoff_ns()) if self.retention_days else found

    def cutoff_ns(self) -> int:
        return self.clock() - int(self.retention_days * DAY_SECONDS * 1_000_000_000)

    # -- writing

    def _append(self, rows: DataFrame, stream: tuple[str, int] | None = None, incoming: str | None = None) -> int:
        """Write span rows with ``_deleted`` and ``_index`` as one batch; returns their number. The folder ``incoming``, which they come from, is left."""
        batch, name = self.state["batch"] + 1, f"{self.state['batch'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        path = f"log/{name}"
        shaped = rows.select(*PUBLIC, F.coalesce("_deleted", F.lit(False)).alias("_deleted"), F.lit(batch).cast("long").alias("_batch"), F.col("_index").cast("long").alias("_index"), day().alias("day"))
        shaped.write.mode("errorifexists").parquet(f"{self.path}/{path}")
        written = self._parquet([path], LOG_SCHEMA)
        facts = written.agg(F.count("*").alias("n"), F.min("start_ns").alias("low"), F.max("start_ns").alias("high"), F.count_if(~F.col("_deleted")).alias("spans")).first()
        state = json.loads(json.dumps(self.state))
        if stream:
            state["streams"][stream[0]] = stream[1]
        if facts["n"]:
            state["batch"] = batch
            state["log"].append({"path": path, "rows": facts["n"], "min_ns": facts["low"], "max_ns": facts["high"]})
            if facts["spans"]:
                rollup = f"rollups/{name}"
                rollups.partials(written).write.mode("errorifexists").parquet(f"{self.path}/{rollup}")
                state["rollups"].append({"path": rollup, "max_ns": facts["high"]})
        if incoming:
            state["dropped"].append([incoming, self.clock()])
        if facts["n"] or stream or incoming:
            self._commit(state)
        from ..plans import maintenance

        if len(self.state["log"]) > self.compact_batches:
            maintenance.compact(self, len(self.state["log"]) // 2)
        if self.retention_days and maintenance.expirable(self):
            maintenance.expire(self)
        return facts["n"]

    def ingest_frame(self, df: DataFrame, duration_ns: str | None = None, index: str | None = None, stream: tuple[str, int] | None = None) -> tuple[int, DataFrame]:
        """Validate and append a DataFrame of any size: (rows accepted, rejections(index, field, reason)).

        ``index`` names a column with the arrival order in the batch; without it, rows arrive in
        partition order. ``stream`` (name, batch number) makes a repeated call of the same batch a no-op.
        """
        self._settle()
        if stream and self.state["streams"].get(stream[0], -1) >= stream[1]:
            return 0, self.spark.createDataFrame([], "index long, field string, reason string")
        numbered = fill(df).withColumn("_index", F.col(index).cast("long") if index else F.monotonically_increasing_id())
        good, bad = split(validate(numbered, duration_ns))
        n = self._append(good.withColumn("_deleted", F.lit(False)), stream)
        return n, bad.select(F.col("_index").alias("index"), "error.field", "error.reason")

    def ingest_batch(self, spans: Iterable[dict]) -> tuple[int, list[tuple[int, ValidationError]]]:
        """Append spans given as dicts of span columns; ``duration_ns`` may stand for ``latency_ms``.

        Returns the number accepted and (index, error) of each rejected span. Others are stored.
        """
        self._open()
        rows = []
        for i, span in enumerate(spans):
            row = {k: span.get(k) for k in PUBLIC}
            ns = span.get("duration_ns", None if span.get("latency_ms") is None else span["latency_ms"] * 1_000_000) or 0
            row |= {"latency_ms": int(ns / 1_000_000), "_ns": ns, "_index": i}
            if isinstance(row["payload"], (dict, list)):
                row["payload"] = json.dumps(row["payload"])
            if row["cost_usd"] is not None:
                row["cost_usd"] = float(row["cost_usd"])
            rows.append(row)
        if not rows:
            return 0, []
        kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in SPAN_SCHEMA), "_ns long", "_index long"])
        n, bad = self.ingest_frame(self.spark.createDataFrame([tuple(r[k] for k in (*PUBLIC, "_ns", "_index")) for r in rows], kinds), "_ns", "_index")
        return n, [(r["index"], ValidationError(r["field"], r["reason"])) for r in bad.orderBy("index").collect()]

    def _settle(self) -> None:
        """Write the spans that wait. If that fails, they wait on."""
        self._open()
        if self._buffer:
            waiting, self._buffer = self._buffer, []
            try:
                self.ingest_batch(waiting)
            except BaseException:
                self._buffer = waiting + self._buffer
                raise

    def ingest(self, span: dict) -> None:
        """Append one span; raises ValidationError."""
        if self.buffer_rows:
            self._open()
            payload = span.get("payload")
            span = span | {"payload": json.dumps(payload) if isinstance(payload, (dict, list)) else payload}
            if broken := first_broken(span):
                raise ValidationError(*broken)
            self._since = self._since if self._buffer else time.monotonic()
            self._buffer.append(span)
            if len(self._buffer) >= self.buffer_rows or time.monotonic() - self._since > self.buffer_seconds:
                self._settle()
            return
        _, bad = self.ingest_batch([span])
        if bad:
            raise bad[0][1]

    def ingest_otlp(self, body: str | bytes) -> tuple[int, list[tuple[int, ValidationError]]]:
        """Append the spans of one OTLP/JSON request: (accepted, (index in request order, error) of each rejected span)."""
        self._settle()
        raw = body.encode() if isinstance(body, str) else bytes(body)
        if len(raw) > otlp.MAX_BYTES:
            raise TooLarge(f"{len(raw)} bytes")
        try:
            if not otlp.decodable(json.loads(raw)):
                raise ValueError("a list, an object or a scalar is not where it belongs")
        except (ValueError, RecursionError) as e:
            raise InvalidOtlp(str(e)) from e
        requests = self.spark.createDataFrame([(raw.decode(),)], "body string")
        if problem := otlp.problems_of(requests).first():
            raise InvalidOtlp(problem["problem"])
        good, bad = split(otlp.spans_of(requests))
        rejected = [(r["index"], ValidationError(r["error"]["field"], r["error"]["reason"])) for r in bad.select("index", "error").orderBy("index").collect()]
        return self._append(good.withColumns({"_deleted": F.lit(False), "_index": F.col("index")})), rejected

    def ingest_otlp_frame(self, requests: DataFrame, body: str = "body", stream: tuple[str, int] | None = None) -> tuple[int, DataFrame]:
        """Append the spans of any number of requests: (rows accepted, rejections as ``otlp.rejections_of`` gives them).

        Requests are read once, into a folder of ``incoming/`` that the batch's commit leaves to ``vacuum``;
        rejections are read from there and belong to the batch, whatever becomes of the requests.
        """
        self._settle()
        if stream and self.state["streams"].get(stream[0], -1) >= stream[1]:
            return 0, otlp.rejections_of(requests, body).limit(0)
        kept = [c for c in requests.columns if c != body]
        checked = otlp.checked(requests, body).withColumn("_index", F.monotonically_increasing_id())
        path = f"incoming/{self.state['batch'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        checked.write.mode("errorifexists").parquet(f"{self.path}/{path}")
        good, bad = split(self._parquet([path], checked.schema))
        n = self._append(good.filter("index is not null").withColumn("_deleted", F.lit(False)), stream, path)
        return n, bad.select(*kept, "index", "error.field", "error.reason")

    def delete_span(self, trace_id: str, span_id: str) -> None:
        """Absent spans are no error; empty ids are."""
        self._open()
        for name, v in (("TraceID", trace_id), ("SpanID", span_id)):
            if not v:
                raise ValidationError(name, "must not be empty")
        self._delete(self.spans().filter((F.col("trace_id") == trace_id) & (F.col("span_id") == span_id)))

    def delete_trace(self, trace_id: str) -> None:
        """Delete the spans that the trace has now; later ones are unaffected."""
        self._open()
        if not trace_id:
            raise ValidationError("TraceID", "must not be empty")
        self._delete(self.spans().filter(F.col("trace_id") == trace_id))

    def _delete(self, found: DataFrame) -> None:
        self._settle()
        self._append(found.withColumns({"_deleted": F.lit(True), "_index": F.monotonically_increasing_id()}))

    def flush(self) -> None:
        """Write the spans that wait; batches are durable when their call returns."""
        self._settle()

    def sync(self) -> None:
        """Take in what other writers have committed."""
        self._settle()
        self._read_commit()

    def close(self) -> None:
        """Write the spans that wait. Later calls raise Closed, but for another close."""
        if not self.closed:
            self._settle()
        self.closed = True

    # -- reading

    def span(self, trace_id: str, span_id: str) -> Row:
        rows = scans.span_lookup(self.spans(), trace_id, span_id).collect()
        if not rows:
            raise NotFound(f"{trace_id}/{span_id}")
        return rows[0]

    def trace(self, trace_id: str) -> list[Row]:
        rows = scans.trace_lookup(self.spans(), trace_id).collect()
        if not rows:
            raise NotFound(trace_id)
        return rows

    def query(self, where: SpanFilter = SpanFilter(), limit: int = 0, cursor: str = "", newest_first: bool = False) -> tuple[list[Row], str]:
        """(spans of the page, next cursor or an empty string)."""
        return scans.cut_page(scans.page(self.spans(where.range), where, limit, cursor, newest_first).collect(), limit, cursor)

    def traces(self, where: SpanFilter = SpanFilter(), limit: int = 0, newest_first: bool = False) -> list[str]:
        return [r["trace_id"] for r in scans.traces(self.spans(where.range), where, limit, newest_first).collect()]

    def failed_spans(self, span: TimeRange | None = None, limit: int = 0) -> list[Row]:
        return scans.failed_spans(self.spans(span), span, limit).collect()

    def costs(self, by: str, span: TimeRange | None = None) -> DataFrame:
        return aggregates.costs(self.spans(span), by, span)

    def tokens_by_model(self, span: TimeRange | None = None) -> DataFrame:
        return aggregates.tokens_by_model(self.spans(span), span)

    def error_rate(self, model: str = "", span: TimeRange | None = None) -> float:
        return aggregates.error_rate(self.spans(span), model, span).first()["error_rate"]

    def top_teams_by_cost(self, n: int = 0, span: TimeRange | None = None) -> list[Row]:
        return aggregates.top_teams_by_cost(self.spans(span), n, span).collect()

    def top_models_by_spans(self, n: int = 0, span: TimeRange | None = None) -> list[Row]:
        return aggregates.top_models_by_spans(self.spans(span), n, span).collect()

    def distinct(self, dimension: str, span: TimeRange | None = None, limit: int = 0) -> list[str]:
        return [r[0] for r in aggregates.distinct_values(self.spans(span), dimension, span, limit).collect()]

    def rollup(self, window: str, span: TimeRange | None = None) -> DataFrame:
        """Buckets whose start is in [from, to), from stored partials, ordered by start and model."""
        rollups.window_ns(window)
        found = rollups.within(self.partial_buckets(), window, span)
        kept = rollups.evict(found, self.cutoff_ns()) if self.retention_days else found
        return rollups.present(kept).orderBy("window_start_ns", "model")

    def sql(self, text: str, view: str = "spans") -> DataFrame:
        """Extension: Spark SQL over live spans under a view's name."""
        self.spans().createOrReplaceTempView(view)
        return self.spark.sql(text)
