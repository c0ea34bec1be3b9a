"""Continuous ingest: a stream of spans or OTLP requests into a store, each micro-batch exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.schema import SPAN_SCHEMA
from ..sources import otlp
from ..sources.store import SpanStore


def read_spans(spark: SparkSession, path: str, format: str = "parquet", schema=SPAN_SCHEMA, **options) -> DataFrame:
    """A stream of span files; for other sources use ``spark.readStream`` and the span columns."""
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def read_requests(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of OTLP/JSON requests, one file each."""
    return spark.readStream.format("text").option("wholetext", True).options(**options).load(path).withColumnRenamed("value", "body")


def start_ingest(stream: DataFrame, store: SpanStore, checkpoint: str, name: str = "ingest", trigger: dict | None = None, rejected: str | None = None) -> StreamingQuery:
    """Append every micro-batch of span rows to the store; its commit remembers the batch number.

    ``rejected``: a Parquet folder for the rejections of each batch.
    """

    def take(batch: DataFrame, number: int) -> None:
        _, bad = store.ingest_frame(batch, stream=(name, number))
        if rejected:
            bad.write.mode("overwrite").parquet(f"{rejected.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).queryName(name).trigger(**(trigger or {"availableNow": True})).start()


def start_otlp_ingest(stream: DataFrame, store: SpanStore, checkpoint: str, name: str = "otlp", trigger: dict | None = None, rejected: str | None = None) -> StreamingQuery:
    """Append the spans of every micro-batch of requests (a column ``body``; others are kept in rejections).

    ``rejected``: a Parquet folder for rejected spans and whole requests of each batch, written before the batch is committed.
    """

    def take(batch: DataFrame, number: int) -> None:
        if store.state["streams"].get(name, -1) >= number:
            return
        if rejected:
            otlp.rejections_of(batch).write.mode("overwrite").parquet(f"{rejected.rstrip('/')}/batch={number}")
        store.ingest_otlp_frame(batch, stream=(name, number))

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).queryName(name).trigger(**(trigger or {"availableNow": True})).start()
