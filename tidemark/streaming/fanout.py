"""Structured Streaming over the event log.

The checkpoint is the cursor, a file source that is committed whole is the safe
horizon, and ``maxFilesPerTrigger`` is the batch size.  Delivery is at least
once; a sink that remembers (subscription_id, event_id) makes it exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.subscriptions import batches, match
from tidemark.plans.spec import SpecError, TableSpec
from tidemark.sources.retention import read_events

LOG_SCHEMA = ("id string, ts timestamp, table_name string, schema_name string, op string, topic string, "
              "row_before string, row_data string, diff string, hour string")


def event_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return read_events(spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path))


def fan_out(events: DataFrame, subs: Callable[[], DataFrame], specs: dict[str, TableSpec], sink: Callable[[DataFrame, int], None],
            checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Deliver one row per subscription and micro-batch to ``sink``.

    ``subs`` is asked anew each batch, so subscriptions can come and go.
    """
    if not events.isStreaming:
        raise SpecError("a subscription needs a stream; use match() for a batch")

    def deliver(batch: DataFrame, number: int) -> None:
        events = batch.persist()
        try:
            sink(batches(events, match(events, subs(), specs)), number)
        finally:
            events.unpersist()

    writer = events.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
