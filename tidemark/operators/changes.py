"""Change capture: events with images of the rows before and after a write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ids import event_id, topic
from tidemark.functions.json import json_diff, row_image
from tidemark.plans.spec import TableSpec

#: Characters of a captured event's id: prefix, 13 of time and 16 of the row, so that rows of one statement don't share one.
WIDTH = 31
EVENT_COLUMNS = ["id", "ts", "table_name", "schema_name", "op", "topic", "row_before", "row_data", "diff"]


def _events(rows: DataFrame, spec: TableSpec, op: str, ts: Column, tie: Column, before: Column, data: Column, diff: Column) -> DataFrame:
    if not spec.subscribable:
        return rows.limit(0).select(*_columns(spec, op, ts, tie, before, data, diff))
    return rows.select(*_columns(spec, op, ts, tie, before, data, diff))


def _columns(spec, op, ts, tie, before, data, diff):
    return [event_id(ts, tie, width=WIDTH).alias("id"), ts.cast("timestamp").alias("ts"), F.lit(spec.name).alias("table_name"), F.lit(spec.schema).alias("schema_name"),
            F.lit(op).alias("op"), topic(F.lit(spec.schema), F.lit(spec.name), F.lit(op)).alias("topic"),
            before.alias("row_before"), data.alias("row_data"), diff.alias("diff")]


def _tie(spec: TableSpec) -> Column:
    """Tie-break of ids within one statement: 64 bits of the primary key, no global order needed."""
    return F.xxhash64(*[F.col(c) for c in spec.primary])


def none_variant() -> Column:
    return F.lit(None).cast("variant")


def capture_insert(rows: DataFrame, spec: TableSpec, ts: Column) -> DataFrame:
    return _events(rows, spec, "INSERT", ts, _tie(spec), none_variant(), row_image(spec.columns), none_variant())


def capture_delete(rows: DataFrame, spec: TableSpec, ts: Column) -> DataFrame:
    return _events(rows, spec, "DELETE", ts, _tie(spec), none_variant(), row_image(spec.columns), none_variant())


def capture_update(before: DataFrame, after: DataFrame, spec: TableSpec, ts: Column) -> DataFrame:
    """Images are paired by primary key."""
    old = before.select(*[F.col(c).alias(f"__b_{c}") for c in spec.columns])
    on = reduce(Column.__and__, [F.col(c) == F.col(f"__b_{c}") for c in spec.primary])
    paired = after.join(old, on).withColumns({"__old": row_image(spec.columns, "__b_"), "__new": row_image(spec.columns)})
    return _events(paired, spec, "UPDATE", ts, _tie(spec), F.col("__old"), F.col("__new"), json_diff(F.col("__new"), F.col("__old")))


def read_horizon(open_since: DataFrame, now: Column, started: str = "started_at") -> DataFrame:
    """One row (horizon): events below this id are complete.

    ``open_since`` has the start of every writing transaction that is still open; the
    oldest bounds the horizon, and without any it is ``now``.
    """
    oldest = open_since.agg(F.min(F.col(started).cast("timestamp")).alias("oldest"))
    return oldest.select(event_id(F.coalesce("oldest", now.cast("timestamp")), F.lit(0), width=WIDTH).alias("horizon"))


def start_cursor(devices: DataFrame, horizon: DataFrame, device: str = "device_id", cursor: str = "cursor") -> DataFrame:
    """A new device starts at the horizon, so that nothing older is replayed; a known one keeps its cursor."""
    return devices.join(F.broadcast(horizon)).withColumn(cursor, F.coalesce(cursor, "horizon")).drop("horizon")


def replay(events: DataFrame, cursor: str | None, horizon: str, limit: int = 250) -> DataFrame:
    """Events after ``cursor`` and strictly before ``horizon``, the first ``limit`` by id."""
    seen = F.lit(True) if cursor is None else F.col("id") > cursor
    return events.where(seen & (F.col("id") < horizon)).orderBy("id").limit(limit)


def next_cursor(batch: DataFrame, cursor: str | None) -> str | None:
    """The largest id that was read, matched or not; unchanged after an empty batch."""
    return batch.agg(F.max("id")).first()[0] or cursor
