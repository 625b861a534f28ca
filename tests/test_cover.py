"""Settings, horizons, several limits, prefixes and wide event ids: against plain values."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators.access import policy
from tidemark.operators.changes import capture_insert, read_horizon, start_cursor
from tidemark.operators.conditions import compile_condition
from tidemark.operators.ratelimit import UNAUTHENTICATED, Limit, caller_key, consume_in_turn
from tidemark.operators.subscriptions import match, subscription, subscriptions
from tidemark.plans.spec import Attribute as A
from tidemark.plans.spec import TableSpec
from tidemark.sources.retention import LogConfig, append_events, drop_expired, partitions_ahead

BOOKS = TableSpec("books", (A("id", "bigint", filters=("eq",)), A("title", "string", filters=("startsWith", "range"))), ("id",), subscribable=True)


def test_ids_of_one_statement_differ(spark):
    ts = F.lit("2024-01-01 10:00:00").cast("timestamp")
    rows = spark.range(0, 2_000_000, 1, 4).select("id", F.lit("t").alias("title"))
    ids = capture_insert(rows, BOOKS, ts).select("id")
    assert ids.select(F.approx_count_distinct("id", 0.01)).first()[0] > 1_900_000
    # Of 64 bits of the key, so that 10^7 rows share one with a chance of about 10^-6.
    assert ids.select(F.length("id")).first()[0] == 31 and ids.groupBy(F.substring("id", 16, 16)).count().where("count > 1").limit(1).count() == 0


def test_horizon_and_cursor(spark):
    now = F.lit("2024-01-01 10:00:00").cast("timestamp")
    opened = spark.createDataFrame([("2024-01-01 09:30:00",), ("2024-01-01 09:45:00",)], "started_at string").withColumn("started_at", F.col("started_at").cast("timestamp"))
    some, none = read_horizon(opened, now), read_horizon(opened.limit(0), now)
    assert some.first()[0] < none.first()[0]
    at = lambda t: capture_insert(spark.createDataFrame([(1, "x")], "id long, title string"), BOOKS, F.lit(t).cast("timestamp")).first().id
    assert at("2024-01-01 09:29:59") < some.first()[0] <= at("2024-01-01 09:30:00")
    devices = spark.createDataFrame([("new", None), ("old", "ps1")], "device_id string, cursor string")
    assert {r.device_id: r.cursor for r in start_cursor(devices, none).collect()} == {"new": none.first()[0], "old": "ps1"}


def test_log_settings_and_retention(spark, tmp_path):
    config = LogConfig.of(spark.createDataFrame([("keep_hours", "1"), ("ahead_hours", "3"), ("read_chunk", None)], "key string, value string"))
    assert config == LogConfig(1, 3, 1000) and len(partitions_ahead(datetime(2024, 1, 1, 10, 30), config)) == 4
    with pytest.raises(ValueError):
        LogConfig.of(spark.createDataFrame([("nope", "1")], "key string, value string"))
    path = str(tmp_path / "log")
    for hour in (7, 8, 9, 10):
        append_events(capture_insert(spark.createDataFrame([(hour, "x")], "id long, title string"), BOOKS, F.lit(f"2024-01-01 {hour:02d}:10:00").cast("timestamp")), path)
    assert drop_expired(spark, path, datetime(2024, 1, 1, 10, 30)) == ["2024010107"]
    assert drop_expired(spark, path, datetime(2024, 1, 1, 10, 30), config) == ["2024010108"]
    assert {r.hour for r in spark.read.parquet(path).select("hour").distinct().collect()} == {2024010109, 2024010110}


def test_limits_in_turn(spark):
    rows = [(i, "u" if i < 6 else None, "ip", i) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, user string, ip string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: (r.allowed, r.rejected_by) for r in consume_in_turn(df, [("user", "user", Limit(3, 60)), ("ip", "ip", Limit(4, 60))], "ts", "id").collect()}
    assert got == {0: (True, None), 1: (True, None), 2: (True, None), 3: (False, "user"), 4: (False, "user"), 5: (False, "user"), 6: (True, None), 7: (False, "ip")}
    who = df.select(caller_key(F.col("user"), F.lit(" 9.9.9.9 , 1.1.1.1"), F.lit(None).cast("string"), F.lit("p")).alias("k")).distinct()
    assert {r.k for r in who.collect()} == {"u", "9.9.9.9"} and UNAUTHENTICATED == Limit(60, 60)


def test_prefix_and_casts(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "b"), (3, None)], "id long, title string")
    assert [r.id for r in df.where(compile_condition(BOOKS, {"title": {"startsWith": "ab"}}).where).collect()] == [1]
    assert [r.id for r in df.where(policy("id = :me::int", {"me": "2"})).collect()] == [2]


def test_templates_without_an_equality(spark):
    rows = spark.createDataFrame([(i, f"t{i:02d}") for i in range(30)], "id long, title string")
    log = capture_insert(rows, BOOKS, F.lit("2024-01-01 10:00:00").cast("timestamp"))
    subs = subscriptions(spark, [subscription(BOOKS, "created", {"title": {"startsWith": p}}) for p in ("t0", "t1", "x")] + [subscription(BOOKS, "created", {"title": {"range": {"from": "t28"}}})])
    found = match(log, subs, {"books": BOOKS}).join(subs.select(F.col("id").alias("subscription_id"), F.col("params")[0].alias("p")), "subscription_id")
    assert {r.p: r["count"] for r in found.groupBy("p").count().collect()} == {"t0": 10, "t1": 10, "t28": 2}
