"""Capture, differences, fan-out, replay and retention."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.ids import client_ip, event_id, object_id
from tidemark.functions.json import json_diff
from tidemark.operators.changes import capture_delete, capture_insert, capture_update, next_cursor, replay
from tidemark.operators.subscriptions import (batches, by_condition, close_subscriptions, deliveries, drop_temporary, events_with_subscribers, match, subscription, subscriptions, template_of)
from tidemark.plans.spec import Attribute as A
from tidemark.plans.spec import SpecError, TableSpec
from tidemark.sources.catalog import Catalog, CommitConflict
from tidemark.sources.retention import append_events, expired, partitions_ahead
from tidemark.streaming.fanout import event_stream, fan_out

BOOKS = TableSpec("books", (A("id", "int", filters=("eq", "range")), A("title", "string", filters=("eq", "icontains", "eqIn"), methods=("search",)), A("n", "int", filters=("range",))),
                  ("id",), subscribable=True)
SILENT = TableSpec("silent", (A("id", "int"),), ("id",))
SPECS = {"books": BOOKS, "silent": SILENT}


def at():
    return F.lit("2024-01-01 10:00:00").cast("timestamp")


def books(spark, rows):
    return spark.createDataFrame(rows, "id int, title string, n int")


def test_capture(spark):
    ev = capture_insert(books(spark, [(1, "a", None)]), BOOKS, at()).select("*", F.to_json("row_data").alias("j")).first()
    assert json.loads(ev.j) == {"id": 1, "title": "a", "n": None} and ev.topic == "public.books.INSERT" and ev.row_before is None
    up = capture_update(books(spark, [(1, "a", 1), (2, "b", 2)]), books(spark, [(2, "c", None), (1, "a", 1)]), BOOKS, at())
    got = {r.i: r.d for r in up.select(F.variant_get("row_data", "$.id", "int").alias("i"), F.to_json("diff").alias("d")).collect()}
    assert got[1] is None and json.loads(got[2]) == {"title": "c"}
    assert capture_delete(spark.createDataFrame([(1,)], "id int"), SILENT, at()).count() == 0


@pytest.mark.parametrize("new,old,want", [('{"a":1,"b":2,"c":null}', '{"a":1,"b":null}', {"b": 2}), ('{"a":1}', '{"a":1}', None), ('{"a":null}', '{"a":1}', None),
                                          ('{"a":"1"}', '{"a":1}', {"a": "1"}), ('{"a":{"x":[1]}}', '{}', {"a": {"x": [1]}}), (None, "{}", None)])
def test_json_diff(spark, new, old, want):
    df = spark.createDataFrame([(new, old)], "n string, o string").select(F.to_json(json_diff(F.parse_json("n"), F.parse_json("o"))).alias("d"))
    got = df.first().d
    assert (json.loads(got) if got else None) == want


def test_ids(spark):
    df = spark.range(20).select(F.col("id"), event_id(F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") % 3), F.col("id")).alias("e"))
    rows = df.collect()
    assert all(len(r.e) == 24 and r.e.startswith("ps") for r in rows)
    assert [r.id for r in sorted(rows, key=lambda r: r.e)] == [r.id for r in sorted(rows, key=lambda r: (r.id % 3, r.id))]
    assert spark.range(1).select(object_id("co", at(), F.lit(1)).alias("o")).first().o.startswith("co")
    ip = spark.createDataFrame([("1.1.1.1, 2.2.2.2", "r", "p"), (None, "r", "p"), (None, None, "p"), (None, None, None)], "f string, r string, p string")
    assert [r[0] for r in ip.select(client_ip(F.col("f"), F.col("r"), F.col("p"))).collect()] == ["1.1.1.1", "r", "p", "unknown-ip"]


def test_fan_out(spark):
    before, after = books(spark, [(1, "a", 1), (2, "b", 2)]), books(spark, [(1, "x", 1), (2, "b", 5)])
    events = capture_update(before, after, BOOKS, at()).unionByName(capture_insert(books(spark, [(3, "New Book", 10), (4, "x", 9)]), BOOKS, at()))
    rows = [subscription(BOOKS, "updated", {"id": {"eq": 1}}), subscription(BOOKS, "updated", {"id": {"eq": 2}}, fields=["title"]), subscription(BOOKS, "created"),
            subscription(BOOKS, "created", {"n": {"range": {"from": 10}}}), subscription(BOOKS, "created", {"title": {"icontains": "new"}}),
            subscription(BOOKS, "created", {"title": {"eqIn": ["x", "y"]}}), subscription(BOOKS, "deleted")]
    ids = [r[0] for r in rows]
    subs = subscriptions(spark, rows)
    found = match(events, subs, SPECS)
    counts = {r[0]: r[1] for r in found.groupBy("subscription_id").count().collect()}
    assert [counts.get(i, 0) for i in ids] == [1, 0, 2, 1, 1, 1, 0]
    every = events_with_subscribers(events, found)
    assert every.count() == 3 and every.agg(F.sum(F.size("subscription_ids"))).first()[0] == 6
    got = {r.subscription_id: r for r in batches(events, found).collect()}
    assert set(got) == set(counts) and len(got[ids[2]]["items"]) == 2
    item = json.loads(got[ids[0]]["items"][0])["item"]
    assert item["patch"] == {"title": "x"} and item["key"]["title"] == "a"
    assert close_subscriptions(subs, spark.createDataFrame([(ids[0],)], "id string")).count() == 6
    assert drop_temporary(subs, "local").count() == 0 and drop_temporary(subs, "other").count() == 7


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def joins(df):
    """The lines of the plan's inner joins."""
    return [line for line in plan_of(df).splitlines() if "Join Inner" in line]


def new_books(spark, n):
    return capture_insert(books(spark, [(i, f"t{i % 3}", i) for i in range(n)]), BOOKS, at())


def test_match_compares_columns(spark):
    """No image of an event goes through the join, and events of ungated templates don't have their difference read."""
    subs = subscriptions(spark, [subscription(BOOKS, "created", {"title": {"eq": "t0"}}), subscription(BOOKS, "created")])
    found = match(new_books(spark, 9).withColumn("n", F.lit(1)), subs, SPECS, ("n",))
    assert sorted(found.columns) == ["id", "n", "subscription_id"] and found.count() == 12
    assert joins(found) and not any("try_variant_get" in line or "diff" in line for line in joins(found))
    mixed = subscriptions(spark, [subscription(BOOKS, "created", {"title": {"eq": "t0"}}, fields=f) for f in (None, ["title"])])
    assert match(new_books(spark, 9), mixed, SPECS).count() == 3 and match(new_books(spark, 9), mixed.where("false"), SPECS, ("op",)).columns == ["id", "subscription_id", "op"]


def test_subscribers_to_everything_are_lists(spark):
    events = new_books(spark, 9)
    rows = [subscription(BOOKS, "created", {"title": {"eq": "t0"}}), subscription(BOOKS, "created"), subscription(BOOKS, "created"), subscription(BOOKS, "deleted")]
    subs = subscriptions(spark, rows)
    some, every = by_condition(subs)
    assert some.count() == 1 and every.count() == 3
    pairs = match(events, some, SPECS)
    got = {r.id: r.subscription_ids for r in events_with_subscribers(events, pairs, every).collect()}
    assert pairs.count() == 3 and got == {r.id: r.subscription_ids for r in events_with_subscribers(events, match(events, subs, SPECS)).collect()} and len(got) == 9
    assert events_with_subscribers(events, pairs, every.where("false")).count() == 3


def test_deliveries_are_chunked(spark):
    """Each row holds at most a chunk of the log; all rows of a subscription are its whole batch."""
    events = new_books(spark, 25)
    subs = subscriptions(spark, [subscription(BOOKS, "created", {"title": {"eq": "t0"}}), subscription(BOOKS, "created"), subscription(BOOKS, "created"), subscription(BOOKS, "deleted")])
    rows = deliveries(events, subs, SPECS, 4).collect()
    whole = {r.subscription_id: r for r in batches(events, match(events, subs, SPECS)).collect()}
    assert max(len(r["items"]) for r in rows) <= 4 and len(whole) == 3 and {r.subscription_id for r in rows} == set(whole)
    for i, one in whole.items():
        mine = sorted((r for r in rows if r.subscription_id == i), key=lambda r: r.event_id)
        assert [x for r in mine for x in r["items"]] == one["items"] and mine[-1].event_id == one.event_id
        assert all(json.loads(r["items"][-1])["id"] == r.event_id for r in mine)


def test_templates():
    a, p = template_of({"title": {"eq": "x"}, "id": {"range": {"from": 1, "to": None}}})
    b, q = template_of({"id": {"range": {"from": 7, "to": None}}, "title": {"eq": "y"}})
    assert a == b and p == ["1", "x"] and q == ["7", "y"] and template_of(None) == (None, [])
    with pytest.raises(SpecError):
        subscription(SILENT, "created")
    with pytest.raises(SpecError):
        subscription(BOOKS, "created", {"id": {"eq": 1}}, session={"org": 2}, require={"id": "org"})
    assert subscription(BOOKS, "created", {"id": {"eq": 1}}, session={"org": 1}, require={"id": "org"})


def test_replay(spark):
    log = spark.createDataFrame([(f"e{i}",) for i in range(10)], "id string")
    one = replay(log, "e2", "e8", 3)
    assert [r.id for r in one.collect()] == ["e3", "e4", "e5"] and next_cursor(one, "e2") == "e5"
    assert next_cursor(replay(log, "e9", "e99", 3).where("false"), "e9") == "e9"
    late = log.unionByName(spark.createDataFrame([("e55",)], "id string"))  # a late transaction still has the horizon before it
    assert [r.id for r in replay(late, "e5", "e8", 9).collect()] == ["e55", "e6", "e7"]


def test_retention(spark):
    now = datetime(2024, 1, 1, 10, 30)
    hours = partitions_ahead(now)
    assert len(hours) == 13 and hours[0] == "2024010110" and hours[-1] == "2024010122"
    df = spark.createDataFrame([(h,) for h in ("2024010107", "2024010108", "2024010110")], "hour string")
    assert [r.hour for r in expired(df, F.lit(str(now)).cast("timestamp")).collect()] == ["2024010107"]


def test_catalog(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"), SPECS)
    assert catalog.read("books").count() == 0 and catalog.version() == 0
    assert catalog.publish({"books": books(spark, [(1, "a", 1)]), "silent": spark.createDataFrame([(1,)], "id int")}) == 1
    stale = catalog.version()
    assert catalog.publish({"books": catalog.read("books").unionByName(books(spark, [(2, "b", 2)]))}, base=stale) == 2
    assert catalog.read("books").count() == 2 and catalog.read("silent").count() == 1
    with pytest.raises(CommitConflict):
        catalog.publish({"books": books(spark, [])}, base=stale)
    assert catalog.read("books").count() == 2


def test_stream_delivers_what_a_batch_does(spark, tmp_path):
    path = str(tmp_path / "log")
    events = [capture_insert(books(spark, [(i, f"t{i % 3}", i)]), BOOKS, F.lit(f"2024-01-01 {i:02d}:00:00").cast("timestamp")) for i in range(4)]
    for e in events[:2]:
        append_events(e, path)
    subs = subscriptions(spark, [subscription(BOOKS, "created", {"title": {"eq": "t0"}}), subscription(BOOKS, "created")])
    got = []
    run = lambda: fan_out(event_stream(spark, path, 1), lambda: subs, SPECS, lambda df, n: got.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    run()
    for e in events[2:]:
        append_events(e, path)
    run()
    streamed = sorted((r.subscription_id, json.loads(i)["id"]) for r in got for i in r["items"])
    whole = events[0].unionByName(events[1]).unionByName(events[2]).unionByName(events[3])
    assert streamed == sorted((r.subscription_id, r.id) for r in match(whole, subs, SPECS).collect()) and len(streamed) == 6
    with pytest.raises(SpecError):
        fan_out(whole, lambda: subs, SPECS, print, "x")
