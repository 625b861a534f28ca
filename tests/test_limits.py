"""Page limits, rate limits, type replacement and tracing."""

import time
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.types import TypeRegistry, checked_enums, schema_of
from tidemark.operators.paging import PageError, PageLimits, check_bulk, keyset_page, page, page_per_parent
from tidemark.operators.ratelimit import Limit, RequestPlan, applicable, consume, describe, effective, limit_key, parse_limit, parse_tag, rejection, windows_in_order
from tidemark.plans.spec import Attribute as A
from tidemark.plans.spec import SpecError, TableSpec
from tidemark.plans.trace import Tracer
from tidemark.streaming.ratelimit import consume_stream


def test_page_limits():
    limits = PageLimits()
    assert limits.check() == (10, None) and limits.check(first=None, last=5) == (None, 5) and limits.check(first=3) == (3, None)
    for bad in ({"first": 101}, {"first": None, "last": 101}, {"first": None}, {"first": None, "last": None}, {"first": -1}):
        with pytest.raises(PageError):
            limits.check(**bad)
    tagged = limits.for_table(TableSpec("t", (A("id", "int"),), tags={"max_records_per_page": "50", "default_records_per_page": 20}))
    assert tagged == PageLimits(20, 50)
    with pytest.raises(SpecError):
        limits.for_table(TableSpec("t", (A("id", "int"),), tags={"max_records_per_page": "-1"}))
    with pytest.raises(PageError):
        check_bulk(1001)


def test_pages(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("p"))
    assert [r.id for r in page(df, [("id", True)]).collect()] == list(range(10))
    assert [r.id for r in page(df, [("id", True)], None, 3).collect()] == [97, 98, 99]
    one = keyset_page(df, "id", 5, after=3).collect()
    assert [r.id for r in one] == [2, 1, 0] and not one[0].has_next_page
    assert keyset_page(df, "id", 5).first().has_next_page
    assert page_per_parent(df, ["p"], [("id", False)], 2).count() == 6
    nulls = spark.createDataFrame([(1,), (None,)], "id int")
    assert page(nulls, [("id", False)], 1).first().id is None


def test_tags():
    assert parse_limit("8/60s") == Limit(8, 60) and parse_limit("5/1m") == Limit(5, 1)
    tags = parse_tag("connection,field:authenticated:8/60s create:other")
    assert tags[0].operations == ("connection", "field") and tags[1].limit is None
    for bad in ("connection", "connection:a  field:b", "what:a", "field:a:x/y"):
        with pytest.raises(SpecError):
            parse_tag(bad)
    defaults = {"unauthenticated": Limit(10, 60), "authenticated": Limit(50, 60)}
    assert applicable(tags, "connection", defaults, True) == {"authenticated": Limit(8, 60), "unauthenticated": None}
    assert applicable(tags, "update", defaults, False) == {}
    assert "8 requests in 60 s" in describe(applicable(tags, "field", defaults, True), defaults)
    plan = RequestPlan()
    plan.add("books", {})
    with pytest.raises(SpecError):
        plan.add("books", {})


def brute(rows, points, length):
    state, out = {}, {}
    for key, us, i in sorted(rows, key=lambda r: (r[1], r[2])):
        opened, n = state.get(key, (None, 0))
        opened, n = (us, 1) if opened is None or us >= opened + length else (opened, n + 1)
        state[key] = (opened, n)
        out[i] = (n, n <= points)
    return out


#: Not the epoch: a watermark starts there, and what is not after it is late.
START = 1_700_000_000_000_000


def requests(spark, n=300, keys=4):
    rng = np.random.default_rng(5)
    rows = [(f"k{rng.integers(keys)}", START + int(rng.integers(0, 50)) * 1_000_000, i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "key string, us long, id long").withColumn("ts", F.timestamp_micros("us"))


def test_fixed_windows(spark):
    rows, df = requests(spark)
    got = {r.id: (r.consumed, r.allowed) for r in consume(df, "key", "ts", "id", 3, 10).collect()}
    assert got == brute(rows, 3, 10_000_000)
    free = consume(df.withColumn("key", F.lit(None).cast("string")), "key", "ts", "id", 3, 10)
    assert free.where("allowed").count() == 300 and free.where("consumed is null").count() == 300
    assert consume(df.limit(0), "key", "ts", "id", 3, 10).count() == 0
    told = consume(df, "key", "ts", "id", 3, 10).select(rejection(3).alias("e")).where("e is not null").first().e
    assert told.status == 429 and told.limit == 3 and told.remaining == 0 and 0 <= told.retry_after <= 10


def test_windows_carry_over_batches():
    keys, us = np.array(["a"] * 6 + ["b"] * 4, object), np.array([0, 1, 2, 11, 12, 30, 0, 5, 9, 10])
    whole = windows_in_order(keys, us, 10, None)[0].tolist()
    last, parts = None, []
    for lo in range(0, 10, 3):
        n, _, last = windows_in_order(keys[lo : lo + 3], us[lo : lo + 3], 10, last)
        parts += n.tolist()
    assert whole == parts == [1, 2, 3, 1, 2, 1, 1, 2, 3, 1]


def judged_stream(spark, df, parts, tmp_path, limit, seconds, pause=0.0):
    """{id: (consumed, allowed)} of a stream that gets ``parts`` one after another."""
    path, out = str(tmp_path / "in"), []
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(df.schema).parquet(path)
        query = (consume_stream(stream, "key", "ts", "id", limit, seconds).writeStream.foreachBatch(lambda b, n: out.extend(b.collect()))
                 .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        try:
            assert query.awaitTermination(240), "the stream has read all and does not end"
        finally:
            query.stop()
        time.sleep(pause)
    return {r.id: (r.consumed, r.allowed) for r in out}


def test_stream_of_requests(spark, tmp_path):
    rows, df = requests(spark, 120)
    got = judged_stream(spark, df, [df.where(F.col("us") < START + 20_000_000), df.where(F.col("us") >= START + 20_000_000)], tmp_path, 3, 10)
    assert got == brute(rows, 3, 10_000_000)


def test_stream_keeps_windows_over_a_pause(spark, tmp_path):
    """The pause between the parts is longer than a window, in which no time passes for the requests."""
    rows = [("k", START + us, i) for i, us in ((1, 0), (2, 100_000), (3, 200_000), (4, 900_000), (5, 1_100_000))]
    df = spark.createDataFrame(rows, "key string, us long, id long").withColumn("ts", F.timestamp_micros("us"))
    got = judged_stream(spark, df, [df.where("id <= 2"), df.where("id > 2")], tmp_path, 3, 1, pause=1.5)
    assert got == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, False), 5: (1, True)}


def test_precedence_and_keys(spark):
    df = spark.createDataFrame([(1, 2, 3), (None, 2, 3), (None, None, 3), (None, None, None)], "a int, b int, c int")
    assert [r[0] for r in df.select(effective(F.lit(None).cast("int"), F.col("a"), F.col("b"), F.coalesce("c", F.lit(9)))).collect()] == [1, 2, 3, 9]
    assert spark.range(1).select(limit_key(F.lit("n"), F.lit("api"), F.lit("k"))).first()[0] == "n_api:k"
    assert spark.range(1).select(limit_key(F.lit("n"), F.lit("api"), F.lit(None))).first()[0] is None


def test_types(spark):
    status = T.StructType([T.StructField("code", T.StringType())])
    spec = TableSpec("users", (A("id", "int"), A("status", "string", not_null=True, replace_type="Status"), A("list", "array<string>", replace_type="Status"), A("bad", "string", replace_type="Nope"),
                               A("kind", "string", allowed=("A", "B")), A("kinds", "array<string>", allowed=("A", "B"))))
    registry = TypeRegistry({"Status": status, "StatusInput": T.StringType()})
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        out = schema_of(spec, registry)
    assert out["status"].dataType == status and not out["status"].nullable and out["list"].dataType == T.ArrayType(status) and out["bad"].dataType == T.StringType()
    assert len(seen) == 1
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert schema_of(spec, registry, for_input=True)["status"].dataType == T.StringType()
    df = spark.createDataFrame([("A", ["A", "B"]), (None, None)], "kind string, kinds array<string>")
    assert checked_enums(df, spec).count() == 2
    with pytest.raises(Exception, match="invalid value"):
        checked_enums(spark.createDataFrame([("C", None)], "kind string, kinds array<string>"), spec).collect()


def test_tracing(spark):
    tracer = Tracer(spark)
    with pytest.raises(ValueError):
        with tracer.span("request", user="u") as outer:
            with tracer.span("plan") as inner:
                inner.attributes["plan"] = tracer.plan(spark.range(3).where("id > 1"))
            raise ValueError("no")
    assert outer.status == "error" and outer.attributes["error"] == "no" and outer.ended and inner.parent is outer and inner.status == "ok" and "Filter" in inner.attributes["plan"]
