"""Queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ids import event_id
from tidemark.functions.json import as_map, json_diff
from tidemark.operators.access import checked, visible
from tidemark.operators.changes import capture_delete, capture_insert, capture_update, replay
from tidemark.operators.conditions import apply_condition
from tidemark.operators.modify import assignment, delete_where, follow_delete, merge_map, touched, update_where
from tidemark.operators.nested import create_nested, read_back, with_children
from tidemark.operators.paging import keyset_page, page, page_per_parent
from tidemark.operators.ratelimit import Limit, applicable, consume, consume_in_turn, effective, parse_tag
from tidemark.operators.subscriptions import SCHEMA, by_condition, deliveries, events_with_subscribers, match
from tidemark.operators.upsert import ACTION, RN, SET, ConflictError, upsert
from tidemark.plans.spec import Attribute as A
from tidemark.plans.spec import Relation as R
from tidemark.plans.spec import TableSpec
from tidemark.sources.catalog import each_entry, recordset
from tidemark.sources.retention import expired, hour_of

ALL = ("eq", "eqIn", "range", "icontains")

SPECS = {s.name: s for s in (
    TableSpec("customer", (A("c_custkey", "bigint", filters=ALL), A("c_name", "string", filters=ALL), A("c_nationkey", "int", filters=ALL),
                           A("c_acctbal", "double", filters=ALL), A("c_mktsegment", "string", filters=ALL)), ("c_custkey",), (("c_name",),),
              (R("orders", "orders", ("c_custkey",), ("o_custkey",), referenced=True, filterable=True, reciprocal="customer"),), subscribable=True,
              using="c_nationkey = int(:nation)"),
    TableSpec("orders", (A("o_orderkey", "bigint", filters=ALL), A("o_custkey", "bigint", filters=ALL), A("o_orderstatus", "string", filters=ALL),
                         A("o_totalprice", "double", filters=ALL), A("o_orderdate", "timestamp_ntz"), A("o_orderpriority", "string", filters=ALL)), ("o_orderkey",), (),
              (R("lines", "lineitem", ("o_orderkey",), ("l_orderkey",), referenced=True, filterable=True),
               R("customer", "customer", ("o_custkey",), ("c_custkey",), unique=True, filterable=True, on_delete="cascade"))),
    TableSpec("lineitem", (A("l_orderkey", "bigint", filters=ALL), A("l_partkey", "bigint"), A("l_suppkey", "bigint"), A("l_linenumber", "int", filters=ALL),
                           A("l_quantity", "double", filters=ALL), A("l_extendedprice", "double", filters=ALL), A("l_discount", "double", filters=ALL, methods=("search",)),
                           A("l_returnflag", "string", filters=ALL)), ("l_orderkey", "l_linenumber"), (),
              (R("returned", "returns", ("l_orderkey", "l_linenumber"), ("r_orderkey", "r_linenumber"), filterable=True),)),
    TableSpec("returns", (A("r_orderkey", "bigint"), A("r_linenumber", "int"), A("r_flag", "string", filters=ALL)), ("r_orderkey", "r_linenumber")),
    TableSpec("part", (A("p_partkey", "bigint", filters=ALL), A("p_name", "string", filters=ALL), A("p_brand", "string", filters=ALL), A("p_size", "int", filters=ALL),
                       A("words", "array<string>", filters=ALL), A("made", "struct<brand:string,size:int>", filters=ALL),
                       A("p_retailprice", "double", filters=ALL)), ("p_partkey",)),
    TableSpec("documents", (A("doc_id", "bigint", filters=ALL), A("text", "string", filters=ALL, methods=("search",)), A("lang", "string", filters=ALL)), ("doc_id",)),
    TableSpec("nation", (A("n_nationkey", "int", filters=ALL), A("n_name", "string", filters=ALL), A("n_regionkey", "int", filters=ALL)), ("n_nationkey",)),
    TableSpec("event", (A("event_id", "bigint", filters=ALL), A("user_id", "bigint", filters=ALL), A("event_type", "string", filters=ALL), A("value", "double", filters=ALL)),
              ("event_id",), subscribable=True),
)}

_QUERIES: dict[str, Callable] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _parts(spark, sf) -> DataFrame:
    return table(spark, sf, "part").withColumns({"words": F.split("p_name", " "), "made": F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))})


def _where(spark, sf, name, condition, *columns, df=None) -> DataFrame:
    df = table(spark, sf, name) if df is None else df
    return apply_condition(df, SPECS[name], condition).select(*columns)


# --------------------------------------------------------------- conditions
@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def cond_eq_string(spark, sf):
    return _where(spark, sf, "customer", {"c_mktsegment": {"eq": "BUILDING"}}, "c_custkey", "c_name")


@query("SELECT n_nationkey, n AS n_name FROM (SELECT n_nationkey, CASE WHEN n_regionkey <> 3 THEN n_name END AS n FROM nation) WHERE n IS NULL")
def cond_eq_null(spark, sf):
    nations = table(spark, sf, "nation").withColumn("n_name", F.when(F.col("n_regionkey") != 3, F.col("n_name")))
    return _where(spark, sf, "nation", {"n_name": {"eq": None}}, "n_nationkey", "n_name", df=nations)


@query("SELECT p_partkey, p_brand FROM part WHERE p_size IN (1, 5, 9)")
def cond_eq_in(spark, sf):
    return _where(spark, sf, "part", {"p_size": {"eqIn": [1, 5, 9]}}, "p_partkey", "p_brand", df=_parts(spark, sf))


@query("SELECT p_partkey, s AS p_size FROM (SELECT p_partkey, nullif(p_size, 7) AS s FROM part) WHERE s IN (1, 5) OR s IS NULL")
def cond_eq_in_with_null(spark, sf):
    df = _parts(spark, sf).withColumn("p_size", F.nullif("p_size", F.lit(7)))
    return _where(spark, sf, "part", {"p_size": {"eqIn": [1, 5, None]}}, "p_partkey", "p_size", df=df)


@query("SELECT p_partkey FROM part WHERE false")
def cond_eq_in_empty(spark, sf):
    return _where(spark, sf, "part", {"p_size": {"eqIn": []}}, "p_partkey", df=_parts(spark, sf))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 12")
def cond_range_closed(spark, sf):
    return _where(spark, sf, "lineitem", {"l_quantity": {"range": {"from": 10, "to": 12}}}, "l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice >= 90000")
def cond_range_open(spark, sf):
    return _where(spark, sf, "lineitem", {"l_extendedprice": {"range": {"from": 90000}}}, "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey FROM lineitem WHERE false")
def cond_range_null_bound(spark, sf):
    return _where(spark, sf, "lineitem", {"l_quantity": {"range": {"from": None, "to": 12}}}, "l_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <= 0.01")
def cond_search_range_falsy(spark, sf):
    return _where(spark, sf, "lineitem", {"l_discount": {"range": {"from": 0, "to": 0.01}}}, "l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%'")
def cond_icontains(spark, sf):
    return _where(spark, sf, "part", {"p_name": {"icontains": "RED"}}, "p_partkey", "p_name", df=_parts(spark, sf))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%r_d%t%'")
def cond_icontains_wildcard(spark, sf):
    return _where(spark, sf, "part", {"p_name": {"icontains": "r_d%t"}}, "p_partkey", "p_name", df=_parts(spark, sf))


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'red')")
def cond_array_eq(spark, sf):
    return _where(spark, sf, "part", {"words": {"eq": "red"}}, "p_partkey", df=_parts(spark, sf))


@query("SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'blue'])")
def cond_array_overlap(spark, sf):
    return _where(spark, sf, "part", {"words": {"eqIn": ["red", "blue", None]}}, "p_partkey", df=_parts(spark, sf))


@query("SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: x ILIKE '%RE%')) > 0")
def cond_array_icontains(spark, sf):
    return _where(spark, sf, "part", {"words": {"icontains": "RE"}}, "p_partkey", df=_parts(spark, sf))


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#12' AND p_size = 7")
def cond_struct_eq(spark, sf):
    return _where(spark, sf, "part", {"made": {"eq": {"brand": "Brand#12", "size": 7}}}, "p_partkey", df=_parts(spark, sf))


@query("SELECT p_partkey FROM part WHERE (p_brand, p_size) IN (('Brand#12', 7), ('Brand#23', 9))")
def cond_struct_in(spark, sf):
    return _where(spark, sf, "part", {"made": {"eqIn": [{"brand": "Brand#12", "size": 7}, {"brand": "Brand#23", "size": 9}]}}, "p_partkey", df=_parts(spark, sf))


@query("SELECT p_partkey, p_size FROM part WHERE p_brand = 'Brand#12' AND p_size BETWEEN 5 AND 30 AND p_name ILIKE '%e%'")
def cond_multi_field(spark, sf):
    return _where(spark, sf, "part", {"p_brand": {"eq": "Brand#12"}, "p_size": {"range": {"from": 5, "to": 30}}, "p_name": {"icontains": "e"}},
                  "p_partkey", "p_size", df=_parts(spark, sf))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'ndernt. is')")
def search_ngram_match(spark, sf):
    return _where(spark, sf, "documents", {"text": {"icontains": "NDERNT. Is"}}, "doc_id")


_LANGS = "(SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN lang END AS lang FROM documents)"


def _langs(spark, sf) -> DataFrame:
    """Documents whose language is missing here and there."""
    return table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"))


_SEARCHED = TableSpec("documents", (A("doc_id", "bigint"), A("lang", "string", filters=(*ALL, "startsWith"), methods=("search",))), ("doc_id",))


@query(f"SELECT doc_id, lang FROM {_LANGS} WHERE lang = 'en'")
def search_eq(spark, sf):
    return apply_condition(_langs(spark, sf), _SEARCHED, {"lang": {"eq": "en"}})


@query(f"SELECT doc_id, lang FROM {_LANGS} WHERE lang IS NULL")
def search_eq_null(spark, sf):
    return apply_condition(_langs(spark, sf), _SEARCHED, {"lang": {"eq": None}})


@query(f"SELECT doc_id, lang FROM {_LANGS} WHERE lang IN ('en', 'fr') OR lang IS NULL")
def search_eq_in_with_null(spark, sf):
    return apply_condition(_langs(spark, sf), _SEARCHED, {"lang": {"eqIn": ["en", None, "fr"]}})


@query(f"SELECT doc_id, lang FROM {_LANGS} WHERE starts_with(lang, 'e')")
def cond_starts_with(spark, sf):
    spec = TableSpec("documents", (A("doc_id", "bigint"), A("lang", "string", filters=("startsWith",))), ("doc_id",))
    return apply_condition(_langs(spark, sf), spec, {"lang": {"startsWith": "e"}})


# ---------------------------------------------------------------- relations
def _flagship(spark, sf) -> DataFrame:
    tables = {n: table(spark, sf, n) for n in ("customer", "orders", "lineitem")}
    condition = {"orders": {"o_totalprice": {"range": {"from": 100000}}}, "c_mktsegment": {"eq": "BUILDING"}}
    return apply_condition(tables["customer"], SPECS["customer"], condition, tables, SPECS)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND EXISTS "
       "(SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice >= 100000)")
def rel_exists(spark, sf):
    return _flagship(spark, sf).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND EXISTS "
       "(SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49))")
def rel_exists_nested(spark, sf):
    tables = {n: table(spark, sf, n) for n in ("customer", "orders", "lineitem")}
    condition = {"orders": {"o_orderstatus": {"eq": "F"}, "lines": {"l_quantity": {"range": {"from": 49}}}}}
    return apply_condition(tables["customer"], SPECS["customer"], condition, tables, SPECS).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2)")
def composite_key_semi(spark, sf):
    lines = table(spark, sf, "lineitem")
    returns = lines.where("l_linenumber = 2").select(F.col("l_orderkey").alias("r_orderkey"), F.col("l_linenumber").alias("r_linenumber"), F.col("l_returnflag").alias("r_flag"))
    return apply_condition(lines, SPECS["lineitem"], {"returned": {"r_flag": {"eq": "R"}}}, {"returns": returns}, SPECS).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def rel_anti(spark, sf):
    orders = table(spark, sf, "orders").where("o_totalprice > 400000").select("o_custkey")
    customers = table(spark, sf, "customer")
    return customers.join(orders, customers["c_custkey"] == orders["o_custkey"], "left_anti").select("c_custkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 7")
def row_policy(spark, sf):
    return visible(table(spark, sf, "customer"), SPECS["customer"], {"nation": "7"}).select("c_custkey", "c_nationkey")


@query("SELECT o_custkey, count(*) AS n_lines, string_agg(l_orderkey || '/' || l_linenumber, ',' ORDER BY l_orderkey, l_linenumber) AS lines "
       "FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 10 = 1 GROUP BY o_custkey")
def nested_read(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    orders = table(spark, sf, "orders").where("o_custkey % 10 = 1")
    full = with_children(orders, lines, SPECS["orders"].relation("lines"), ["l_orderkey", "l_linenumber"], "lines")
    each = full.select("o_custkey", F.explode("lines").alias("x")).select("o_custkey", "x.*")
    listed = each.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))).alias("x"))
    return listed.select("o_custkey", "n_lines", F.array_join(F.transform("x", lambda v: F.concat(v["l_orderkey"], F.lit("/"), v["l_linenumber"])), ",").alias("lines"))


@query("SELECT o_orderkey, o_custkey, count(l_orderkey) AS n_lines, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS lines "
       "FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey")
def nested_read_all(spark, sf):
    """Every order with its lines; orders without lines too."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    full = with_children(table(spark, sf, "orders"), lines, SPECS["orders"].relation("lines"), ["l_orderkey", "l_linenumber"], "lines")
    return full.select("o_orderkey", "o_custkey", F.coalesce(F.array_size("lines"), F.lit(0)).cast("long").alias("n_lines"),
                       F.array_join(F.transform("lines", lambda v: v["l_linenumber"].cast("string")), ",").alias("lines"))


# ------------------------------------------------------------------- pages
@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def page_default(spark, sf):
    return page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", False), ("o_orderkey", True)])


@query("SELECT o_orderkey, o_custkey, true AS has_next_page FROM orders WHERE o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 5")
def page_keyset_desc(spark, sf):
    return keyset_page(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 5, after=500)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def page_last(spark, sf):
    return page(table(spark, sf, "orders").select("o_orderkey"), [("o_orderkey", True)], first=None, last=7)


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def page_per_parent_q(spark, sf):
    return page_per_parent(table(spark, sf, "orders"), ["o_custkey"], [("o_totalprice", False), ("o_orderkey", True)], 3).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus, rn AS __rn FROM (SELECT *, o_orderkey % 97 AS rn FROM orders WHERE o_orderkey % 50 = 3)")
def readback_ordinal(spark, sf):
    orders = table(spark, sf, "orders")
    keys = orders.where("o_orderkey % 50 = 3").select("o_orderkey", (F.col("o_orderkey") % 97).alias(RN))
    return read_back(orders, keys, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", RN)


@query("SELECT o_orderkey, o_orderstatus, -o_orderkey AS __rn FROM orders")
def readback_ordinal_all(spark, sf):
    """Every order, each with an ordinal of its own."""
    orders = table(spark, sf, "orders")
    keys = orders.select("o_orderkey", (-F.col("o_orderkey")).alias(RN))
    return read_back(orders, keys, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", RN)


@query("SELECT (x.rn)::BIGINT AS ordinality, x.k AS k, x.v AS v FROM (SELECT unnest([{rn: 0, k: 1, v: 'a'}, {rn: 1, k: 2, v: 'b'}]) AS x)")
def json_recordset(spark, sf):
    df = spark.range(1).select(F.lit('[{"k":1,"v":"a"},{"k":2,"v":"b"}]').alias("j"))
    return recordset(df, "j", "k int, v string")


@query("SELECT row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) - 1 AS ordinality, l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def json_recordset_all(spark, sf):
    """All lines, read from one JSON array for each order."""
    line = F.struct("l_linenumber", "l_returnflag", "l_orderkey")
    df = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(line))).alias("j"))
    return recordset(df, "j", "l_orderkey bigint, l_linenumber int, l_returnflag string")


@query("SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_entries(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.parse_json("props").alias("v"))
    return each_entry(df, "v").select("event_id", "key", F.to_json("value").alias("value")).withColumn("value", F.regexp_replace("value", '^"|"$', ""))


# ----------------------------------------------------------------- upserts
_O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"
_SPEC_O = TableSpec("orders", tuple(a for a in SPECS["orders"].attributes if a.name in _O.split(", ")), ("o_orderkey",))


def _split(spark, sf, new: str) -> tuple[DataFrame, DataFrame]:
    """Orders of even keys are the table; the source are those of keys that ``new`` takes, with another status and position."""
    orders = table(spark, sf, "orders").select(*_O.split(", "))
    source = orders.where(new).select(F.col("o_orderkey").alias(RN), "o_orderkey", "o_custkey", F.lit("U").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return orders.where("o_orderkey % 2 = 0"), source


_ACTIONS = "SELECT o_orderkey, {action} AS row_action, {status} AS o_orderstatus, {price} AS o_totalprice FROM orders WHERE {where}"


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS added FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 4 = 1")
def upsert_insert(spark, sf):
    target, source = _split(spark, sf, "o_orderkey % 4 = 1")
    return upsert(target, source, _SPEC_O, "error").target.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("keys"), F.count_if(F.col("o_orderkey") % 2 == 1).alias("added"))


@query(_ACTIONS.format(action="CASE WHEN o_orderkey % 2 = 0 THEN 'EXISTING' ELSE 'INSERT' END", status="CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'U' END",
                       price="CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice + 1 END", where="o_orderkey % 3 = 0"))
def upsert_ignore(spark, sf):
    target, source = _split(spark, sf, "o_orderkey % 3 = 0")
    return upsert(target, source, _SPEC_O, "ignore").rows.select("o_orderkey", ACTION, "o_orderstatus", "o_totalprice")


@query(_ACTIONS.format(action="CASE WHEN o_orderkey % 2 = 0 THEN 'UPDATE' ELSE 'INSERT' END",
                       status="CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 9 = 0 THEN o_orderstatus ELSE CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'U' END END",
                       price="o_totalprice + 1", where="o_orderkey % 3 = 0"))
def upsert_replace(spark, sf):
    target, source = _split(spark, sf, "o_orderkey % 3 = 0")
    full = F.array(*[F.lit(c) for c in _O.split(", ")])
    partial = F.array(*[F.lit(c) for c in _O.split(", ") if c != "o_orderstatus"])
    source = source.withColumn(SET, F.when(F.col("o_orderkey") % 9 == 0, partial).otherwise(full))
    return upsert(target, source, _SPEC_O, "replace").rows.select("o_orderkey", ACTION, "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, "
       "CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def upsert_update_cols(spark, sf):
    target, source = _split(spark, sf, "o_orderkey % 3 = 0")
    return upsert(target, source, _SPEC_O, "update", ["o_orderstatus"]).target.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT rn AS __rn, CASE WHEN first < rn THEN 'DUPLICATE' WHEN k % 2 = 0 THEN 'EXISTING' ELSE 'INSERT' END AS row_action, k AS o_orderkey "
       "FROM (SELECT *, min(rn) OVER (PARTITION BY k) AS first FROM (SELECT o_orderkey AS rn, o_orderkey - o_orderkey % 4 + (o_orderkey % 4) // 2 AS k FROM orders))")
def upsert_dedupe_actions(spark, sf):
    _, source = _split(spark, sf, "true")
    key = F.col("o_orderkey") - F.col("o_orderkey") % 4 + F.floor((F.col("o_orderkey") % 4) / 2)
    evens = source.select(key.alias("o_orderkey")).where("o_orderkey % 2 = 0").distinct()
    target = evens.select("o_orderkey", F.lit(0).cast("long").alias("o_custkey"), F.lit("T").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice"))
    return upsert(target, source.withColumn("o_orderkey", key), _SPEC_O, "ignore").rows.select(RN, ACTION, "o_orderkey")


_TWO_KEYS = TableSpec("customer", tuple(a for a in SPECS["customer"].attributes if a.name in ("c_custkey", "c_name", "c_acctbal")), ("c_custkey",), (("c_name",),))


@query("SELECT c_custkey AS __rn, CASE WHEN c_custkey % 4 IN (0, 2) THEN 'EXISTING' WHEN c_custkey % 4 = 1 THEN 'INSERT' ELSE 'DUPLICATE' END AS row_action, "
       "CASE c_custkey % 4 WHEN 2 THEN c_custkey WHEN 3 THEN c_custkey - 2 ELSE c_custkey END AS c_custkey FROM customer WHERE c_custkey % 4 <> 3 OR c_custkey > 2")
def upsert_two_keys(spark, sf):
    """Even customers exist: those of 4 are met by key, the others by name; one in four repeats the name of a new one."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    k = F.col("c_custkey")
    before = rows.select((k + 2).alias("c_custkey"), F.col("c_name").alias("before"))
    named = rows.join(before, "c_custkey", "left").where((k % 4 != 3) | (k > 2))
    source = named.select(k.alias(RN), F.when(k % 4 == 2, k + 1_000_000_000).when(k % 4 == 3, k + 2_000_000_000).otherwise(k).alias("c_custkey"),
                          F.when(k % 4 == 0, F.concat("c_name", F.lit("!"))).when(k % 4 == 3, F.col("before")).otherwise(F.col("c_name")).alias("c_name"), "c_acctbal")
    return upsert(rows.where("c_custkey % 2 = 0"), source, _TWO_KEYS, "ignore").rows.select(RN, ACTION, "c_custkey")


@query("SELECT true AS refused, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0")
def upsert_error_conflict(spark, sf):
    """A batch that meets the table is refused as a whole, and the table stays."""
    target, source = _split(spark, sf, "o_orderkey % 3 = 0")
    refused = False
    try:
        target = upsert(target, source, _SPEC_O, "error").target
    except ConflictError:
        refused = True
    return target.agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'OPEN' ELSE o_orderstatus END AS o_orderstatus, 0.5::DOUBLE AS o_totalprice FROM orders")
def upsert_defaults(spark, sf):
    """Absent columns get their defaults: the price in all rows, the status in those of even keys."""
    spec = TableSpec("orders", (A("o_orderkey", "bigint"), A("o_orderstatus", "string", default="'OPEN'"), A("o_totalprice", "double", default="0.5")), ("o_orderkey",))
    some = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("o_orderkey"))).otherwise(F.array(F.lit("o_orderkey"), F.lit("o_orderstatus")))
    source = table(spark, sf, "orders").select(F.col("o_orderkey").alias(RN), some.alias(SET), "o_orderkey", "o_orderstatus")
    return upsert(spark.createDataFrame([], spec.partial_struct()), source, spec, "error").target


_NEW = [("new a", 3, ["O", "F"]), ("new b", 5, []), ("new c", 3, ["P"])]


@query("SELECT m + 1 + 0 AS c_custkey, 'new a' AS c_name, 'F,O' AS statuses, n + 3 AS orders_after FROM (SELECT max(c_custkey) AS m FROM customer), (SELECT count(*) AS n FROM orders) "
       "UNION ALL SELECT m + 1 + 3, 'new b', '', n + 3 FROM (SELECT max(c_custkey) AS m FROM customer), (SELECT count(*) AS n FROM orders) "
       "UNION ALL SELECT m + 1 + 4, 'new c', 'P', n + 3 FROM (SELECT max(c_custkey) AS m FROM customer), (SELECT count(*) AS n FROM orders)")
def nested_create(spark, sf):
    """Customers with orders in one request: orders get the key that their customer got."""
    names = ("c_custkey", "c_name", "c_nationkey")
    specs = {"customer": TableSpec("customer", tuple(a for a in SPECS["customer"].attributes if a.name in names), ("c_custkey",), (),
                                   (R("orders", "orders", ("c_custkey",), ("o_custkey",), referenced=True, reciprocal="customer"),)),
             "orders": TableSpec("orders", tuple(a for a in SPECS["orders"].attributes if a.name in _O.split(", ")), ("o_orderkey",), (),
                                 (R("customer", "customer", ("o_custkey",), ("c_custkey",), unique=True, reciprocal="orders"),))}
    tables = {"customer": table(spark, sf, "customer").select(*names), "orders": table(spark, sf, "orders").select(*_O.split(", "))}
    items = [{"c_name": n, "c_nationkey": k, "orders": [{"o_orderstatus": s, "o_totalprice": 1.0} for s in statuses]} for n, k, statuses in _NEW]
    after, rows = create_nested(spark, items, specs["customer"], specs, tables)
    listed = rows["orders"].groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_list("o_orderstatus")), ",").alias("statuses"))
    total = after["orders"].agg(F.count(F.lit(1)).alias("orders_after"))
    return (rows["customer"].select("c_custkey", "c_name").join(listed, "c_custkey", "left").crossJoin(F.broadcast(total))
            .select("c_custkey", "c_name", F.coalesce("statuses", F.lit("")).alias("statuses"), "orders_after"))


# ------------------------------------------------------------ modifications
@query("SELECT c_custkey, 'X-' || c_name AS c_name, 0.0::DOUBLE AS c_acctbal FROM customer WHERE c_acctbal <= 0")
def bulk_update_postimage(spark, sf):
    patch = {"c_acctbal": 0.0, "c_name": F.concat(F.lit("X-"), F.col("c_name"))}
    return update_where(table(spark, sf, "customer"), SPECS["customer"], {"c_acctbal": {"range": {"to": 0}}}, patch).rows.select("c_custkey", "c_name", "c_acctbal")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY'")
def bulk_delete_preimage(spark, sf):
    return delete_where(table(spark, sf, "customer"), SPECS["customer"], {"c_mktsegment": {"eq": "MACHINERY"}}).rows.select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def delete_cascade(spark, sf):
    gone = delete_where(table(spark, sf, "customer"), SPECS["customer"], {"c_mktsegment": {"eq": "MACHINERY"}}).rows
    return follow_delete(table(spark, sf, "orders"), SPECS["orders"], gone, "customer").select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE o_custkey END AS o_custkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def delete_set_null(spark, sf):
    """Orders stay and lose the deleted customer."""
    spec = TableSpec("orders", SPECS["orders"].attributes, ("o_orderkey",), (), (R("customer", "customer", ("o_custkey",), ("c_custkey",), unique=True, on_delete="set null"),))
    gone = delete_where(table(spark, sf, "customer"), SPECS["customer"], {"c_mktsegment": {"eq": "MACHINERY"}}).rows
    return follow_delete(table(spark, sf, "orders"), spec, gone, "customer").select("o_orderkey", "o_custkey")


@query("SELECT true AS refused, (SELECT count(*) FROM customer WHERE c_nationkey = 7) AS kept")
def policy_check(spark, sf):
    """Written rows have to satisfy the policy: one nation's pass, all nations' are refused."""
    spec = TableSpec("customer", SPECS["customer"].attributes, ("c_custkey",), check="c_nationkey = int(:nation)")
    customers = table(spark, sf, "customer")
    try:
        refused = checked(customers, spec, {"nation": "7"}).count() < 0
    except Exception as e:  # noqa: BLE001 - the task's error comes as the engine's own
        refused = "violates the row policy" in str(e)
    return checked(customers.where("c_nationkey = 7"), spec, {"nation": "7"}).agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("kept"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_orderpriority END AS assignee, CASE WHEN o_orderkey % 3 = 0 THEN 'boss' END AS assigned_by, "
       "CASE WHEN o_orderkey % 3 = 0 THEN '2024-05-05' WHEN o_orderkey % 2 = 0 THEN '2023-01-01' END AS assigned_at, "
       "CASE WHEN o_orderkey % 2 = 0 THEN '2023-01-01' WHEN o_orderkey % 3 = 0 THEN '2024-05-05' END AS first_assigned_at, '2024-05-05' AS updated_at FROM orders")
def write_hooks(spark, sf):
    """Assignees of every third order change; the first assignment keeps its date."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    first = F.when(k % 2 == 0, F.lit("2023-01-01"))
    before = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("assignee"), none.alias("assigned_by"), first.alias("assigned_at"), first.alias("first_assigned_at"))
    after = before.withColumn("assignee", F.when(k % 3 == 0, F.lit("x")).otherwise(F.col("assignee")))
    now = F.lit("2024-05-05")
    return touched(assignment(after, before, ["o_orderkey"], F.lit("boss"), now), now=now)


@query("SELECT user_id, event_type AS name, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE event_type <> 'click'")
def json_merge_tags(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    parents = counts.select("user_id").distinct().withColumn("tags", F.lit(None).cast("map<string,bigint>"))
    merged = merge_map(parents, "user_id", "tags", counts, counts.where("name = 'click'").select("user_id", "name"))
    return merged.select("user_id", F.explode("tags").alias("name", "n"))


@query("SELECT c_custkey, lower(c_name) || '|' || lower(c_mktsegment) AS search FROM customer")
def generated_search_column(spark, sf):
    spec = TableSpec("c", (A("c_custkey", "bigint"), A("c_name", "string"), A("c_mktsegment", "string"),
                           A("search", "string", generated="concat_ws('|', lower(c_name), lower(c_mktsegment))")), ("c_custkey",))
    source = table(spark, sf, "customer").select(F.col("c_custkey").alias(RN), "c_custkey", "c_name", "c_mktsegment")
    empty = spark.createDataFrame([], spec.partial_struct())
    return upsert(empty, source, spec, "error").target.select("c_custkey", "search")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 100 = 7")
def nested_insert_keys(spark, sf):
    """Lines get the key that their order got when it was written."""
    orders = table(spark, sf, "orders").where("o_orderkey % 100 = 7").select(F.col("o_orderkey").alias(RN), "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    empty = spark.createDataFrame([], _SPEC_O.partial_struct())
    written = upsert(empty, orders, _SPEC_O, "error").rows
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("__parent"), "l_linenumber")
    return lines.join(written, lines["__parent"] == written[RN]).select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def nested_insert_keys_all(spark, sf):
    """All orders are written, and all lines get the key that their order got."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias(RN), "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    written = upsert(spark.createDataFrame([], _SPEC_O.partial_struct()), orders, _SPEC_O, "error").rows
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("__parent"), "l_linenumber")
    return lines.join(written, lines["__parent"] == written[RN]).select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "o_custkey")


# ------------------------------------------------------------------ changes
def _ts():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def _before_after(spark, sf) -> tuple[DataFrame, DataFrame]:
    before = table(spark, sf, "customer")
    after = before.withColumns({"c_acctbal": F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")),
                                "c_mktsegment": F.when(F.col("c_custkey") % 5 == 0, F.lit("NEW")).when(F.col("c_custkey") % 7 == 0, F.lit(None)).otherwise(F.col("c_mktsegment"))})
    return before, after


@query("SELECT c_custkey AS k, c_name AS name, 'public.customer.INSERT' AS topic FROM customer WHERE c_nationkey = 3")
def capture_insert_q(spark, sf):
    ev = capture_insert(table(spark, sf, "customer").where("c_nationkey = 3"), SPECS["customer"], _ts())
    return ev.select(F.variant_get("row_data", "$.c_custkey", "bigint").alias("k"), F.variant_get("row_data", "$.c_name", "string").alias("name"), "topic")


@query("SELECT c_custkey AS k, c_acctbal AS bal, 'DELETE' AS op FROM customer WHERE c_nationkey = 4")
def capture_delete_q(spark, sf):
    ev = capture_delete(table(spark, sf, "customer").where("c_nationkey = 4"), SPECS["customer"], _ts())
    return ev.select(F.variant_get("row_data", "$.c_custkey", "bigint").alias("k"), F.variant_get("row_data", "$.c_acctbal", "double").alias("bal"), "op")


_DIFF = ("SELECT c_custkey AS k, 'c_acctbal' AS key, (c_acctbal + 1)::VARCHAR IS NOT NULL AS some FROM customer WHERE c_custkey % 3 = 0 UNION ALL "
         "SELECT c_custkey, 'c_mktsegment', true FROM customer WHERE c_custkey % 5 = 0")


@query(_DIFF)
def capture_update_q(spark, sf):
    ev = capture_update(*_before_after(spark, sf), SPECS["customer"], _ts())
    return ev.select(F.variant_get("row_before", "$.c_custkey", "bigint").alias("k"), F.explode(F.map_keys(as_map(F.col("diff")))).alias("key"), F.lit(True).alias("some"))


@query("SELECT c_custkey AS k, (c_acctbal + 1) AS bal FROM customer WHERE c_custkey % 3 = 0")
def json_diff_q(spark, sf):
    before, after = _before_after(spark, sf)
    old = before.select(F.col("c_custkey").alias("k"), F.to_variant_object(F.struct("c_acctbal", "c_mktsegment")).alias("a"))
    new = after.select(F.col("c_custkey").alias("k"), F.to_variant_object(F.struct("c_acctbal", "c_mktsegment")).alias("b"))
    diff = old.join(new, "k").select("k", json_diff(F.col("b"), F.col("a")).alias("d"))
    return diff.select("k", F.variant_get("d", "$.c_acctbal", "double").alias("bal")).where("bal IS NOT NULL")


@query("SELECT event_id, 'ps' || lpad(lower(to_hex(epoch_us(ts))), 13, '0') || lpad(lower(to_hex(event_id)), 9, '0') AS id FROM events")
def event_id_q(spark, sf):
    return table(spark, sf, "events").select("event_id", event_id(F.col("ts"), F.col("event_id")).alias("id"))


def _log(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "ts")
    image = F.to_variant_object(F.struct("event_id", "user_id", "event_type", "value"))
    changed = F.to_variant_object(F.struct(F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("user_id")))
    return ev.select(event_id(F.col("ts"), F.col("event_id")).alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.lit("event").alias("table_name"),
                     F.lit("public").alias("schema_name"), F.lit("UPDATE").alias("op"), F.lit("public.event.UPDATE").alias("topic"),
                     image.alias("row_before"), image.alias("row_data"), json_diff(changed, F.parse_json(F.lit("{}"))).alias("diff"), F.col("event_id"))


_SUBS = """SELECT 's' || user_id || '-' || kind AS sub_id, user_id, kind FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(['type', 'value', 'all', 'gate']) AS kind)
           WHERE kind <> 'all' OR user_id % 50 = 0"""


def _subs(spark, sf) -> DataFrame:
    """Four templates over users: equality, equality and range, everything, and a gate on the changed columns."""
    users = table(spark, sf, "events").select("user_id").distinct()
    u = F.col("user_id").cast("string")
    none, user_only = F.lit(None).cast("array<string>"), '{"user_id": {"eq": {"$": 1}}}'

    def kind(name: str, template: str | None, params, fields=none):
        return F.struct(F.lit(name).alias("kind"), F.lit(template).cast("string").alias("template"), params.cast("array<string>").alias("params"), fields.alias("f"))

    kinds = F.array(
        kind("type", '{"event_type": {"eq": {"$": 2}}, "user_id": {"eq": {"$": 1}}}', F.array(u, F.lit("click"))),
        kind("value", '{"user_id": {"eq": {"$": 1}}, "value": {"range": {"from": {"$": 2}}}}', F.array(u, F.lit("50"))),
        kind("all", None, F.array()), kind("gate", user_only, F.array(u), F.array(F.lit("user_id"))))
    rows = users.select("user_id", F.explode(kinds).alias("k")).where("k.kind <> 'all' OR user_id % 50 = 0")
    return rows.select(F.concat(F.lit("s"), u, F.lit("-"), F.col("k.kind")).alias("id"), F.lit(None).cast("timestamp").alias("created_at"), F.lit("w").alias("worker_device_id"),
                       F.lit("public.event.UPDATE").alias("topic"), F.col("k.template").alias("template"), F.col("k.params").alias("params"),
                       F.col("k.f").alias("diff_only_fields"), F.lit(True).alias("is_temporary"), F.lit("updated").alias("type")).to(T.StructType.fromDDL(SCHEMA))


_FANOUT = f"""SELECT event_id, sub_id FROM events JOIN ({_SUBS}) s ON
  (kind = 'type' AND events.user_id = s.user_id AND event_type = 'click') OR (kind = 'value' AND events.user_id = s.user_id AND value >= 50)
  OR kind = 'all' OR (kind = 'gate' AND events.user_id = s.user_id AND event_id % 3 = 0)"""


@query(_FANOUT)
def fanout_match(spark, sf):
    found = match(_log(spark, sf), _subs(spark, sf), SPECS, ("event_id",))
    return found.select("event_id", F.col("subscription_id").alias("sub_id"))


@query(f"SELECT event_id, sub_id FROM ({_FANOUT}) WHERE sub_id LIKE '%-gate'")
def fanout_diff_gate(spark, sf):
    found = match(_log(spark, sf), _subs(spark, sf).where("diff_only_fields IS NOT NULL"), SPECS, ("event_id",))
    return found.select("event_id", F.col("subscription_id").alias("sub_id"))


@query(f"SELECT event_id, string_agg(sub_id, ',' ORDER BY sub_id) AS subs FROM ({_FANOUT}) GROUP BY event_id")
def fanout_subscribers(spark, sf):
    log = _log(spark, sf).select("id", "topic", "event_id", "row_data", "diff")
    some, every = by_condition(_subs(spark, sf))
    found = events_with_subscribers(log.select("id", "topic", "event_id"), match(log, some, SPECS), every)
    return found.select("event_id", F.array_join("subscription_ids", ",").alias("subs"))


@query(f"SELECT sub_id, count(*) AS n, max('ps' || lpad(lower(to_hex(epoch_us(ts))), 13, '0') || lpad(lower(to_hex(event_id)), 9, '0')) AS event_id FROM ({_FANOUT}) JOIN events USING (event_id) GROUP BY sub_id")
def fanout_batches(spark, sf):
    found = deliveries(_log(spark, sf).drop("event_id"), _subs(spark, sf), SPECS)
    sizes = found.select(F.col("subscription_id").alias("sub_id"), F.size("items").cast("long").alias("n"), "event_id")
    return sizes.groupBy("sub_id").agg(F.sum("n").alias("n"), F.max("event_id").alias("event_id"))


@query("""SELECT id FROM (SELECT 'ps' || lpad(lower(to_hex(epoch_us(ts))), 13, '0') || lpad(lower(to_hex(event_id)), 9, '0') AS id FROM events)
          WHERE id > 'ps60e' AND id < 'ps60f' ORDER BY id LIMIT 100""")
def cursor_window(spark, sf):
    log = table(spark, sf, "events").select(event_id(F.col("ts"), F.col("event_id")).alias("id"))
    return replay(log, "ps60e", "ps60f", 100)


@query("SELECT strftime(ts, '%Y%m%d%H') AS hour, count(*) AS n FROM events WHERE strftime(ts, '%Y%m%d%H') < '2024011510' GROUP BY 1")
def retention_partitions(spark, sf):
    hours = table(spark, sf, "events").select(hour_of(F.col("ts")).alias("hour"))
    return expired(hours, F.lit("2024-01-15 12:30:00").cast("timestamp")).groupBy("hour").agg(F.count(F.lit(1)).alias("n"))


# -------------------------------------------------------------- rate limits
@query("""WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  w AS (SELECT event_id, user_id, rn, us AS opened, 1::BIGINT AS n FROM r WHERE rn = 1
        UNION ALL SELECT r.event_id, r.user_id, r.rn, CASE WHEN r.us >= w.opened + 43200000000 THEN r.us ELSE w.opened END,
                         CASE WHEN r.us >= w.opened + 43200000000 THEN 1 ELSE w.n + 1 END FROM w JOIN r ON r.user_id = w.user_id AND r.rn = w.rn + 1)
  SELECT event_id, user_id, n AS consumed, n <= 3 AS allowed, greatest(3 - n, 0)::BIGINT AS remaining FROM w""")
def rate_limit_fixed_window(spark, sf):
    requests = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return consume(requests, "user_id", "ts", "event_id", 3, 43200).select("event_id", "user_id", "consumed", "allowed", "remaining")


@query("""WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  w AS (SELECT event_id, user_id, rn, us AS opened, 1::BIGINT AS n FROM r WHERE rn = 1
        UNION ALL SELECT r.event_id, r.user_id, r.rn, CASE WHEN r.us >= w.opened + 86400000000 THEN r.us ELSE w.opened END,
                         CASE WHEN r.us >= w.opened + 86400000000 THEN 1 ELSE w.n + 1 END FROM w JOIN r ON r.user_id = w.user_id AND r.rn = w.rn + 1),
  r2 AS (SELECT w.event_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, w.event_id) AS rn FROM w JOIN events USING (event_id) WHERE n <= 2),
  w2 AS (SELECT event_id, event_type, rn, us AS opened, 1::BIGINT AS n FROM r2 WHERE rn = 1
         UNION ALL SELECT r2.event_id, r2.event_type, r2.rn, CASE WHEN r2.us >= w2.opened + 86400000000 THEN r2.us ELSE w2.opened END,
                          CASE WHEN r2.us >= w2.opened + 86400000000 THEN 1 ELSE w2.n + 1 END FROM w2 JOIN r2 ON r2.event_type = w2.event_type AND r2.rn = w2.rn + 1)
  SELECT w.event_id, w.n <= 2 AND w2.n <= 3 AS allowed, CASE WHEN w.n > 2 THEN 'user' WHEN w2.n > 3 THEN 'kind' END AS rejected_by FROM w LEFT JOIN w2 USING (event_id)""")
def rate_limits_in_turn(spark, sf):
    """Two a day for each user, then three a day for each kind of event among those that are left."""
    requests = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    limits = [("user", "user_id", Limit(2, 86400)), ("kind", "event_type", Limit(3, 86400))]
    return consume_in_turn(requests, limits, "ts", "event_id").select("event_id", "allowed", "rejected_by")


@query("SELECT event_type, CASE event_type WHEN 'click' THEN 'a:5,b:9' WHEN 'view' THEN 'b:9' ELSE 'b:9' END AS limits FROM (SELECT DISTINCT event_type FROM events)")
def rate_limit_tags(spark, sf):
    """Limits of a field's tag and the named defaults that apply to each kind of event, as operations of root fields."""
    tags, defaults = parse_tag("create:a:5/60 field:c:7/10"), {"b": Limit(9, 60)}
    found = {k: applicable(tags, "create" if k == "click" else "update", defaults, root=True) for k in ("click", "other")}
    text = {k: ",".join(f"{n}:{(x or defaults[n]).points}" for n, x in sorted(v.items())) for k, v in found.items()}
    kinds = table(spark, sf, "events").select("event_type").distinct()
    return kinds.select("event_type", F.when(F.col("event_type") == "click", text["click"]).otherwise(text["other"]).alias("limits"))


@query("SELECT event_id, coalesce(nullif(user_id % 7, 0), nullif(user_id % 5, 0), CASE WHEN event_type = 'click' THEN 8 END, 50)::INT AS points FROM events")
def rate_limit_precedence(spark, sf):
    u = F.col("user_id")
    points = effective(F.nullif(u % 7, F.lit(0)), F.nullif(u % 5, F.lit(0)), F.when(F.col("event_type") == "click", 8), F.lit(50))
    return table(spark, sf, "events").select("event_id", points.cast("int").alias("points"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of one segment with a large order, the default page by key."""
    return page(_flagship(spark, sf), [("c_custkey", True)])


@query("SELECT c_custkey, c_name, c_acctbal, c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND EXISTS "
       "(SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice >= 100000) ORDER BY c_custkey LIMIT 10")
def flagship_page(spark, sf):
    return flagship(spark, sf)


def queries() -> dict[str, Callable]:
    return {name.removesuffix("_q"): f for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name.removesuffix("_q"): sql for name, sql in _ORACLE.items()}
