"""Filter conditions over scalars, lists, structs and relations, for both methods."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.access import checked, granted, selectable, visible
from tidemark.operators.conditions import Registry, apply_condition, compile_condition, starts_with
from tidemark.plans.spec import Attribute as A
from tidemark.plans.spec import Relation as R
from tidemark.plans.spec import SpecError, TableSpec

ALL = ("eq", "eqIn", "range", "icontains")


def specs(method="plain"):
    m = (method,)
    return {
        "authors": TableSpec("authors", (
            A("id", "int", filters=ALL, methods=m), A("name", "string", filters=ALL, methods=m),
            A("bio", "struct<age:int,favourite_genre:string>", filters=("eq", "eqIn")), A("nicknames", "array<string>", filters=ALL, methods=m)),
            ("id",), (("name",),), (R("books", "books", ("id",), ("author_id",), referenced=True, filterable=True), R("hidden", "books", ("id",), ("author_id",)))),
        "books": TableSpec("books", (A("id", "int", filters=ALL), A("title", "string", filters=ALL, methods=m), A("author_id", "int")), ("id",)),
        "publishers": TableSpec("publishers", (A("id", "int"), A("name", "string", filters=("eq",), required=True)), ("id",)),
    }


@pytest.fixture(scope="module")
def tables(spark):
    authors = spark.createDataFrame([
        (1, "Author One", (30, "Science Fiction"), ["A1", "a_one"]), (2, "Author Two", (40, "Fantasy"), ["A2", "a_two"]),
        (3, "Author Three", (25, "Mystery"), ["A3", "a_three"])], "id int, name string, bio struct<age:int,favourite_genre:string>, nicknames array<string>")
    books = spark.createDataFrame([(1, "Book One", 1), (2, "Book Two", 2), (3, "Book Three", 3)], "id int, title string, author_id int")
    return {"authors": authors, "books": books}


MATRIX = [
    {"name": {"eq": "Author One"}}, {"name": {"icontains": "ONE"}}, {"id": {"eq": 1}}, {"id": {"eqIn": [1, 9]}}, {"id": {"range": {"to": 1}}},
    {"id": {"range": {"from": 1, "to": 1}}}, {"nicknames": {"eq": "A1"}}, {"nicknames": {"eqIn": ["A1", "zz"]}}, {"nicknames": {"icontains": "_one"}},
    {"bio": {"eq": {"age": 30, "favouriteGenre": "Science Fiction"}}}, {"bio": {"eqIn": [{"age": 30, "favouriteGenre": "Science Fiction"}, {"age": 1, "favouriteGenre": "x"}]}},
    {"books": {"title": {"icontains": "one"}}}, {"name": {"icontains": "author"}, "id": {"eq": 1}},
]


@pytest.mark.parametrize("method", ["plain", "search"])
@pytest.mark.parametrize("condition", MATRIX, ids=str)
def test_each_finds_author_one(tables, method, condition):
    s = specs(method)
    assert [r.id for r in apply_condition(tables["authors"], s["authors"], condition, tables, s).collect()] == [1]


def test_nulls(spark):
    df = spark.createDataFrame([(1, "a", ["x"]), (2, None, None), (3, "b", [None])], "id int, name string, nicknames array<string>")
    s = specs()["authors"]
    ids = lambda c: [r.id for r in apply_condition(df, s, c).orderBy("id").collect()]
    assert ids({"name": {"eq": None}}) == [2]
    assert ids({"name": {"eqIn": ["a", None]}}) == [1, 2]
    assert ids({"name": {"eqIn": []}}) == [] and ids({"name": {"eqIn": None}}) == []
    assert ids({"nicknames": {"eqIn": ["x", None]}}) == [1, 2]
    assert ids({"nicknames": {"eq": "x"}}) == [1]
    assert ids({}) == ids(None) == [1, 2, 3]


def test_range_bounds_differ_by_method(spark):
    df = spark.createDataFrame([(0,), (5,), (9,)], "id int")
    count = lambda m, b: apply_condition(df, specs(m)["authors"], {"id": {"range": b}}).count()
    assert count("plain", {"from": None}) == 0 and count("search", {"from": None}) == 3
    assert count("plain", {"to": 0}) == 1 and count("search", {"to": 0}) == 3
    assert count("plain", {"from": 5}) == 2 and count("plain", {}) == 3


def test_wildcards_stay(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), ("a%b",)], "name string")
    assert apply_condition(df, specs()["authors"], {"name": {"icontains": "A_B"}}).count() == 3
    assert apply_condition(df, specs("search")["authors"], {"name": {"icontains": "A_B"}}).count() == 1


def test_checks():
    s = specs()
    for spec, condition in ((s["authors"], {"name": {"eq": 1, "eqIn": [1]}}), (s["authors"], {"nope": {"eq": 1}}), (s["authors"], {"bio": {"range": {}}}),
                            (s["authors"], {"hidden": {}}), (s["publishers"], {})):
        with pytest.raises(SpecError):
            compile_condition(spec, condition, s)
    with pytest.raises(SpecError):
        compile_condition(s["authors"], {"books": {}}, s).own_only()


def test_registry(spark):
    registry = Registry()
    registry.add_type("eq")
    with pytest.raises(SpecError):
        registry.add_type("eq")
    registry.add_type("startsWith", "begins with")
    registry.add_method("fast", {"startsWith": starts_with, "unknown": starts_with}, on_subscription=False)
    registry.add_method("plain", {"startsWith": starts_with})
    assert set(registry.methods["fast"].applies) == {"startsWith"}
    a = A("name", "string", filters=("startsWith",), methods=("fast",))
    spec = TableSpec("t", (a,))
    df = spark.createDataFrame([("Author",), ("x",)], "name string")
    assert apply_condition(df, spec, {"name": {"startsWith": "Au"}}, registry=registry).count() == 1
    assert registry.pick(a, "startsWith", subscription=True) is registry.methods["plain"].applies["startsWith"]


def test_filters_reach_the_scan_and_relations_are_semi_joins(spark, tables, tmp_path):
    path = str(tmp_path / "t")
    tables["authors"].write.parquet(path)
    s = specs()
    df = apply_condition(spark.read.parquet(path), s["authors"], {"id": {"eq": 1}, "books": {"title": {"eq": "Book One"}}}, tables, s).select("name")
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo(id,1)" in plan and "LeftSemi" in plan and "nicknames" not in plan.split("== Physical Plan ==")[1].split("ReadSchema")[1].split("\n")[0]


def test_access(spark):
    spec = TableSpec("t", (A("id", "int"), A("org", "string"), A("secret", "string", selectable=False)), ("id",), using="org = :org", check="org = :org", insertable=("id", "org"))
    df = spark.createDataFrame([(1, "a", "s"), (2, "b'", "s"), (3, None, "s")], "id int, org string, secret string")
    assert [r.id for r in visible(df, spec, {"org": "b'"}).collect()] == [2]
    assert visible(df, spec, {}).count() == 0
    assert selectable(df, spec).columns == ["id", "org"]
    assert granted(spec, "insert", ["id"]) == ["id"]
    with pytest.raises(SpecError):
        granted(spec, "insert", ["secret"])
    with pytest.raises(Exception, match="violates the row policy"):
        checked(df, spec, {"org": "a"}).collect()
    assert checked(df.where("id = 1"), spec, {"org": "a"}).count() == 1
    assert df.select(F.count("id")).first()[0] == 3
