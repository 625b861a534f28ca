"""Conflict policies, dedupe, actions, nested creates and modifications."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.modify import assignment, delete_where, follow_delete, merge_map, touched, update_where
from tidemark.operators.nested import create_nested, layers, plan_rows, with_children
from tidemark.operators.paging import PageError
from tidemark.operators.upsert import ACTION, RN, SET, ConflictError, upsert
from tidemark.plans.spec import Attribute as A
from tidemark.plans.spec import Relation as R
from tidemark.plans.spec import SpecError, TableSpec

AUTHORS = TableSpec("authors", (A("id", "int"), A("name", "string", not_null=True), A("nickname", "string", default="'none'")), ("id",), (("name",),),
                    (R("books", "books", ("id",), ("author_id",), referenced=True, reciprocal="author"),))
BOOKS = TableSpec("books", (A("id", "int"), A("title", "string"), A("author_id", "int"), A("publisher_id", "int")), ("id",), (),
                  (R("author", "authors", ("author_id",), ("id",), unique=True, reciprocal="books", on_delete="cascade"),
                   R("publisher", "publishers", ("publisher_id",), ("id",), unique=True, reciprocal="books", on_delete="set null")))
PUBLISHERS = TableSpec("publishers", (A("id", "int"), A("name", "string")), ("id",), (), (R("books", "books", ("id",), ("publisher_id",), referenced=True, reciprocal="publisher"),))
SPECS = {s.name: s for s in (AUTHORS, BOOKS, PUBLISHERS)}


def source(spark, rows, columns):
    kinds = {"id": "int", "name": "string", "nickname": "string"}
    ddl = f"{RN} long, {SET} array<string>, " + ", ".join(f"{c} {kinds[c]}" for c in columns)
    return spark.createDataFrame([(i, sorted(r), *[r.get(c) for c in columns]) for i, r in enumerate(rows)], ddl)


def empty(spark, spec=AUTHORS):
    return spark.createDataFrame([], spec.partial_struct())


def frozen(df):
    """A small table as local rows, so that a chain of writes stays short."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def acted(result):
    return [(r[ACTION], r["name"], r["nickname"]) for r in result.rows.orderBy(RN).collect()]


def names(*n):
    return [{"name": x} for x in n]



def test_ignore(spark):
    first = upsert(empty(spark), source(spark, names("Author 1", "Author 2", "Author 3"), ["name"]), AUTHORS, "ignore")
    assert [a for a, *_ in acted(first)] == ["INSERT"] * 3 and acted(first)[0][2] == "none"
    again = upsert(frozen(first.target), source(spark, names("Author 1", "Author 2", "Author 3", "Author 4"), ["name"]), AUTHORS, "ignore")
    assert again.counts() == (4, 1)
    assert [a for a, *_ in acted(again)] == ["EXISTING"] * 3 + ["INSERT"]
    ids = [r.id for r in again.target.orderBy("id").collect()]
    assert len(ids) == len(set(ids)) == 4


def test_duplicates_in_a_batch(spark):
    got = upsert(empty(spark), source(spark, names("Author 10", "Author 10", "Author 11"), ["name"]), AUTHORS, "ignore")
    rows = got.rows.orderBy(RN).collect()
    assert got.counts() == (3, 2) and rows[0].id == rows[1].id and [r[ACTION] for r in rows] == ["INSERT", "DUPLICATE", "INSERT"]
    old = frozen(got.target)
    both = upsert(old, source(spark, names("Author 10", "Author 10"), ["name"]), AUTHORS, "ignore")
    assert [a for a, *_ in acted(both)] == ["EXISTING", "DUPLICATE"]


def test_replace_keeps_absent_columns(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], AUTHORS.partial_struct())
    rows = [{"name": "a", "nickname": "new"}, {"name": "b"}, {"name": "c", "nickname": None}, {"name": "d"}]
    got = upsert(old, source(spark, rows, ["name", "nickname"]), AUTHORS, "replace")
    assert acted(got) == [("UPDATE", "a", "new"), ("UPDATE", "b", "y"), ("INSERT", "c", None), ("INSERT", "d", "none")]
    assert got.counts() == (4, 4)
    same = upsert(old, source(spark, [{"name": "z", "nickname": "Testing"}, {"name": "z", "nickname": "Other"}], ["name", "nickname"]), AUTHORS, "replace")
    assert acted(same) == [("INSERT", "z", "Testing"), ("DUPLICATE", "z", "Testing")]
    ignored = upsert(old, source(spark, rows[:1], ["name", "nickname"]), AUTHORS, "replace", updatable=False)
    assert acted(ignored) == [("EXISTING", "a", "x")]


def test_buckets_are_folded_in_order(spark):
    rows = [{"name": "q"}, {"name": "q", "nickname": "later"}]
    got = upsert(empty(spark), source(spark, rows, ["name", "nickname"]), AUTHORS, "replace")
    assert [a for a, *_ in acted(got)] == ["INSERT", "UPDATE"]
    assert [(r.name, r.nickname) for r in got.target.collect()] == [("q", "later")]


def test_update_columns_and_error(spark):
    old = spark.createDataFrame([(1, "a", "x")], AUTHORS.partial_struct())
    new = spark.createDataFrame([(0, 1, "b", "n")], f"{RN} long, id int, name string, nickname string")
    assert [tuple(r) for r in upsert(old, new, AUTHORS, "update", ["nickname"]).target.collect()] == [(1, "a", "n")]
    with pytest.raises(ConflictError):
        upsert(old, new, AUTHORS, "error")
    with pytest.raises(ConflictError):
        upsert(empty(spark), source(spark, names("a", "a"), ["name"]), AUTHORS, "error")
    with pytest.raises(SpecError):
        upsert(old, new, AUTHORS, "sometimes")


def test_rows_that_contradict(spark):
    """r1~r2 by id, r2~r3 by name: r3 has no kept row to follow."""
    rows = [{"id": 1, "name": "a"}, {"id": 1, "name": "b"}, {"id": 2, "name": "b"}]
    got = upsert(empty(spark), source(spark, rows, ["id", "name"]), AUTHORS, "ignore")
    with pytest.raises(Exception, match="itself a duplicate"):
        got.rows.collect()


def test_properties(spark):
    """As many rows as came in, ignore is idempotent, and null keys never conflict."""
    rng = random.Random(3)
    for _ in range(4):
        rows = [{"name": rng.choice("abcdefgh")} if rng.random() < 0.8 else {"name": None} for _ in range(12)]
        src = source(spark, rows, ["name"])
        got = upsert(empty(spark), src, AUTHORS, "ignore")
        assert got.counts()[0] == 12
        nulls = sum(r["name"] is None for r in rows)
        table = frozen(got.target)
        assert table.count() == len({r["name"] for r in rows} - {None}) + nulls
        again = upsert(table, source(spark, [r for r in rows if r["name"]], ["name"]), AUTHORS, "ignore")
        assert again.counts()[1] == 0 and again.target.count() == table.count()


def test_plan_has_no_nested_loop(spark):
    got = upsert(empty(spark), source(spark, names("a"), ["name"]), AUTHORS, "ignore")
    text = got.rows._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "CartesianProduct" not in text


ITEMS = [{"name": "A1", "books": [{"title": "B1", "publisher": {"name": "P1"}}, {"title": "B2"}]}, {"name": "A2", "books": [{"title": "B3"}, {"title": "B4"}]}]


def test_nested(spark):
    tables = {n: empty(spark, s) for n, s in SPECS.items()}
    new, rows = create_nested(spark, ITEMS, AUTHORS, SPECS, tables, "ignore")
    new = {n: frozen(df) for n, df in new.items()}
    got = new["books"].join(new["authors"].select(F.col("id").alias("author_id"), "name"), "author_id").orderBy("title").collect()
    assert [(r.title, r.name) for r in got] == [("B1", "A1"), ("B2", "A1"), ("B3", "A2"), ("B4", "A2")]
    assert [r.publisher_id is None for r in got] == [False, True, True, True]
    again, rows = create_nested(spark, ITEMS, AUTHORS, SPECS, new, "ignore")
    assert [r[ACTION] for r in rows["authors"].collect()] == ["EXISTING"] * 2
    assert again["books"].count() == 8  # books have no other key
    full = with_children(new["authors"], new["books"], AUTHORS.relation("books"), ["title"], "books").orderBy("id").collect()
    assert [b.title for b in full[0].books] == ["B1", "B2"]
    with pytest.raises(ConflictError):
        create_nested(spark, ITEMS, AUTHORS, SPECS, new, "error")


def test_nested_checks():
    with pytest.raises(SpecError, match="leads back"):
        plan_rows([{"name": "a", "books": [{"title": "t", "author": {"name": "b"}}]}], AUTHORS, SPECS)
    with pytest.raises(SpecError, match="takes one"):
        plan_rows([{"title": "t", "author": [{"name": "a"}, {"name": "b"}]}], BOOKS, SPECS)
    with pytest.raises(PageError):
        plan_rows([], AUTHORS, SPECS)
    with pytest.raises(PageError):
        plan_rows(ITEMS, AUTHORS, SPECS, most=3)
    rows = plan_rows(ITEMS, AUTHORS, SPECS)
    rows[0].waits.append((rows[1].position, BOOKS.relations[0]))
    with pytest.raises(SpecError, match="circle"):
        layers(rows)


def test_update_and_delete(spark):
    spec = TableSpec("authors", (A("id", "int", filters=("eq",)), A("name", "string", filters=("icontains",)), A("nickname", "string")), ("id",))
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "ab", "z")], spec.partial_struct())
    done = update_where(old, spec, {"name": {"icontains": "a"}}, {"nickname": "N"})
    assert sorted(map(tuple, done.target.collect())) == [(1, "a", "N"), (2, "b", None), (3, "ab", "N")] and done.affected() == 2
    assert update_where(old, spec, None, {"nickname": None}).affected() == 3
    with pytest.raises(SpecError):
        update_where(old, spec, None, {"nope": 1})
    gone = delete_where(old, spec, {"id": {"eq": 1}})
    assert gone.affected() == 1 and gone.target.count() == 2 and gone.rows.first().nickname == "x"
    books = spark.createDataFrame([(1, "t", 1, 1), (2, "u", 2, 1)], BOOKS.partial_struct())
    assert [r.id for r in follow_delete(books, BOOKS, gone.rows, "author").collect()] == [2]
    cleared = follow_delete(books, BOOKS, spark.createDataFrame([(1,)], "id int"), "publisher")
    assert cleared.where("publisher_id is null").count() == 2


def test_hooks(spark):
    now = F.lit("2024-01-02").cast("timestamp")
    ddl = "id int, assignee string, assigned_by string, assigned_at timestamp, first_assigned_at timestamp"
    before = spark.createDataFrame([(1, None, None, None, None), (2, "x", "o", None, None)], ddl)
    after = before.withColumn("assignee", F.when(F.col("id") == 1, "me").otherwise(F.col("assignee")))
    rows = assignment(after, before, ["id"], F.lit("actor"), now).orderBy("id").collect()
    assert rows[0].assigned_by == "actor" and rows[0].first_assigned_at and rows[1].assigned_by == "o"
    assert touched(before, "at", now).first()["at"] is not None
    parents = spark.createDataFrame([(1, {"a": 1, "b": 2}), (2, None)], "k int, tags map<string,int>")
    added = spark.createDataFrame([(1, "a", 9), (2, "c", 3)], "k int, name string, value int")
    out = {r.k: r.tags for r in merge_map(parents, "k", "tags", added, spark.createDataFrame([(1, "b")], "k int, name string")).collect()}
    assert out == {1: {"a": 9}, 2: {"c": 3}}
