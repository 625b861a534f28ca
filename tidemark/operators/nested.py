"""Nested bulk creates: items with related items, written layer by layer.

A request's items are planned into rows per table with references between
them.  A table's rows are written once all that they refer to are written; the
keys that these got are joined in by the row's position in the request.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.paging import check_bulk
from tidemark.operators.upsert import ACTION, RN, SET, UpsertResult, upsert
from tidemark.plans.spec import Relation, SpecError, TableSpec


@dataclass
class Row:
    """A row to be: known values, and columns that another row's key will fill."""

    table: str
    position: int
    values: dict = field(default_factory=dict)
    waits: list[tuple[int, Relation]] = field(default_factory=list)  # (position of the row, relation from this table)

    def put(self, column: str, value) -> None:
        if column in self.values:
            raise SpecError(f"{self.table}.{column} is set twice")
        self.values[column] = value


def plan_rows(items: list[dict], spec: TableSpec, specs: dict[str, TableSpec], most: int = 1000) -> list[Row]:
    """Flatten items depth first; their order is the order of the result."""
    rows: list[Row] = []

    def add(item: dict, at: TableSpec, path: tuple) -> Row:
        row = Row(at.name, len(rows))
        rows.append(row)
        for name, value in item.items():
            relation = at.relation(name)
            if relation is None:
                a = at.attribute(name)
                if a.generated:
                    raise SpecError(f"{at.name}.{name} is generated")
                row.put(a.name, value)
                continue
            if (at.name, name) in path:
                raise SpecError(f"{at.name}.{name} leads back to where the request came from")
            target = specs[relation.target]
            trail = (*path, (at.name, name), (target.name, relation.reciprocal))
            many = value if isinstance(value, list) else [value]
            if relation.unique and len(many) > 1:
                raise SpecError(f"{at.name}.{name} takes one item")
            for one in many:
                other = add(one, target, trail)
                if relation.referenced:  # the other table holds the key
                    back = target.relation(relation.reciprocal) if relation.reciprocal else None
                    if back is None:
                        raise SpecError(f"{at.name}.{name} has no way back")
                    other.waits.append((row.position, back))
                else:
                    row.waits.append((other.position, relation))
        return row

    for item in items:
        add(item, spec, ())
    check_bulk(len(rows), most)
    return rows


def layers(rows: list[Row]) -> list[tuple[str, list[Row]]]:
    """(table, rows) in an order in which every row comes after those it waits for."""
    done: set[int] = set()
    left, out = list(rows), []
    while left:
        free = [r for r in left if all(p in done for p, _ in r.waits)]
        if not free:
            raise SpecError("rows wait for one another in a circle")
        for table in dict.fromkeys(r.table for r in free):
            out.append((table, [r for r in free if r.table == table]))
        done |= {r.position for r in free}
        left = [r for r in left if r.position not in done]
    return out


def create_nested(spark: SparkSession, items: list[dict], spec: TableSpec, specs: dict[str, TableSpec], tables: dict[str, DataFrame],
                  policy: str = "error", most: int = 1000) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(tables after the write, rows by table); nothing is published here, so a failure leaves no trace."""
    out, results = dict(tables), {}
    written: dict[str, list[DataFrame]] = {}
    for table, rows in layers(plan_rows(items, spec, specs, most)):
        at = specs[table]
        source = _source(spark, rows, at)
        for relation in dict.fromkeys(r for row in rows for _, r in row.waits):
            keys = reduce(DataFrame.unionByName, written[relation.target]).select(
                F.col(RN).alias("__parent"), *[F.col(c).alias(f"__p_{c}") for c in relation.remote])
            link = f"__wait_{relation.name}"
            source = source.join(keys, F.col(link) == F.col("__parent"), "left")
            for local, remote in zip(relation.local, relation.remote, strict=True):
                kind = at.attribute(local).data_type
                source = source.withColumn(local, F.coalesce(F.col(f"__p_{remote}").cast(kind), F.col(local)))
            source = source.drop("__parent", link, *[f"__p_{c}" for c in relation.remote])
        done: UpsertResult = upsert(out[table], source, at, policy)
        count, _ = done.counts()
        if count != len(rows):
            raise SpecError(f"{table}: {count} rows of {len(rows)} were written")
        out[table] = done.target
        written.setdefault(table, []).append(done.rows)
    for table, parts in written.items():
        results[table] = reduce(DataFrame.unionByName, parts)
    return out, results


def _source(spark: SparkSession, rows: list[Row], spec: TableSpec) -> DataFrame:
    """The rows of one layer; a request is bounded, so its literal rows are local."""
    names = [a.name for a in spec.attributes]
    waits = list(dict.fromkeys(f"__wait_{r.name}" for row in rows for _, r in row.waits))
    schema = T.StructType([T.StructField(RN, T.LongType()), T.StructField(SET, T.ArrayType(T.StringType())),
                           *[T.StructField(a.name, a.data_type) for a in spec.attributes], *[T.StructField(w, T.LongType()) for w in waits]])
    data = []
    for row in rows:
        linked = {c for _, r in row.waits for c in r.local}
        given = [c for c in names if c in row.values or c in linked]
        parents = {f"__wait_{r.name}": p for p, r in row.waits}
        data.append((row.position, given, *[row.values.get(c) for c in names], *[parents.get(w) for w in waits]))
    return spark.createDataFrame(data, schema)


def with_children(parents: DataFrame, children: DataFrame, relation: Relation, order: list[str], name: str) -> DataFrame:
    """``parents`` with an array of their related rows, in ``order``."""
    keys = [f"__{c}" for c in relation.remote]
    listed = children.select(*[F.col(c).alias(k) for c, k in zip(relation.remote, keys, strict=True)],
                             F.struct(*order, *[c for c in children.columns if c not in order]).alias("__row"))
    grouped = listed.groupBy(*keys).agg(F.array_sort(F.collect_list("__row")).alias(name))
    on = reduce(lambda a, b: a & b, [parents[c] == grouped[k] for c, k in zip(relation.local, keys, strict=True)])
    return parents.join(grouped, on, "left").drop(*keys)


def read_back(table: DataFrame, keys: DataFrame, primary: list[str]) -> DataFrame:
    """Rows of ``table`` in the order of a list of keys (primary columns and ``__rn``)."""
    return keys.join(table, primary).orderBy(RN)


__all__ = ["ACTION", "Row", "create_nested", "layers", "plan_rows", "read_back", "with_children"]
