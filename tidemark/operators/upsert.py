"""Bulk upserts: conflict policies, dedupe within the batch, and an action per row.

Source rows carry their position in ``__rn`` and may carry in ``__set`` the
names of the columns that they really have; an absent column is not a null one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.spec import SpecError, TableSpec

RN, SET, ACTION = "__rn", "__set", "row_action"


class ConflictError(SpecError):
    """A batch that breaks a key under the policy ``error``."""


@dataclass
class UpsertResult:
    """The table after the write, and one row per source row with its action, in no order; sort by ``__rn`` where one is wanted."""

    target: DataFrame
    rows: DataFrame

    def counts(self) -> tuple[int, int]:
        """(rows, rows that were inserted or updated)."""
        found = self.rows.agg(F.count(F.lit(1)), F.count_if(F.col(ACTION).isin("INSERT", "UPDATE"))).first()
        return found[0], found[1]


def positioned(items: DataFrame, array: str) -> DataFrame:
    """One row per element of an array of structs, with its position."""
    return items.select(F.posexplode(array).alias(RN, "__item")).select(F.col(RN).cast("long").alias(RN), "__item.*")


def completed(source: DataFrame, spec: TableSpec) -> DataFrame:
    """Absent columns get their defaults, generated ones are computed."""
    carried = set(source.columns)
    has_set = SET in carried
    out = {}
    for a in spec.attributes:
        default = F.expr(a.default) if a.default else F.lit(None)
        if a.name not in carried:
            out[a.name] = default.cast(a.data_type)
        elif has_set:
            out[a.name] = F.when(F.array_contains(SET, a.name), F.col(a.name)).otherwise(default).cast(a.data_type)
        else:
            out[a.name] = F.col(a.name).cast(a.data_type)
    given = F.col(SET) if has_set else F.array(*[F.lit(c) for c in source.columns if c != RN])
    full = source.select(RN, given.alias(SET), *[c.alias(n) for n, c in out.items()])
    return full.withColumns(spec.with_generated()) if spec.with_generated() else full


def _all_there(columns: tuple[str, ...]) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])


def first_of_equals(rows: DataFrame, uniques: tuple[tuple[str, ...], ...]) -> DataFrame:
    """Adds ``__first``: the least position that shares a key.  A key with a null part equals none."""
    firsts = []
    for i, columns in enumerate(uniques):
        # A null key would put all of its rows into one group, so it is spread by position.
        spread = F.when(_all_there(columns), F.lit(-1)).otherwise(F.col(RN))
        window = Window.partitionBy(*columns, spread)
        rows = rows.withColumn(f"__u{i}", F.min(RN).over(window))
        firsts.append(F.col(f"__u{i}"))
    first = F.least(*firsts) if len(firsts) > 1 else firsts[0]
    return rows.withColumn("__first", first).drop(*[f"__u{i}" for i in range(len(uniques))])


def _matches(kept: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    """(__rn, primary key of the row it meets): one equi-join per key, never an OR."""
    found = []
    for columns in spec.unique_sets:
        left = kept.where(_all_there(columns)).select(RN, *[F.col(c).alias(f"__k_{c}") for c in columns])
        right = target.select(*[F.col(c).alias(f"__t_{c}") for c in dict.fromkeys((*spec.primary, *columns))])
        on = reduce(Column.__and__, [F.col(f"__k_{c}") == F.col(f"__t_{c}") for c in columns])
        found.append(left.join(right, on).select(RN, *[F.col(f"__t_{c}").alias(f"__t_{c}") for c in spec.primary]))
    if len(found) == 1:
        return found[0]
    keys = [f"__t_{c}" for c in spec.primary]
    several = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a row meets two rows of the table")).cast("boolean"))
    union = reduce(DataFrame.unionByName, found).distinct()
    return union.groupBy(RN).agg(several.alias("__bad"), *[F.first(k).alias(k) for k in keys]).where(F.col("__bad").isNull()).drop("__bad")


def upsert(target: DataFrame, source: DataFrame, spec: TableSpec, policy: str = "error",
           update_columns: list[str] | None = None, updatable: bool = True) -> UpsertResult:
    """Write ``source`` into ``target``.

    ``error`` raises if any key is met twice; ``ignore`` keeps existing rows;
    ``replace`` updates the columns that each row carries, bucket by bucket of
    equal column sets; ``update`` updates ``update_columns``.  A table without
    keys takes every row.  ``replace`` on a table that is not ``updatable`` is
    ``ignore``.
    """
    if policy not in ("error", "ignore", "replace", "update"):
        raise SpecError(f"conflict policy {policy}")
    if policy in ("replace", "update") and not updatable:
        policy = "ignore"
    if not spec.unique_sets:
        rows = completed(source, spec).withColumn(ACTION, F.lit("INSERT"))
        return UpsertResult(target.unionByName(rows.select(*spec.columns)), rows.select(RN, ACTION, *spec.columns))
    if policy == "replace" and SET in source.columns:
        # A key that different column sets share makes one set's write what the next one meets.  Else all rows meet the
        # table at once, each with its own columns.
        given = completed(source, spec).withColumn("__columns", F.sort_array(SET))
        shared = [given.where(_all_there(u)).groupBy(*u).agg(F.min("__columns").alias("a"), F.max("__columns").alias("b")).where("a <> b").select(F.lit(1)) for u in spec.unique_sets]
        if not reduce(DataFrame.unionByName, shared).head(1):
            return _write(target, source, spec, "update", spec.columns)
        order = source.groupBy(F.sort_array(SET).alias("s")).agg(F.min(RN).alias("at")).orderBy("at").collect()
        out, parts = target, []
        for bucket in order:
            one = source.where(F.sort_array(SET) == F.array(*[F.lit(c) for c in bucket["s"]]).cast("array<string>"))
            done = _write(out, one, spec, "update", list(bucket["s"]))
            out = done.target
            parts.append(done.rows)
        return UpsertResult(out, reduce(DataFrame.unionByName, parts) if parts else _write(target, source, spec, "ignore", []).rows)
    columns = update_columns if policy == "update" else [c for c in source.columns if c in spec.columns]
    return _write(target, source, spec, "update" if policy == "replace" else policy, columns or [])


def with_ids(rows: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    """Number rows without a primary key after the largest one; numbers follow the positions and may have gaps."""
    kind = spec.attribute(spec.primary[0]).data_type if len(spec.primary) == 1 else None
    if not isinstance(kind, (T.IntegerType, T.LongType)):
        return rows
    key = spec.primary[0]
    top = target.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    return rows.join(F.broadcast(top)).withColumn(key, F.coalesce(F.col(key), (F.col("__top") + F.col(RN) + 1).cast(kind))).drop("__top")


def _write(target: DataFrame, source: DataFrame, spec: TableSpec, policy: str, columns: list[str]) -> UpsertResult:
    given = completed(source, spec)
    firsts = first_of_equals(given, spec.unique_sets)
    kept = firsts.where(F.col("__first") == F.col(RN))
    matched = _matches(kept, target, spec)
    if policy == "error":
        twice = firsts.where(F.col("__first") != F.col(RN)).select(RN).limit(1).count()
        if twice or matched.limit(1).count():
            raise ConflictError(f"duplicate key in {spec.name}")
    keys = [f"__t_{c}" for c in spec.primary]
    judged = kept.join(matched, RN, "left").withColumn("__met", F.col(keys[0]).isNotNull())
    numbered = with_ids(judged.where(~F.col("__met")), target, spec)
    inserts = numbered.select(RN, F.lit("INSERT").alias(ACTION), *spec.columns)

    met = judged.where("__met")
    old = target.select(*[F.col(c).alias(f"__o_{c}") for c in spec.columns])
    on = reduce(Column.__and__, [F.col(f"__t_{c}") == F.col(f"__o_{c}") for c in spec.primary])
    both = met.join(old, on)
    changes = [c for c in columns if c in spec.columns and c not in spec.primary] if policy == "update" else []
    own = lambda c: F.when(F.array_contains(SET, c), F.col(c)).otherwise(F.col(f"__o_{c}")) if SET in source.columns else F.col(c)
    new = {c: own(c) if c in changes else F.col(f"__o_{c}") for c in spec.columns}
    updated = both.select(RN, F.lit("UPDATE" if policy == "update" else "EXISTING").alias(ACTION), *[e.alias(c) for c, e in new.items()])
    if policy == "update" and spec.with_generated():
        updated = updated.withColumns(spec.with_generated())
    winners = inserts.unionByName(updated)

    # A row that shares a key with a kept one takes that one's values; with none, the batch is contradictory.
    rest = firsts.where(F.col("__first") != F.col(RN)).select(F.col(RN).alias("__own"), F.col("__first").alias("__f"))
    duplicates = rest.join(winners, F.col("__f") == F.col(RN), "left").select(
        F.col("__own").alias(RN),
        F.when(F.col(RN).isNull(), F.raise_error(F.lit("a row repeats a row that is itself a duplicate")).cast("string")).otherwise(F.lit("DUPLICATE")).alias(ACTION),
        *spec.columns)
    rows = winners.unionByName(duplicates)

    untouched = target.select(*spec.columns)
    if policy == "update":
        gone = updated.select(*[F.col(c).alias(f"__g_{c}") for c in spec.primary])
        untouched = untouched.join(gone, reduce(Column.__and__, [F.col(c) == F.col(f"__g_{c}") for c in spec.primary]), "left_anti").unionByName(updated.select(*spec.columns))
    return UpsertResult(untouched.unionByName(inserts.select(*spec.columns)), rows)
