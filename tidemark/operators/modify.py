"""Updates and deletes by condition, cascades, and the hooks that follow a write."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.conditions import apply_condition, compile_condition, literal
from tidemark.plans.spec import SpecError, TableSpec


@dataclass
class Modified:
    """The table after the write, the rows touched (after an update, before a delete)."""

    target: DataFrame
    rows: DataFrame

    def affected(self) -> int:
        return self.rows.count()


def _on_key(spec: TableSpec, left: DataFrame, right: DataFrame) -> Column:
    return reduce(Column.__and__, [left[c] == right[c] for c in spec.primary])


def _need_key(spec: TableSpec) -> None:
    if not spec.primary:
        raise SpecError(f"{spec.name} has no primary key")


def update_where(target: DataFrame, spec: TableSpec, condition: dict | None, patch: dict, tables=None, specs=None) -> Modified:
    """Set the columns of ``patch`` (values or columns) in the rows that fit; no condition means all rows."""
    _need_key(spec)
    values = {spec.attribute(k).name: v for k, v in patch.items()}
    chosen = apply_condition(target, spec, condition, tables, specs)
    new = {c: literal(values[c], spec.attribute(c).data_type) if c in values else F.col(c) for c in spec.columns}
    rows = chosen.select(*[e.alias(c) for c, e in new.items()])
    if spec.with_generated():
        rows = rows.withColumns(spec.with_generated())
    if condition and any(spec.relation(k) for k in condition):
        rest = target.join(chosen.select(*spec.primary), list(spec.primary), "left_anti").select(*spec.columns)
    else:  # a predicate over the row itself needs no join
        rest = target.where(~F.coalesce(compile_condition(spec, condition, specs).own_only(), F.lit(False))).select(*spec.columns)
    return Modified(rest.unionByName(rows), rows)


def delete_where(target: DataFrame, spec: TableSpec, condition: dict | None, tables=None, specs=None) -> Modified:
    """Remove the rows that fit; returns them as they were."""
    _need_key(spec)
    rows = apply_condition(target, spec, condition, tables, specs)
    return Modified(target.join(rows.select(*spec.primary), list(spec.primary), "left_anti"), rows)


def follow_delete(children: DataFrame, child: TableSpec, deleted: DataFrame, relation: str) -> DataFrame:
    """``children`` after rows of the table that ``relation`` names are gone: cascade or set null."""
    r = child.relation(relation)
    gone = deleted.select(*[F.col(c).alias(f"__d_{c}") for c in r.remote]).distinct()
    on = reduce(Column.__and__, [F.col(c) == F.col(f"__d_{d}") for c, d in zip(r.local, r.remote, strict=True)])
    if r.on_delete == "cascade":
        return children.join(gone, on, "left_anti")
    if r.on_delete == "set null":
        flagged = children.join(gone.withColumn("__gone", F.lit(True)), on, "left")
        return flagged.select(*[(F.when(F.col("__gone").isNull(), F.col(c)) if c in r.local else F.col(c)).alias(c) for c in children.columns])
    hit = children.join(gone, on, "left_semi").limit(1).count()
    if hit:
        raise SpecError(f"rows of {child.name} still refer to deleted rows")
    return children


# ------------------------------------------------------------- write hooks
def touched(rows: DataFrame, column: str = "updated_at", now: Column | None = None) -> DataFrame:
    """Stamp updated rows."""
    return rows.withColumn(column, now if now is not None else F.current_timestamp())


def assignment(after: DataFrame, before: DataFrame, key: list[str], actor: Column, now: Column) -> DataFrame:
    """Where ``assignee`` changed, set who and when; ``first_assigned_at`` only once."""
    old = before.select(*key, F.col("assignee").alias("__was"))
    changed = ~F.col("assignee").eqNullSafe(F.col("__was"))
    joined = after.join(old, key, "left")
    return joined.withColumns({
        "assigned_by": F.when(changed, actor).otherwise(F.col("assigned_by")),
        "assigned_at": F.when(changed, now).otherwise(F.col("assigned_at")),
        "first_assigned_at": F.when(changed & F.col("assignee").isNotNull(), F.coalesce("first_assigned_at", now)).otherwise(F.col("first_assigned_at")),
    }).drop("__was")


def merge_map(parents: DataFrame, key: str, column: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Keep a map column of ``parents`` in step with child rows.

    ``added`` (key, name, value) puts entries over old ones of that name;
    ``removed`` (key, name) takes names away.
    """
    out = parents
    if added is not None:
        news = added.groupBy(key).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("name", "value")))).alias("__new"))
        old = F.coalesce(F.col(column), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
        fresh = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys("__new"), k))
        out = out.join(news, key, "left").withColumn(column, F.when(F.col("__new").isNull(), F.col(column)).otherwise(F.map_concat(fresh, "__new"))).drop("__new")
    if removed is not None:
        gone = removed.groupBy(key).agg(F.collect_set("name").alias("__gone"))
        out = out.join(gone, key, "left").withColumn(column, F.when(F.col("__gone").isNull(), F.col(column)).otherwise(
            F.map_filter(column, lambda k, v: ~F.array_contains("__gone", k)))).drop("__gone")
    return out
