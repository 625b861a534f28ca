"""Row policies, column grants and hidden columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.spec import SpecError, TableSpec


def setting(session: dict, name: str, default: str = "system") -> str:
    """A session setting such as the acting user's id."""
    return session.get(name) or default


def policy(text: str, session: dict) -> Column:
    """A policy's SQL with ``:name`` bound to session settings as text literals; unset ones are null."""
    bound = re.sub(r"(?<!:):([a-z_]+)", lambda m: "NULL" if session.get(m[1]) is None else "'" + str(session[m[1]]).replace("\\", "\\\\").replace("'", "\\'") + "'", text)
    return F.coalesce(F.expr(bound), F.lit(False))


def visible(df: DataFrame, spec: TableSpec, session: dict) -> DataFrame:
    """The rows that the session may read."""
    return df.where(policy(spec.using, session)) if spec.using else df


def checked(df: DataFrame, spec: TableSpec, session: dict) -> DataFrame:
    """``df`` as written rows; the write fails in the task that meets a row the policy forbids."""
    if not spec.check:
        return df
    guard = F.when(policy(spec.check, session), F.lit(True)).otherwise(
        F.raise_error(F.lit(f"new row violates the row policy of {spec.name}")).cast("boolean"))
    return df.where(guard)


def granted(spec: TableSpec, action: str, columns: list[str]) -> list[str]:
    """The columns, if the action is allowed on all of them."""
    allowed = spec.insertable if action == "insert" else spec.updatable
    if allowed is not None and (denied := [c for c in columns if c not in allowed]):
        raise SpecError(f"permission denied to {action} {spec.name}.{denied[0]}")
    return columns


def selectable(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Drop columns that may be filtered by and not read."""
    hidden = {a.name for a in spec.attributes if not a.selectable}
    return df.select(*[c for c in df.columns if c not in hidden])
