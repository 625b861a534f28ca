"""Replacement of column types that keeps list and not-null wrappers."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.spec import SpecError, TableSpec


class TypeRegistry:
    """Named types; an input type is looked up as ``<name>Input`` first."""

    def __init__(self, types: dict[str, T.DataType] | None = None):
        self.types = dict(types or {})

    def find(self, name: str, for_input: bool = False) -> T.DataType | None:
        if for_input and f"{name}Input" in self.types:
            return self.types[f"{name}Input"]
        return self.types.get(name)


def replaced(kind: T.DataType, new: T.DataType) -> T.DataType:
    """``new`` inside the list wrappers of ``kind``."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(replaced(kind.elementType, new), kind.containsNull)
    return new


def schema_of(spec: TableSpec, registry: TypeRegistry, for_input: bool = False) -> T.StructType:
    """The table's struct with replacements; an unknown type warns and keeps the column's own."""
    fields = []
    for a in spec.attributes:
        kind = a.data_type
        if a.replace_type is not None:
            if not isinstance(a.replace_type, str):
                raise SpecError(f"{spec.name}.{a.name}: the replacement has to be a name")
            new = registry.find(a.replace_type, for_input)
            if new is None:
                warnings.warn(f"{spec.name}.{a.name}: no type {a.replace_type}", stacklevel=2)
            else:
                kind = replaced(kind, new)
        fields.append(T.StructField(a.name, kind, not a.not_null))
    return T.StructType(fields)


def enum_ok(c: Column, allowed: tuple[str, ...], is_array: bool = False) -> Column:
    """Whether a value, or every element of a list, is one of an enum's; nulls pass."""
    one = lambda x: x.isNull() | x.isin(*allowed)
    return F.coalesce(F.forall(c, one), F.lit(True)) if is_array else one(c)


def checked_enums(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Fail in the task that meets a value outside its enum."""
    for a in spec.attributes:
        if a.allowed and a.name in df.columns:
            ok = enum_ok(F.col(a.name), a.allowed, a.is_array)
            df = df.withColumn(a.name, F.when(ok, F.col(a.name)).otherwise(F.raise_error(F.lit(f"invalid value for {spec.name}.{a.name}")).cast(a.data_type)))
    return df
