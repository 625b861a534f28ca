"""Table specifications: what the operators need to know beyond a schema.

Spark enforces neither keys nor defaults, so keys, defaults, generated columns,
relations, behaviours and policies are declared here and checked by operators.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SpecError(ValueError):
    """A request that a specification does not allow."""


@dataclass(frozen=True)
class Attribute:
    """A column: DDL type, constraints, and the behaviours that requests may use."""

    name: str
    type: str
    not_null: bool = False
    default: str | None = None  # SQL expression, used where a row does not carry the column
    generated: str | None = None  # SQL expression over the row, recomputed on every write
    filters: tuple[str, ...] = ()
    methods: tuple[str, ...] = ()
    required: bool = False
    config: dict = field(default_factory=dict)
    selectable: bool = True
    allowed: tuple[str, ...] | None = None  # the values of an enum
    replace_type: str | None = None
    rate_limits: str | None = None

    @property
    def data_type(self) -> T.DataType:
        return T.StructType.fromDDL(f"c {self.type}")["c"].dataType

    @property
    def is_array(self) -> bool:
        return isinstance(self.data_type, T.ArrayType)

    @property
    def is_struct(self) -> bool:
        kind = self.data_type
        return isinstance(kind.elementType if isinstance(kind, T.ArrayType) else kind, T.StructType)


@dataclass(frozen=True)
class Relation:
    """A named path to another table over equal key columns.

    ``referenced`` means that the other table holds the foreign key.
    """

    name: str
    target: str
    local: tuple[str, ...]
    remote: tuple[str, ...]
    unique: bool = False
    referenced: bool = False
    reciprocal: str | None = None
    filterable: bool = False
    on_delete: str = "restrict"  # of the table with the foreign key: restrict, cascade or set null


@dataclass(frozen=True)
class TableSpec:
    name: str
    attributes: tuple[Attribute, ...]
    primary: tuple[str, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    relations: tuple[Relation, ...] = ()
    schema: str = "public"
    subscribable: bool = False
    bulk: tuple[str, ...] = ("create", "update", "delete")
    using: str | None = None  # row policies, SQL over the row and session settings
    check: str | None = None
    insertable: tuple[str, ...] | None = None
    updatable: tuple[str, ...] | None = None
    tags: dict = field(default_factory=dict)

    def __post_init__(self):
        names = [a.name for a in self.attributes]
        if len(set(names)) < len(names):
            raise SpecError(f"{self.name}: a column is declared twice")
        for columns in self.unique_sets:
            if missing := set(columns) - set(names):
                raise SpecError(f"{self.name}: key over unknown columns {sorted(missing)}")

    @property
    def unique_sets(self) -> tuple[tuple[str, ...], ...]:
        """The primary key and all other keys, each once."""
        sets = ((self.primary,) if self.primary else ()) + self.uniques
        return tuple(dict.fromkeys(sets))

    @property
    def columns(self) -> list[str]:
        return [a.name for a in self.attributes]

    def attribute(self, name: str) -> Attribute:
        """By column name, or by the camel-case name that a request uses."""
        for a in self.attributes:
            if name in (a.name, camel(a.name)):
                return a
        raise SpecError(f"{self.name} has no attribute {name}")

    def relation(self, name: str) -> Relation | None:
        return next((r for r in self.relations if r.name == name), None)

    def can(self, action: str) -> bool:
        """Bulk operations need columns, a key and the behaviour."""
        return bool(self.attributes) and bool(self.unique_sets) and action in self.bulk

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(a.name, a.data_type, not a.not_null) for a in self.attributes])

    def primary_struct(self) -> T.StructType:
        return T.StructType([f for f in self.struct() if f.name in self.primary])

    def partial_struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in self.struct()])

    def with_generated(self, row: dict[str, Column] | None = None) -> dict[str, Column]:
        """Expressions of the generated columns."""
        return {a.name: F.expr(a.generated).cast(a.data_type) for a in self.attributes if a.generated}


def camel(name: str) -> str:
    return re.sub(r"_+([a-zA-Z0-9])", lambda m: m[1].upper(), name)


def rename_fields(value, spec_fields: dict):
    """Request names to column names, through nested dicts and lists; unknown names stay."""
    if isinstance(value, list):
        return [rename_fields(v, spec_fields) for v in value]
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            name, inner = spec_fields.get(k, (k, {}))
            out[name] = rename_fields(v, inner)
        return out
    return value


def field_names(kind: T.DataType) -> dict:
    """{request name: (column name, nested names)} of a struct or array of structs."""
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if not isinstance(kind, T.StructType):
        return {}
    return {n: (f.name, field_names(f.dataType)) for f in kind for n in (camel(f.name), f.name)}
