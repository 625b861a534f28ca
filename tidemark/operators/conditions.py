"""Declarative filter conditions compiled to native columns and semi joins.

A condition is ``{attribute: {filter type: input}}`` or ``{relation: condition}``.
An absent key is not a filter; ``None`` is the null value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.spec import Attribute, SpecError, TableSpec, field_names, rename_fields

Apply = Callable[[Column, object, Attribute], Column]


@dataclass
class Method:
    """A way to evaluate filter types; not all ways work on change events."""

    name: str
    on_subscription: bool
    applies: dict[str, Apply] = field(default_factory=dict)


class Registry:
    """Filter types and methods; methods are tried in the order of registration."""

    def __init__(self):
        self.types: dict[str, str] = {}
        self.methods: dict[str, Method] = {}

    def add_type(self, name: str, description: str = "") -> None:
        if name in self.types:
            raise SpecError(f"filter type {name} is registered already")
        self.types[name] = description

    def add_method(self, name: str, applies: dict[str, Apply], on_subscription: bool = True) -> None:
        """Implementations of unknown types are skipped."""
        method = self.methods.setdefault(name, Method(name, on_subscription))
        method.applies.update({t: f for t, f in applies.items() if t in self.types})

    def pick(self, attribute: Attribute, kind: str, subscription: bool = False) -> Apply:
        """The first registered method that the attribute names, else ``plain``."""
        name = next((m for m in self.methods if m in attribute.methods), "plain")
        method = self.methods[name]
        if subscription and not method.on_subscription:
            method = self.methods["plain"]
        if kind not in method.applies:
            raise SpecError(f"{attribute.name}: method {method.name} has no {kind}")
        return method.applies[kind]


def literal(value, kind: T.DataType) -> Column:
    """A value, or the column of a parameter, as the attribute's type."""
    if isinstance(value, Column):
        return value.cast(kind)
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[literal(value.get(f.name), f.dataType).alias(f.name) for f in kind])
    if isinstance(kind, T.ArrayType):
        return F.array(*[literal(v, kind.elementType) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def _element(attribute: Attribute) -> T.DataType:
    kind = attribute.data_type
    return kind.elementType if isinstance(kind, T.ArrayType) else kind


def _any(columns: list[Column]) -> Column:
    return reduce(Column.__or__, columns) if columns else F.lit(False)


def eq(c: Column, value, a: Attribute) -> Column:
    """Equal; null asks for null; on an array, membership."""
    if value is None:
        return c.isNull()
    one = literal(value, _element(a))
    return F.array_contains(c, one) if a.is_array else c == one


def eq_in(c: Column, values, a: Attribute) -> Column:
    """In the list; a null in it also takes null; an empty or null list takes nothing."""
    values = values or []
    given = [v for v in values if v is not None]
    kind = _element(a)
    if a.is_array:
        found = F.arrays_overlap(c, literal(given, T.ArrayType(kind))) if given else F.lit(False)
    elif a.is_struct:
        found = _any([c == literal(v, kind) for v in given])
    else:
        found = c.isin([literal(v, kind) for v in given]) if given else F.lit(False)
    return found | c.isNull() if len(given) < len(values) else found


def in_range(c: Column, bounds: dict, a: Attribute) -> Column:
    """Inclusive; an absent bound is open, a null bound takes nothing."""
    out = F.lit(True)
    for name, compare in (("from", Column.__ge__), ("to", Column.__le__)):
        if name in (bounds or {}):
            out = out & (F.lit(False) if bounds[name] is None else compare(c, literal(bounds[name], _element(a))))
    return out


def icontains(c: Column, value, a: Attribute) -> Column:
    """Contains, ignoring case; ``%`` and ``_`` in the input are wildcards.  Null takes nothing."""
    if value is None:
        return F.lit(False)
    pattern = F.concat(F.lit("%"), as_text(value), F.lit("%"))
    return F.exists(c, lambda x: F.ilike(x, pattern)) if a.is_array else F.ilike(c, pattern)


def starts_with(c: Column, value, a: Attribute) -> Column:
    """Starts with the text; null takes nothing."""
    return F.lit(False) if value is None else c.startswith(as_text(value))


def as_text(value) -> Column:
    """A value or a parameter as text."""
    return value.cast("string") if isinstance(value, Column) else F.lit(str(value))


def search_range(c: Column, bounds: dict, a: Attribute) -> Column:
    """As a search index does it: 0, empty text and null are open bounds."""
    return in_range(c, {k: v for k, v in (bounds or {}).items() if v}, a)


def search_icontains(c: Column, value, a: Attribute) -> Column:
    """Contains as plain text; ``config['field']`` names another column to look in."""
    if value is None:
        return F.lit(False)
    at = F.col(a.config["field"]) if "field" in a.config else c
    if a.is_array:
        return F.exists(at, lambda x: F.lower(x).contains(F.lower(as_text(value))))
    return F.lower(at).contains(F.lower(as_text(value)))


REGISTRY = Registry()
for _name, _text in (("eq", "equal to the value"), ("eqIn", "equal to one of the values"),
                     ("range", "between two bounds"), ("icontains", "contains the text, ignoring case"), ("startsWith", "starts with the text")):
    REGISTRY.add_type(_name, _text)
REGISTRY.add_method("search", {"eq": eq, "eqIn": eq_in, "range": search_range, "icontains": search_icontains}, on_subscription=False)
REGISTRY.add_method("plain", {"eq": eq, "eqIn": eq_in, "range": in_range, "icontains": icontains, "startsWith": starts_with})


@dataclass
class Compiled:
    """A predicate over the table's own columns, and semi joins to related ones.

    The predicate is null where a column is null, which a filter takes as false;
    wrapping it would keep it from the Parquet scan.
    """

    where: Column
    related: list[tuple]  # (relation, target spec, compiled condition)

    def own_only(self) -> Column:
        if self.related:
            raise SpecError("conditions over relations can't be evaluated on one row")
        return self.where


def compile_condition(spec: TableSpec, condition: dict | None, specs: dict[str, TableSpec] | None = None,
                      registry: Registry = REGISTRY, subscription: bool = False, column=F.col) -> Compiled:
    """Check a condition against the specification and compile it; parts are combined by AND."""
    condition = condition or {}
    where, related = F.lit(True), []
    for name, wanted in condition.items():
        relation = spec.relation(name)
        if relation is not None:
            if not relation.filterable:
                raise SpecError(f"{spec.name}.{name} is not filterable")
            if "." in relation.target:
                raise SpecError(f"{spec.name}.{name}: only one hop can be filtered")
            target = (specs or {})[relation.target]
            related.append((relation, target, compile_condition(target, wanted, specs, registry, subscription)))
            continue
        a = spec.attribute(name)
        if not isinstance(wanted, dict) or len(wanted) != 1:
            raise SpecError(f"{spec.name}.{name}: exactly one filter type is needed")
        (kind, value), = wanted.items()
        if kind not in registry.types or kind not in a.filters:
            raise SpecError(f"{spec.name}.{name} can't be filtered by {kind}")
        value = rename_fields(value, field_names(a.data_type)) if a.is_struct else value
        where = where & registry.pick(a, kind, subscription)(column(a.name), value, a)
    for a in spec.attributes:
        if a.required and condition.get(a.name, condition.get(a.name)) is None and not any(
                spec.relation(k) is None and spec.attribute(k) is a and v is not None for k, v in condition.items()):
            raise SpecError(f"{spec.name}.{a.name} has to be filtered")
    return Compiled(where, related)


def apply_condition(df: DataFrame, spec: TableSpec, condition: dict | None, tables: dict[str, DataFrame] | None = None,
                    specs: dict[str, TableSpec] | None = None, registry: Registry = REGISTRY) -> DataFrame:
    """The rows of ``df`` that fit; relations are left semi joins on all key pairs."""
    return _apply(df, compile_condition(spec, condition, specs, registry), tables or {})


def _apply(df: DataFrame, compiled: Compiled, tables: dict[str, DataFrame]) -> DataFrame:
    df = df.where(compiled.where)
    for relation, target, inner in compiled.related:
        keys = [f"__{i}" for i in range(len(relation.remote))]
        other = _apply(tables[target.name], inner, tables).select(*[F.col(c).alias(k) for c, k in zip(relation.remote, keys, strict=True)])
        on = reduce(Column.__and__, [df[c] == other[k] for c, k in zip(relation.local, keys, strict=True)])
        df = df.join(other, on, "left_semi")
    return df
