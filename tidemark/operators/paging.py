"""Bounded pages: default and largest sizes, last pages, keyset pages, pages per parent."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.spec import SpecError, TableSpec

_ABSENT = object()


class PageError(SpecError):
    status = 400


@dataclass(frozen=True)
class PageLimits:
    default: int = 10
    largest: int = 100

    def for_table(self, spec: TableSpec) -> PageLimits:
        """Overrides by the tags ``default_records_per_page`` and ``max_records_per_page``."""
        def tag(name: str, fallback: int) -> int:
            if name not in spec.tags:
                return fallback
            try:
                value = int(str(spec.tags[name]))
            except ValueError:
                value = 0
            if value <= 0:
                raise SpecError(f"{spec.name}: {name} has to be a positive whole number")
            return value

        return PageLimits(tag("default_records_per_page", self.default), tag("max_records_per_page", self.largest))

    def check(self, first=_ABSENT, last=_ABSENT) -> tuple[int | None, int | None]:
        """(first, last) to use.  Absent ``first`` has the default; null has no bound of its own."""
        first = self.default if first is _ABSENT else first
        last = None if last is _ABSENT else last
        if not isinstance(first, int) and not isinstance(last, int):
            raise PageError("first or last has to be a number")
        for key, n in (("first", first), ("last", last)):
            if isinstance(n, int) and n > self.largest:
                raise PageError(f"Maximum of {self.largest} {key} records can be requested")
            if isinstance(n, int) and n < 0:
                raise PageError(f"{key} can't be negative")
        return first, last


def _reversed(order: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    return [(c, not up) for c, up in order]


def _sort(order: list[tuple[str, bool]]) -> list[Column]:
    """Nulls are larger than all values, as the reference's database has it."""
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_first() for c, up in order]


def page(df: DataFrame, order: list[tuple[str, bool]], first: int | None = 10, last: int | None = None) -> DataFrame:
    """The first or the last rows in ``order`` (column, ascending); a top-k, never a full sort."""
    if first is not None:
        df = df.orderBy(*_sort(order)).limit(first)
    if last is not None:
        df = df.orderBy(*_sort(_reversed(order))).limit(last)
    return df.orderBy(*_sort(order))


def keyset_page(df: DataFrame, key: str, first: int, after=None, descending: bool = True) -> DataFrame:
    """Rows beyond the cursor with ``has_next_page``; reads one row more than it returns."""
    if after is not None:
        df = df.where(F.col(key) < F.lit(after) if descending else F.col(key) > F.lit(after))
    order = [(key, not descending)]
    some = df.orderBy(*_sort(order)).limit(first + 1)
    # At most first + 1 rows reach this window.
    numbered = some.withColumn("__n", F.row_number().over(Window.orderBy(*_sort(order))))
    return (numbered.withColumn("has_next_page", F.max("__n").over(Window.partitionBy()) > first)
            .where(F.col("__n") <= first).drop("__n"))


def page_per_parent(df: DataFrame, parent: list[str], order: list[tuple[str, bool]], n: int) -> DataFrame:
    """At most ``n`` rows of each parent."""
    place = F.row_number().over(Window.partitionBy(*parent).orderBy(*_sort(order)))
    return df.withColumn("__n", place).where(F.col("__n") <= n).drop("__n")


def check_bulk(count: int, most: int = 1000) -> None:
    """A bulk request has 1 to ``most`` rows, nested ones included."""
    if not 1 <= count <= most:
        raise PageError(f"a bulk request has 1 to {most} rows, not {count}")
