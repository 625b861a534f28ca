"""Spans over requests, plans and steps, tied to the Spark jobs that they start."""

from __future__ import annotations

import io
import time
from collections.abc import Iterator
from contextlib import contextmanager, redirect_stdout
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Span:
    name: str
    parent: Span | None = None
    attributes: dict = field(default_factory=dict)
    status: str = "unset"
    started: float = field(default_factory=time.time)
    ended: float | None = None


class Tracer:
    """Collects spans; every span ends, also when its body raises."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark, self.spans, self._open = spark, [], []

    @contextmanager
    def span(self, name: str, **attributes) -> Iterator[Span]:
        span = Span(name, self._open[-1] if self._open else None, attributes)
        self.spans.append(span)
        self._open.append(span)
        tag = f"span-{len(self.spans)}"
        if self.spark:
            self.spark.addTag(tag)
        try:
            yield span
            span.status = "ok"
        except Exception as e:
            span.status = "error"
            span.attributes["error"] = str(e)[:500]
            raise
        finally:
            span.ended = time.time()
            self._open.pop()
            if self.spark:
                self.spark.removeTag(tag)

    def plan(self, df: DataFrame, mode: str = "simple") -> str:
        """The physical plan as text, for a span's attribute."""
        with redirect_stdout(io.StringIO()) as out:
            df.explain(mode=mode)
        return out.getvalue()
