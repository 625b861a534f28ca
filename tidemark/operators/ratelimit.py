"""Rate limits: tag grammar, which limits apply, and fixed windows per key.

A key's window opens with its first request and lasts ``duration`` seconds; it
is not aligned to the clock.  Requests over the limit are rejected and count.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ids import client_ip
from tidemark.plans.spec import SpecError

OPERATIONS = ("connection", "field", "create", "update", "delete")


@dataclass(frozen=True)
class Limit:
    points: int
    duration: int  # seconds


@dataclass(frozen=True)
class TagLimit:
    operations: tuple[str, ...]
    name: str
    limit: Limit | None


def parse_limit(text: str) -> Limit:
    """``max/duration``; only the leading digits of the duration count, in seconds."""
    points, _, duration = text.partition("/")
    digits = re.match(r"\d+", duration)
    if not points.isdigit() or digits is None:
        raise SpecError(f"rate limit {text!r} is not max/duration")
    return Limit(int(points), int(digits[0]))


def parse_tag(text: str) -> list[TagLimit]:
    """``operations:name[:max/duration]`` parts, separated by one space; operations by commas."""
    out = []
    for part in text.split(" "):
        fields = part.split(":")
        if len(fields) not in (2, 3):
            raise SpecError(f"rate limit tag {part!r}")
        operations = tuple(fields[0].split(","))
        if bad := [o for o in operations if o not in OPERATIONS]:
            raise SpecError(f"rate limit operation {bad[0]!r}")
        out.append(TagLimit(operations, fields[1], parse_limit(fields[2]) if len(fields) == 3 else None))
    return out


def applicable(tags: list[TagLimit], operation: str, defaults: dict[str, Limit], root: bool) -> dict[str, Limit | None]:
    """Limits by name: those tagged for the operation, and on root fields every default that no tag names."""
    out = {t.name: t.limit for t in tags if operation in t.operations}
    if root:
        for name in defaults:
            out.setdefault(name, None)
    return out


def describe(limits: dict[str, Limit | None], defaults: dict[str, Limit]) -> str:
    """The limits as documentation text."""
    lines = []
    for name, limit in limits.items():
        use = limit or defaults.get(name)
        lines.append(f"- {name}: {use.points} requests in {use.duration} s" if use else f"- {name}")
    return "\n".join(["**@rateLimits**", *lines]) if lines else ""


class RequestPlan:
    """The limits that one request consumes, each API name once."""

    def __init__(self):
        self.limits: dict[str, dict[str, Limit | None]] = {}

    def add(self, api_name: str, limits: dict[str, Limit | None]) -> None:
        if api_name in self.limits:
            raise SpecError(f"{api_name} has its limits already")
        self.limits[api_name] = limits


def effective(custom_cached: Column, custom: Column, tagged: Column, default: Column) -> Column:
    """The limit in force: cached custom, custom, tag, then configuration."""
    return F.coalesce(custom_cached, custom, tagged, default)


def limit_key(name: Column, api_name: Column, key: Column) -> Column:
    """Null where the request has no key: such requests aren't limited."""
    return F.concat(name, F.lit("_"), api_name, F.lit(":"), key)


def windows_in_order(keys: np.ndarray, micros: np.ndarray, length: int, last: tuple | None) -> tuple[np.ndarray, np.ndarray, tuple | None]:
    """(number in its window, end of its window) of requests sorted by key and time; ``last`` is the state before them."""
    n, reset = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    if not len(keys):
        return n, reset, last
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    for at, end in zip(heads.tolist(), [*heads[1:].tolist(), len(keys)], strict=True):
        opened, used = (last[1], last[2]) if last and last[0] == keys[at] else (None, 0)
        while at < end:
            if opened is None or micros[at] >= opened + length:
                opened, used = int(micros[at]), 0
            stop = at + int(np.searchsorted(micros[at:end], opened + length))
            n[at:stop] = used + 1 + np.arange(stop - at)
            reset[at:stop] = opened + length
            used += stop - at
            at = stop
        last = (keys[end - 1], opened, used)
    return n, reset, last


def consume(requests: DataFrame, key: str, ts: str, request_id: str, points: int, duration: int) -> DataFrame:
    """Judge requests in order of (ts, id) per key; rows with a null key are allowed.

    Adds ``consumed`` (its number in the window), ``allowed``, ``remaining`` and
    ``retry_after_ms``.  A window's origin depends on all requests of the key
    before it, so a key is read in order by one task; it is read as a stream of
    sorted rows, and what is held between batches is one window.
    """
    names = requests.columns
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    spread = F.when(F.col(key).isNull(), F.xxhash64(request_id)).otherwise(F.xxhash64(key))
    ordered = (requests.withColumns({"__key": F.col(key).cast("string"), "__us": micros}).repartition(spread)
               .sortWithinPartitions(F.col("__key").asc_nulls_first(), "__us", request_id))
    schema = T.StructType([*requests.schema.fields, T.StructField("__us", T.LongType()), T.StructField("consumed", T.LongType()), T.StructField("__reset", T.LongType())])
    length = duration * 1_000_000

    def judge(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, last = to_arrow_schema(schema), None
        for batch in batches:
            keys, us = np.array(batch.column(len(names)).to_pylist(), object), batch.column(len(names) + 1)
            given = np.flatnonzero(np.array([k is not None for k in keys]))
            n, reset = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            n[given], reset[given], last = windows_in_order(keys[given], us.to_numpy(zero_copy_only=False)[given], length, last)
            missing = np.array([k is None for k in keys], bool)
            columns = [c.cast(f.type) for c, f in zip(batch.columns[: len(names)], list(arrow), strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, us, pa.array(n, mask=missing), pa.array(reset, mask=missing)], schema=arrow)

    judged = ordered.mapInArrow(judge, schema)
    allowed = F.coalesce(F.col("consumed") <= points, F.lit(True))
    return judged.withColumns({
        "allowed": allowed, "remaining": F.greatest(F.lit(points).cast("long") - F.col("consumed"), F.lit(0).cast("long")),
        "retry_after_ms": F.when(~allowed, F.ceil((F.col("__reset") - F.col("__us")) / 1000))}).drop("__us", "__reset")


def consume_in_turn(requests: DataFrame, limits: list[tuple[str, str, Limit]], ts: str, request_id: str) -> DataFrame:
    """Judge requests by several limits (name, key column, limit), one after another.

    The first limit that a request is over rejects it, and it consumes none of those
    after.  Adds ``allowed`` and ``rejected_by``, the name of that limit.
    """
    left, out = requests, []
    columns = [F.col(c) for c in requests.columns]
    for name, key, limit in limits:
        judged = consume(left, key, ts, request_id, limit.points, limit.duration)
        out.append(judged.where(~F.col("allowed")).select(*columns, F.lit(False).alias("allowed"), F.lit(name).alias("rejected_by")))
        left = judged.where("allowed").select(*columns)
    out.append(left.select(*columns, F.lit(True).alias("allowed"), F.lit(None).cast("string").alias("rejected_by")))
    return reduce(DataFrame.unionByName, out)


#: Callers without an account: so many requests in so many seconds for each address.
UNAUTHENTICATED = Limit(60, 60)


def caller_key(user: Column, forwarded: Column, real: Column, peer: Column) -> Column:
    """What a caller is counted by: the account, or else the address."""
    return F.coalesce(user, client_ip(forwarded, real, peer))


def rejection(points: int) -> Column:
    """What a rejected request is told."""
    return F.when(~F.col("allowed"), F.struct(
        F.lit("Too many requests").alias("message"), F.lit(429).alias("status"), F.ceil(F.col("retry_after_ms") / 1000).cast("long").alias("retry_after"),
        F.lit(points).alias("limit"), F.col("remaining").alias("remaining")))
