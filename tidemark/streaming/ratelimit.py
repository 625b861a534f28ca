"""Fixed-window rate limits over a stream, with the window as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.ratelimit import windows_in_order

OUTPUT = "key string, id long, us long, consumed long, allowed boolean"


def consume_stream(requests: DataFrame, key: str, ts: str, request_id: str, points: int, duration: int, lateness: str = "10 minutes") -> DataFrame:
    """Judge each micro-batch's requests in order of time.

    A key's open window is its state and lives in event time: it goes when the
    watermark, ``lateness`` behind the latest request, has passed its end.  So
    neither a pause between batches nor a backlog closes a window early, and
    a stream that has read all of its input ends.  A request that comes after the
    watermark is left out, as in every stream with one.
    """
    length = duration * 1_000_000
    moment = F.col(ts).cast("timestamp")
    rows = requests.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.col(request_id).cast("long").alias("id"), F.unix_micros(moment).alias("us"),
        moment.alias("at")).withWatermark("at", lateness)

    def judge(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = (name[0], *state.get) if state.exists else None
        found = pd.concat(frames).sort_values(["us", "id"])
        n, _, last = windows_in_order(np.full(len(found), name[0], object), found["us"].to_numpy(), length, last)
        closes = -(-(last[1] + length) // 1000)
        if closes > state.getCurrentWatermarkMs():
            state.update((last[1], last[2]))
            state.setTimeoutTimestamp(int(closes))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": name[0], "id": found["id"].to_numpy(), "us": found["us"].to_numpy(), "consumed": n, "allowed": n <= points})

    return rows.groupBy("key").applyInPandasWithState(judge, OUTPUT, "opened long, used long", "append", GroupStateTimeout.EventTimeTimeout)
