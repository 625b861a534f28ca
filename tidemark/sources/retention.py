"""The event log: hour partitions, what to add ahead and what to drop."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LogConfig:
    """Settings of the event log, each with its default."""

    keep_hours: int = 2
    ahead_hours: int = 12
    read_chunk: int = 1000

    @classmethod
    def of(cls, table: DataFrame) -> "LogConfig":
        """Settings from a table (key, value); unknown keys raise."""
        given = {r[0]: r[1] for r in table.select("key", "value").collect()}
        if unknown := set(given) - set(cls.__dataclass_fields__):
            raise ValueError(f"no setting {sorted(unknown)[0]}")
        return cls(**{k: int(v) for k, v in given.items() if v is not None})


DEFAULT = LogConfig()


def hour_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHH")


def append_events(events: DataFrame, path: str) -> None:
    """Add events to the log, one folder per hour; variants are kept as JSON text."""
    flat = events.withColumns({c: F.to_json(c) for c, kind in events.dtypes if kind == "variant"})
    flat.withColumn("hour", hour_of(F.col("ts"))).write.mode("append").partitionBy("hour").parquet(path)


def read_events(df: DataFrame) -> DataFrame:
    """The log's rows with variants again; works for batch and streaming reads."""
    return df.withColumns({c: F.try_parse_json(c) for c in ("row_before", "row_data", "diff")}).drop("hour")


def partitions_ahead(now: datetime, config: LogConfig = DEFAULT) -> list[str]:
    """This hour and those ahead."""
    start = now.replace(minute=0, second=0, microsecond=0)
    return [(start + timedelta(hours=h)).strftime("%Y%m%d%H") for h in range(config.ahead_hours + 1)]


def expired(hours: DataFrame, now: Column, config: LogConfig = DEFAULT) -> DataFrame:
    """Partitions (column ``hour``) older than the kept time."""
    return hours.where(F.col("hour") < hour_of(now - F.expr(f"INTERVAL {config.keep_hours} HOURS")))


def drop_expired(spark: SparkSession, path: str, now: datetime, config: LogConfig = DEFAULT) -> list[str]:
    """Remove the log's folders of hours older than the kept time; gives the hours that went, oldest first."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = (now - timedelta(hours=config.keep_hours)).strftime("%Y%m%d%H")
    named = [s.getPath() for s in files.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("hour=")]
    gone = [p for p in named if p.getName().removeprefix("hour=") < last]
    for p in gone:
        files.delete(p, True)
    return sorted(p.getName().removeprefix("hour=") for p in gone)
