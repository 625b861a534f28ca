"""Tables as versioned Parquet folders with one manifest per commit.

A commit writes new folders first and then one small manifest, whose name is
the next number.  Creating that file fails if it is there, so of two writers
one wins; readers see all tables of a commit or none.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.spec import SpecError, TableSpec


class CommitConflict(SpecError):
    """Another writer committed first."""


class Catalog:
    def __init__(self, spark: SparkSession, root: str, specs: dict[str, TableSpec]):
        self.spark, self.root, self.specs = spark, root.rstrip("/"), specs

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_commits")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return jvm, fs, path

    def _latest(self) -> tuple[int, dict[str, str]]:
        jvm, fs, path = self._files()
        if not fs.exists(path):
            return 0, {}
        numbers = [int(s.getPath().getName()[:-5]) for s in fs.listStatus(path) if s.getPath().getName().endswith(".json")]
        if not numbers:
            return 0, {}
        n = max(numbers)
        line = self.spark.read.text(f"{self.root}/_commits/{n:08d}.json").first()[0]
        return n, json.loads(line)

    def read(self, table: str) -> DataFrame:
        """The table as of the last commit; empty before its first one."""
        spec = self.specs[table]
        _, paths = self._latest()
        if table not in paths:
            return self.spark.createDataFrame([], spec.partial_struct())
        return self.spark.read.schema(spec.partial_struct()).parquet(f"{self.root}/{paths[table]}")

    def read_all(self) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in self.specs}

    def version(self) -> int:
        return self._latest()[0]

    def publish(self, tables: dict[str, DataFrame], base: int | None = None) -> int:
        """Write new versions of ``tables`` and commit them together; ``base`` is the version they were made from."""
        current, paths = self._latest()
        if base is not None and base != current:
            raise CommitConflict(f"made from version {base}, the last is {current}")
        new = dict(paths)
        for name, df in tables.items():
            folder = f"{name}/{uuid.uuid4().hex}"
            df.select(*self.specs[name].columns).write.parquet(f"{self.root}/{folder}")
            new[name] = folder
        jvm, fs, path = self._files()
        fs.mkdirs(path)
        target = jvm.org.apache.hadoop.fs.Path(path, f"{current + 1:08d}.json")
        try:
            out = fs.create(target, False)
        except Exception as e:
            raise CommitConflict(f"version {current + 1} is there already") from e
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        return current + 1


def recordset(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The rows of a JSON array of objects with their ordinal, as typed columns."""
    parsed = F.from_json(F.col(column), f"array<struct<{schema}>>")
    return df.select(F.posexplode(parsed).alias("ordinality", "__r")).select(F.col("ordinality").cast("long").alias("ordinality"), "__r.*")


def each_entry(df: DataFrame, column: str) -> DataFrame:
    """Key and value rows of a JSON object column (variant)."""
    entries = F.map_entries(F.col(column).cast("map<string,variant>"))
    return df.select("*", F.explode(entries).alias("__e")).select("*", F.col("__e.key").alias("key"), F.col("__e.value").alias("value")).drop("__e")
