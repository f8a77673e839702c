"""Tables with atomic batches and snapshots: every commit is a folder of its own, and counts once the log names it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from types import TracebackType
from typing import Self

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "version int, folder string, operations int, kinds array<string>, at timestamp"


class SnapshotTable:
    """Versions of a table with an id column, under a path that the cluster shares. One writer at a time; readers are never disturbed.

    A version whose write failed, or whose batch was rolled back, is in no log line, so nobody reads it. Nothing is deleted.
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str = "id") -> None:
        self.spark, self.path, self.id_col = spark, path.rstrip("/"), id_col

    @classmethod
    def create(cls, df: DataFrame, path: str, id_col: str = "id") -> Self:
        made = cls(df.sparkSession, path, id_col)
        made._publish(df, 0, [])
        return made

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).json(f"{self.path}/log")

    def _named(self, version: int | None):  # noqa: ANN202
        lines = self.log() if version is None else self.log().where(F.col("version") == version)
        found = lines.orderBy(F.desc("version")).limit(1).collect()
        if not found:
            raise LookupError(f"no version {version} at {self.path}")
        return found[0]

    def read(self, version: int | None = None) -> DataFrame:
        """The latest version, or an earlier one."""
        return self.spark.read.parquet(f"{self.path}/data/{self._named(version).folder}")

    def restore(self, version: int) -> int:
        """An earlier version becomes the latest: a line in the log, without a copy."""
        folder = self._named(version).folder
        return self._note(self._named(None).version + 1, folder, ["restore"])

    def stats(self) -> DataFrame:
        """Commits, their operations and the time of the last one."""
        return self.log().where("version > 0").agg(F.count("*").alias("commits"), F.coalesce(F.sum("operations"), F.lit(0)).alias("operations"), F.max("at").alias("last_at"))

    def _publish(self, df: DataFrame, version: int, kinds: list[str]) -> int:
        folder = f"v{version}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/data/{folder}")
        return self._note(version, folder, kinds)

    def _note(self, version: int, folder: str, kinds: list[str]) -> int:
        line = self.spark.range(1).select(F.lit(version).alias("version"), F.lit(folder).alias("folder"), F.lit(len(kinds)).alias("operations"), F.array(*map(F.lit, kinds)).cast("array<string>").alias("kinds"), F.current_timestamp().alias("at"))
        line.coalesce(1).write.mode("append").json(f"{self.path}/log")
        return version

    def begin(self) -> Batch:
        return Batch(self)


class Batch:
    """Operations in order, each of them a whole DataFrame, applied as one plan and written once by commit().

    As a context it commits at its end, and drops everything on an exception, which goes on. Null ids match nothing; a stored row takes
    the place of rows with its id; null values of an update leave a column as it is, and of repeated ids in an update the greatest row counts.
    """

    def __init__(self, table: SnapshotTable) -> None:
        self.table = table
        self._steps: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []
        self._done = False

    def store(self, rows: DataFrame) -> Self:
        key = self.table.id_col
        self._steps.append(("store", lambda now: now.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True).select(now.columns)))
        return self

    def delete(self, ids: DataFrame) -> Self:
        key = self.table.id_col
        self._steps.append(("delete", lambda now: now.join(ids.select(key), key, "left_anti").select(now.columns)))
        return self

    def update(self, rows: DataFrame) -> Self:
        key = self.table.id_col
        names = [c for c in rows.columns if c != key]

        def apply(now: DataFrame) -> DataFrame:
            new = rows.groupBy(key).agg(F.max(F.struct(*names)).alias("__new"))
            both = now.join(new, key, "left")
            return both.select(*(F.coalesce(F.col(f"__new.{c}"), F.col(c)).cast(now.schema[c].dataType).alias(c) if c in names else F.col(c) for c in now.columns))

        self._steps.append(("update", apply))
        return self

    def commit(self) -> int | None:
        """The new version; None if nothing was asked or the batch is over."""
        if self._done or not self._steps:
            return None
        self._done = True
        latest = self.table._named(None)
        now = self.table.read(latest.version)
        for _, step in self._steps:
            now = step(now)
        return self.table._publish(now, latest.version + 1, [kind for kind, _ in self._steps])

    def rollback(self) -> None:
        self._steps, self._done = [], True

    def __enter__(self) -> Self:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        if kind is None:
            self.commit()
        else:
            self.rollback()
