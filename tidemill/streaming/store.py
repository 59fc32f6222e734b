"""A capped store: the newest rows of each key, kept as a log of runs with compaction, so that what is on disk stays bounded."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemill.operators.latest import newest_per_key
from tidemill.storage import Folder

#: Runs that are merged into one once there are so many.
RUNS = 8


class CappedStore:
    """The newest `keep` rows of each key by time (ties: the larger tie), under a path.

    append() writes a run (rows already capped) and commits a manifest, a numbered list of runs that is written aside and renamed. When a
    manifest lists RUNS runs they are merged and capped into one. Only the last two manifests and the runs
    that they list are kept: a reader works on the manifest that it opened, and finds its files until two more commits have been made. What a
    crash leaves is in no manifest and goes with the next commit. One writer at a time; a second one fails at its commit.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: Sequence[str], time: str, tie: str, keep: int = 10, runs: int = RUNS):
        self.spark, self.schema, self.keys, self.time, self.tie, self.keep, self.runs = spark, schema, list(keys), time, tie, keep, runs
        self.folder = Folder(spark, path)

    def _last(self) -> tuple[int, dict]:
        names = self.folder.names("manifests")
        return (int(names[-1].split(".")[0]), self.folder.read(f"manifests/{names[-1]}")) if names else (0, {"runs": [], "batches": []})

    def _newest(self, rows: DataFrame) -> DataFrame:
        return newest_per_key(rows, self.keys, self.time, self.tie, self.keep)

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder.path}/runs/{name}")
        return name

    def _read(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder.path}/runs/{r}" for r in runs))

    def append(self, rows: DataFrame, batch: int | None = None) -> None:
        """Adds rows. A batch number that the store has seen adds nothing, so that a stream may repeat its last batch."""
        number, last = self._last()
        if batch is not None and batch in last["batches"]:
            return
        runs = [*last["runs"], self._write(self._newest(rows.select(*self._read([]).columns)))]
        if len(runs) >= self.runs:
            runs = [self._write(self._newest(self._read(runs)))]
        batches = last["batches"] if batch is None else [*last["batches"], batch][-16:]
        if not self.folder.create(f"manifests/{number + 1:012d}.json", {"runs": runs, "batches": batches}):
            raise RuntimeError(f"another writer made version {number + 1} of {self.folder.path}")
        self._clean()

    def _clean(self) -> None:
        names = self.folder.names("manifests")
        for old in names[:-2]:
            self.folder.delete(f"manifests/{old}")
        listed = {r for n in names[-2:] for r in self.folder.read(f"manifests/{n}")["runs"]}
        for run in set(self.folder.names("runs")) - listed:
            self.folder.delete(f"runs/{run}")

    def read(self) -> DataFrame:
        """The newest rows as of the last manifest."""
        return self._newest(self._read(self._last()[1]["runs"]))

    def follow(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Appends a stream's batches."""
        return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.append).trigger(availableNow=True).start()
