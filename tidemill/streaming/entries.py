"""The last entry and the last revert of every edit, kept over a stream of ledger entries, with a notice for edits that never get an outcome."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENTRY = "seq long, action string, outcome string, revert_method string"
OUT = "edit_id string, kind string, seq long, action string, outcome string, revert_method string"


class LastEntries(StatefulProcessor):
    """State of an edit: its last entry, its last revert, whether it has an outcome, whether notice was given.

    Entries may come in any order: of two, the one with the larger seq is the later. A timer at an entry's time plus `patience`
    gives notice (kind unresolved) once, if by then no entry of the edit has had an outcome; it fires when the watermark has passed it.
    """

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", ENTRY)
        self.reverted = handle.getValueState("reverted", ENTRY)
        self.resolved = handle.getValueState("resolved", "done boolean")

    def _later(self, state, row: tuple) -> bool:
        if state.exists() and state.get()[0] >= row[0]:
            return False
        state.update(row)
        return True

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed: dict[str, tuple] = {}
        for frame in rows:
            frame = frame.astype(object).where(frame.notna(), None)
            for at, seq, *rest in zip(*(frame[c] for c in ("at", "seq", "action", "outcome", "revert_method"))):
                row = (int(seq), *rest)
                if self._later(self.last, row):
                    changed["last"] = row
                if row[1] == "revert" and self._later(self.reverted, row):
                    changed["revert"] = row
                if row[2] is not None:
                    self.resolved.update((True,))
                    for timer in list(self.handle.listTimers()):
                        self.handle.deleteTimer(timer)
                elif not self.resolved.exists():
                    due = int(pd.Timestamp(at).timestamp() * 1000) + self.patience_ms
                    self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        if changed:
            yield pd.DataFrame([(key[0], kind, *row) for kind, row in changed.items()], columns=["edit_id", "kind", "seq", "action", "outcome", "revert_method"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.resolved.exists():
            self.resolved.update((False,))
            row = self.last.get()
            yield pd.DataFrame([(key[0], "unresolved", *row)], columns=["edit_id", "kind", "seq", "action", "outcome", "revert_method"])

    def close(self) -> None:
        pass


def last_entries(entries: DataFrame, late: str = "30 days", patience_ms: int = 86_400_000) -> DataFrame:
    """Rows of OUT for a stream of entries (edit_id, at timestamp, seq, action, outcome, revert_method), as they change.

    kind: last, revert or unresolved. A later row of one edit and kind replaces those before it: the one with the largest seq
    holds, which after all input equals latest.latest() over the table without entries more than `late` behind the latest time of
    the batches up to the one before last: Spark drops those. Entries without edit_id, seq or time are left out. State is kept by RocksDB, an entry or two an edit.
    """
    spark = entries.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = entries.where("edit_id is not null and seq is not null and at is not null").withWatermark("at", late).select("edit_id", "at", "seq", "action", "outcome", "revert_method")
    return rows.groupBy("edit_id").transformWithStateInPandas(LastEntries(patience_ms), OUT, "Update", "EventTime")


def holding(emitted: DataFrame) -> DataFrame:
    """What holds after all that last_entries() emitted: one row an edit and kind."""
    names = ["seq", "action", "outcome", "revert_method"]
    return emitted.groupBy("edit_id", "kind").agg(F.max_by(F.struct(*names), "seq").alias("e")).select("edit_id", "kind", "e.*")
