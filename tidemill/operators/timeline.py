"""Snapshots as validity intervals: (keys, value, valid_from, valid_to), and a table of them that runs are merged into."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.session import cut

BUCKETS = 64


def intervals(rows: DataFrame, keys: Sequence[str], run: str, value: str) -> DataFrame:
    """How long each key kept each value over the runs in rows: from its first run with it to the first run without (null: it lasts).

    A run in which a key doesn't occur ends its value; a null value is a value. Of several rows of a key in a run the largest value counts.
    Runs are numbered in one small window over the distinct runs.
    """
    keys = list(keys)
    numbers = rows.select(run).where(F.col(run).isNotNull()).distinct().withColumn("_n", F.row_number().over(Window.orderBy(run)))
    one = rows.where(F.col(run).isNotNull()).groupBy(*keys, run).agg(F.max(value).alias(value)).join(numbers, run)
    own = Window.partitionBy(*keys).orderBy("_n")
    same = F.lag(value).over(own).eqNullSafe(F.col(value)) & (F.lag("_n").over(own) == F.col("_n") - 1)
    islands = one.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(own))
    spans = islands.groupBy(*keys, "_island").agg(F.first(value).alias(value), F.min(run).alias("valid_from"), (F.max("_n") + 1).alias("_n"))
    ends = numbers.select("_n", F.col(run).alias("valid_to"))
    return spans.join(ends, "_n", "left").select(*keys, value, "valid_from", "valid_to")


class Timeline:
    """A table of intervals under a path: open ones by a hash of their keys, closed ones by the run that closed them.

    merge() of a run adds the partition of what that run closed and rewrites only those buckets of open intervals that
    hold a key whose interval began or ended. Merging the last run again, with other rows or after a crash, first takes
    that run back: intervals that began with it go and those that it closed are open again. A run before the last one isn't merged.
    Runs have one type (run_type, a type's name) that orders in time. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], value: str, run_type: str = "string", buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.value, self.run_type, self.buckets = spark, path, list(keys), value, run_type, buckets

    def _read(self, part: str) -> DataFrame | None:
        try:
            found = self.spark.read.parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        if "valid_to" not in found.columns:
            return found
        types = ", ".join(f"`{f.name}` {self.run_type if f.name == 'valid_to' else f.dataType.simpleString()}" for f in found.schema)
        return self.spark.read.schema(types).parquet(f"{self.path}/{part}")  # a folder's name is a run, not whatever it looks like

    def merge(self, rows: DataFrame, run) -> int:
        """Merges the rows (keys, value) of a run; returns how many buckets of open intervals were rewritten."""
        keys, value = self.keys, self.value
        now = rows.groupBy(*keys).agg(F.max(value).alias("_new")).withColumn("_seen", F.lit(True))
        blank = rows.select(*keys, value, F.lit(run).cast(self.run_type).alias("valid_from")).where("false")
        stored = self._read("open")
        stored = blank if stored is None else stored.select(*keys, value, "valid_from")
        closed = self._read("closed")
        last = max((x for x in (stored.agg(F.max("valid_from")).first()[0], closed.agg(F.max("valid_to")).first()[0] if closed is not None else None) if x is not None), default=None)
        if last is not None and last > run:
            raise ValueError(f"run {run} is before {last}, which is merged")
        before = stored.where(F.col("valid_from") != F.lit(run))
        if closed is not None:
            again = closed.where(F.col("valid_to") == F.lit(run)).select(*keys, value, "valid_from")
            before = before.unionByName(again).dropDuplicates([*keys, "valid_from"])
        nulls = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        b = before.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(value).alias("_old"), F.col("valid_from").alias("_from"))
        both = cut(now.join(b, nulls, "full_outer"))
        stays = F.col("_seen") & F.col("_from").isNotNull() & F.col("_old").eqNullSafe(F.col("_new"))
        key = [F.when(F.col("_seen"), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys]
        ended = both.where(F.col("_from").isNotNull() & ~F.coalesce(stays, F.lit(False))).select(*key, F.col("_old").alias(value), F.col("_from").alias("valid_from"))
        begun = F.when(F.coalesce(stays, F.lit(False)), F.col("_from")).otherwise(F.lit(run).cast(self.run_type))
        state = both.where("_seen").select(*key, F.col("_new").alias(value), begun.alias("valid_from"))
        state, held = self._bucketed(state), self._bucketed(stored)
        row = [F.struct(*keys, value, "valid_from")]
        touched = state.select("bucket", F.xxhash64(*row).alias("h")).groupBy("bucket").agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("h"), F.count("*").alias("n"))
        held_marks = held.select("bucket", F.xxhash64(*row).alias("h")).groupBy("bucket").agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("g"), F.count("*").alias("m"))
        changed = [r[0] for r in touched.join(held_marks, "bucket", "full_outer").where("not (h <=> g and n <=> m)").select("bucket").collect()]  # at most `buckets`
        ended.write.mode("overwrite").parquet(f"{self.path}/closed/valid_to={run}")
        if changed:
            new = cut(state.where(F.col("bucket").isin(changed)))
            gone = sorted(set(changed) - {r[0] for r in new.select("bucket").distinct().collect()})
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/open")
            for bucket in gone:  # a bucket that lost its last key
                new.where("false").drop("bucket").write.mode("overwrite").parquet(f"{self.path}/open/bucket={bucket}")
        return len(changed)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def read(self) -> DataFrame:
        """All intervals; what holds now is where valid_to is null."""
        now, closed = self._read("open"), self._read("closed")
        if now is None:
            raise ValueError(f"no run with rows is merged in {self.path}")
        now = now.select(*self.keys, self.value, "valid_from", F.lit(None).cast(self.run_type).alias("valid_to"))
        return now if closed is None else closed.select(*now.columns).unionByName(now)

    def at(self, run) -> DataFrame:
        """(keys, value) as they were in a run; of closed intervals only partitions of later runs are read."""
        return self.read().where((F.col("valid_from") <= F.lit(run)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(run)))).select(*self.keys, self.value)
