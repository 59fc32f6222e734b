"""Newest, last and capped records.

All rankings use row_number under a filter, which Spark turns into a per-partition group limit before the
shuffle, or an aggregate of a struct, which combines before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def newest_per_key(df: DataFrame, keys: list[str], time: str, tie: str, keep: int = 10) -> DataFrame:
    """The `keep` newest rows of each key; ties in time go to the larger `tie`."""
    return _ranked(df, keys, [F.desc(time), F.desc(tie)]).where(F.col("_rank") <= keep).drop("_rank")


def stale_per_key(df: DataFrame, keys: list[str], keep: int = 10) -> DataFrame:
    """How many rows of each key are beyond the newest `keep`; no ranking needed."""
    return df.groupBy(*keys).agg(F.greatest(F.count("*") - keep, F.lit(0)).cast("long").alias("stale"))


def latest(df: DataFrame, keys: list[str], order: list[str], *values: str) -> DataFrame:
    """The values of each key's last row by `order`, in one aggregate."""
    last = F.max(F.struct(*order, *(v for v in values if v not in order)))
    return df.groupBy(*keys).agg(last.alias("_last")).select(*keys, *(F.col(f"_last.{v}").alias(v) for v in values))


def latest_where(df: DataFrame, condition: Column, keys: list[str], order: list[str], *values: str) -> DataFrame:
    """As latest, among rows that meet the condition."""
    return latest(df.where(condition), keys, order, *values)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in order; a top-k plan, not a sort."""
    return df.orderBy(*order).limit(n)


def capped(df: DataFrame, caps: dict[str, int], section: str, position: str) -> DataFrame:
    """The first rows of each section by position, as many as its cap; sections without a cap go. The largest cap limits groups before the shuffle."""
    cap = F.create_map(*(F.lit(x) for kv in caps.items() for x in kv))[F.col(section)]
    most = _ranked(df.where(F.col(section).isin(*caps)), [section], [F.asc(position)]).where(F.col("_rank") <= max(caps.values()))
    return most.where(F.col("_rank") <= cap).drop("_rank")


def first_and_last(df: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """The value at each key's first and last position."""
    return df.groupBy(*keys).agg(F.min_by(value, position).alias("first"), F.max_by(value, position).alias("last"))


def last_lines(lines: DataFrame, n: int = 2) -> DataFrame:
    """The last n lines (file, pos, line) of each file, verbatim."""
    return _ranked(lines, ["file"], [F.desc("pos")]).where(F.col("_rank") <= n).drop("_rank")


def last_matching(lines: DataFrame, pattern: str) -> DataFrame:
    """The last line of each file that matches."""
    return latest_where(lines, F.col("line").rlike(pattern), ["file"], ["pos"], "line")
