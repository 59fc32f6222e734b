"""Counts, roll-ups and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def status_of(errors: Column, warns: Column) -> Column:
    """FAIL with errors, else WARN with warnings, else PASS."""
    return F.when(errors > 0, "FAIL").when(warns > 0, "WARN").otherwise("PASS")


def checks_rollup(findings: DataFrame, keys: list[str], error: Column, warn: Column) -> DataFrame:
    """n, errors, warns and status of each key (of everything, without keys)."""
    out = findings.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(error).alias("errors"), F.count_if(warn).alias("warns"))
    return out.withColumn("status", status_of(F.col("errors"), F.col("warns")))


def as_json(rollup: DataFrame) -> DataFrame:
    return rollup.select(F.to_json(F.struct(*rollup.columns)).alias("value"))


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def counts_with_zeros(spine: DataFrame, df: DataFrame, spine_key: str, key: str) -> DataFrame:
    """Rows of df for every key of the spine, zeros kept. df is counted before the join, so only one row a key meets the spine."""
    n = df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    return spine.select(spine_key).join(n, F.col(spine_key) == F.col("_k"), "left").select(spine_key, F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def repeated(df: DataFrame, key: str, more_than: int = 1) -> DataFrame:
    return counts(df, key).where(F.col("n") > more_than)


def trend(df: DataFrame, keys: list[str], day: Column) -> DataFrame:
    """Count by key and day, and its change from the key's day before (null at the first)."""
    daily = df.groupBy(*keys, day.alias("day")).agg(F.count("*").alias("n"))
    return daily.withColumn("delta", F.col("n") - F.lag("n").over(Window.partitionBy(*keys).orderBy("day")))


def recurring(df: DataFrame, keys: list[str], run: Column, least: int) -> DataFrame:
    """Keys seen in at least that many distinct runs."""
    return df.groupBy(*keys).agg(F.count_distinct(run).alias("runs")).where(F.col("runs") >= least)


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, total, least and most of a value."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def summary_of(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries rolled up, without a second look at the rows."""
    return summaries.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))


def suite(**parts: DataFrame) -> DataFrame:
    """Outputs of several tools under one `tool` column."""
    out = None
    for tool, df in parts.items():
        df = df.withColumn("tool", F.lit(tool))
        out = df if out is None else out.unionByName(df)
    return out


def files_over(changes: DataFrame, most: int = 9) -> DataFrame:
    """Files with more changed lines than allowed."""
    return repeated(changes, "file", most)
