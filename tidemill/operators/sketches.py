"""Mergeable sketches of runs: distinct counts (HyperLogLog) and quantiles (KLL), kept by run and merged without a second look at rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: log2 of HyperLogLog's registers (standard error about 1.04 / sqrt(2 ** 14) = 0.8 %) and KLL's k (rank error about 0.8 %).
LG_K, KLL_K = 14, 400


def run_sketches(rows: DataFrame, keys: Sequence[str], ids: str, value: str, lg_k: int = LG_K, kll_k: int = KLL_K) -> DataFrame:
    """(keys, n, total, ids, spread): rows, sum of value, and binary sketches of the distinct ids and of value, one row a key.

    Nulls of ids and value aren't counted in their sketches; a key without values has a null spread.
    """
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("total"),
        F.hll_sketch_agg(F.col(ids).cast("string"), lg_k).alias("ids"),
        F.when(F.count(value) > 0, F.kll_sketch_agg_double(F.col(value).cast("double"), kll_k)).alias("spread"),
    )


def store_run(sketches: DataFrame, path: str, run) -> None:
    """Puts a run's sketches into its own partition; storing a run again replaces that partition alone."""
    sketches.write.mode("overwrite").parquet(f"{path}/run={run}")


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of several runs, or of finer keys, as one row a key."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("ids").alias("ids"), F.kll_merge_agg_double("spread").alias("spread")
    )


def distinct(sketch: Column | str) -> Column:
    """The estimated number of distinct ids."""
    return F.hll_sketch_estimate(sketch)


def quantile(sketch: Column | str, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(q))


def trend(sketches: DataFrame, keys: Sequence[str], run: str) -> DataFrame:
    """(keys, run, n, ids_seen, ids_new): the estimated distinct ids of each run and how many of them no earlier run had.

    ids_new is the growth of the merged sketch; a running merge over a key's runs, one small row each.
    """
    from pyspark.sql.window import Window

    past = Window.partitionBy(*keys).orderBy(run)
    grown = sketches.withColumn("_all", F.hll_union_agg("ids").over(past.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.hll_sketch_estimate("_all")
    out = grown.withColumn("_total", total)
    return out.select(*keys, run, "n", F.hll_sketch_estimate("ids").alias("ids_seen"), (F.col("_total") - F.coalesce(F.lag("_total").over(past), F.lit(0))).alias("ids_new"))
