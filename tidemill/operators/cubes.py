"""Cubes and grouping sets with distinct counts, in two phases."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import tasks_for

#: Rows of a task; it may hold each of them once a set.
ROWS = 1 << 17


def cube_distinct(df: DataFrame, dims: Sequence[str], ids: str, sums: dict[str, str] | None = None, sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """(dims, level, n, ids, sums): rows, distinct ids and sums for every subset of dims, or for the sets given.

    Rows are first combined to one a combination of dims and id, and only those are expanded to the sets. All of an id lies in one of as many tasks
    as ROWS asks for, so ids are told apart there and only counts leave it. A repeated set counts once. level is the grouping id: a
    bit for each dimension left out, the first dimension highest, which tells a null value from a left-out dimension. Null ids aren't counted among
    ids, but their rows are among n.
    """
    dims, sums = list(dims), sums or {}
    one = df.repartition(tasks_for(df, ROWS), F.col(ids)).groupBy(*dims, F.col(ids).alias("_id")).agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_{name}") for name, c in sums.items()))
    held = [s for n, s in enumerate(map(set, sets)) if s not in list(map(set, sets))[:n]] if sets is not None else None
    few = one.groupBy(*dims).agg(*(F.sum(c).alias(c) for c in ("_n", *(f"_{name}" for name in sums))))
    grouped = few.cube(*dims) if held is None else few.groupingSets([[F.col(c) for c in s] for s in held], *(F.col(c) for c in dims))
    rows = grouped.agg(F.grouping_id().cast("long").alias("level"), F.sum("_n").alias("n"), *(F.sum(f"_{name}").alias(name) for name in sums)).withColumn("ids", F.lit(0).cast("long"))

    every = held if held is not None else [set(s) for n in range(len(dims) + 1) for s in combinations(dims, n)]
    level = lambda s: sum(1 << (len(dims) - 1 - i) for i, c in enumerate(dims) if c not in s)
    kept = [F.struct(F.lit(level(s)).cast("long").alias("level"), *((F.col(c) if c in s else F.lit(None).cast(one.schema[c].dataType)).alias(c) for c in dims)) for s in every]
    each = one.where("_id is not null").select("_id", F.explode(F.array(*kept)).alias("_s")).select("_id", "_s.*")
    found = each.groupBy("level", *dims, "_id").agg(F.lit(1).alias("_one")).groupBy("level", *dims).agg(F.count("*").alias("ids"))
    both = rows.unionByName(found, allowMissingColumns=True)
    return both.groupBy(*dims, "level").agg(*(F.sum(c).alias(c) for c in ("n", "ids", *sums))).select(*dims, "level", "n", "ids", *sums)
