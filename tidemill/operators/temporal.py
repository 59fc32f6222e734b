"""As-of joins and joins of overlapping intervals.

Neither plan has a nested loop, and neither brings all rows of a key together: as-of joins cut a key's time into buckets and hand
the last row before each bucket on to it; interval joins meet in cells of a grid whose width follows the intervals' lengths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window

#: Cells of one level are this many times as wide as those below.
STEP = 4


def number(df: DataFrame, column: str) -> Column:
    """A time as a whole number that orders alike: days of a date, microseconds of a timestamp, a numeric column's floor."""
    kind = df.schema[column].dataType
    if isinstance(kind, DateType):
        return F.datediff(F.col(column), F.lit("1970-01-01")).cast("long")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp"))
    if isinstance(kind, NumericType):
        return F.floor(column).cast("long")
    raise TypeError(f"{column} is neither a time nor a number")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, right_time: str, values: dict[str, str], tie: str, width: int, strict: bool = False, within: int | None = None, how: str = "left") -> DataFrame:
    """Rows of left with the values of the last row of right that has their keys and a time not after theirs (strict: before).

    values: right's columns and the names they get. Of right's rows at one time the one with the largest `tie` counts. within: how far
    back that row may lie, in number()'s unit, as is width. how: left, or inner to drop rows without a match.

    A key's rows are cut into buckets of `width`, so a hot key is shared by as many tasks as it has buckets; one summary row a
    key and bucket finds each bucket's carry-over. Rows of left with a null key or time stay, unmatched (how inner: go); such rows of right match nothing.
    Repeated rows stay.
    """
    keys = list(keys)
    known = lambda df, t: F.col(t).isNotNull() & ~F.greatest(*(F.col(k).isNull() for k in keys), F.lit(False))
    row_type = left.schema.simpleString()
    found = F.struct(number(right, right_time).alias("_at"), *(F.col(c).alias(n) for c, n in values.items()))
    r = right.where(known(right, right_time)).select(*keys, number(right, right_time).alias("_t"), F.col(tie).alias("_tie"), found.alias("_r"))
    whole = left.select(*keys, F.struct(*left.columns).alias("_l"), number(left, time).alias("_t"), known(left, time).alias("_known"))
    bucket = F.floor(F.col("_t") / F.lit(width)).cast("long").alias("_b")
    lefts = whole.where("_known").select(*keys, bucket, "_t", F.lit(1).alias("_side"), "_l")
    rights = r.select(*keys, bucket, "_t", F.lit(2 if strict else 0).alias("_side"), "_tie", "_r")

    last = rights.groupBy(*keys, "_b").agg(F.max_by("_r", F.struct("_t", "_tie")).alias("_r"), F.lit(False).alias("_wanted"))
    wanted = lefts.select(*keys, "_b", F.lit(None).cast(rights.schema["_r"].dataType).alias("_r"), F.lit(True).alias("_wanted")).distinct()
    marks = last.unionByName(wanted).groupBy(*keys, "_b").agg(F.first("_r", ignorenulls=True).alias("_r"), F.max("_wanted").alias("_wanted"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("_r", F.last("_r", ignorenulls=True).over(before)).where("_wanted and _r is not null")
    carried = carried.select(*keys, "_b", F.lit(-(2**63)).cast("long").alias("_t"), F.lit(-1).alias("_side"), F.lit(None).cast(rights.schema["_tie"].dataType).alias("_tie"), "_r")

    every = rights.unionByName(carried).withColumn("_l", F.lit(None).cast(row_type))
    every = every.unionByName(lefts.withColumn("_tie", F.lit(None).cast(rights.schema["_tie"].dataType)).withColumn("_r", F.lit(None).cast(rights.schema["_r"].dataType)))
    here = Window.partitionBy(*keys, "_b").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    met = every.withColumn("_r", F.last("_r", ignorenulls=True).over(here)).where("_side = 1").select("_l", "_t", "_r")
    if within is not None:
        met = met.withColumn("_r", F.when(F.col("_t") - F.col("_r._at") <= within, F.col("_r")))
    met = met.unionByName(whole.where("not _known").select("_l", "_t", F.lit(None).cast(rights.schema["_r"].dataType).alias("_r")))
    if how == "inner":
        met = met.where("_r is not null")
    return met.select(*(F.col("_l")[c].alias(c) for c in left.columns), *(F.col("_r")[n].alias(n) for n in values.values()))


def _levels(side: DataFrame) -> list[int]:
    return [r[0] for r in side.select("_level").distinct().collect()]  # a few, as each is STEP times as wide


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], base: int = 1) -> DataFrame:
    """Pairs of rows with equal keys (or any, without keys) whose closed intervals share a point: left's columns, then right's without the keys.

    An interval lies in one or two cells of the level whose cells are at least as wide as it is long (level 0: `base` of number()'s unit). A pair
    meets once, in its first common cell of the coarser of its two levels. So an interval makes at most two rows a
    level that occurs, however long it is, and what is met without overlapping is a small multiple of what overlaps where lengths of a level are evenly spread.

    A point is an interval of equal ends. Null ends, ends before starts and null keys match nothing. Columns other than keys need distinct names.
    """
    keys = list(keys)

    def side(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        start, end = (number(df, c) for c in span)
        row = df.select(*keys, F.struct(*(c for c in df.columns if c not in keys or name == "_l")).alias(name), start.alias(f"{name}s"), end.alias(f"{name}e"))
        long = (F.col(f"{name}e") - F.col(f"{name}s") + 1).cast("double") / base
        level = F.greatest(F.ceil(F.log(long) / F.log(F.lit(float(STEP))) - 1e-9), F.lit(0)).cast("int")
        return row.where(F.col(f"{name}s") <= F.col(f"{name}e")).withColumn("_level", level)

    def cells(df: DataFrame, name: str, levels: list[int]) -> DataFrame:
        cell = lambda at, n: F.floor(F.col(at) / F.lit(base * STEP**n)).cast("long")
        options = F.array(*(F.struct(F.lit(n).alias("n"), cell(f"{name}s", n).alias("from"), cell(f"{name}e", n).alias("to")) for n in levels))
        each = df.withColumn("_c", F.explode(F.filter(options, lambda x: x["n"] >= F.col("_level"))))
        return each.select("*", F.col("_c.n").alias("_n"), F.col("_c.from").alias(f"{name}f"), F.explode(F.sequence("_c.from", "_c.to")).alias("_cell")).withColumnRenamed("_level", f"{name}v").drop("_c")

    a, b = side(left, left_span, "_l"), side(right, right_span, "_r")
    levels = sorted({*_levels(a), *_levels(b)})
    if not levels:
        levels = [0]
    meet = (F.col("_n") == F.greatest("_lv", "_rv")) & (F.col("_cell") == F.greatest("_lf", "_rf")) & (F.col("_ls") <= F.col("_re")) & (F.col("_rs") <= F.col("_le"))
    pairs = cells(a, "_l", levels).join(cells(b, "_r", levels), [*keys, "_n", "_cell"]).where(meet)
    return pairs.select(*(F.col("_l")[c].alias(c) for c in left.columns), *(F.col("_r")[c].alias(c) for c in right.columns if c not in keys))
