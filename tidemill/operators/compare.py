"""Comparisons of two record sets by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import cut


def overridden(base: DataFrame, over: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Base rows with the value of the override where there is one; `tier` says which."""
    o = over.select(*keys, F.col(value).alias("_over"))
    return base.join(o, keys, "left").select(*keys, F.coalesce("_over", value).alias(value), F.when(F.col("_over").isNull(), "global").otherwise("project").alias("tier"))


def difference(before: DataFrame, after: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """added, deleted, kept or (with a value) changed, for every key of either side."""
    b = before.select(key, F.lit(1).alias("_b"), *([F.col(value).alias("_bv")] if value else []))
    a = after.select(key, F.lit(1).alias("_a"), *([F.col(value).alias("_av")] if value else []))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "deleted")
    if value:
        change = change.when(~F.col("_av").eqNullSafe(F.col("_bv")), "changed")
    out = b.join(a, key, "full_outer").withColumn("change", change.otherwise("kept"))
    return out.select(key, "change", *([F.col("_bv").alias("before"), F.col("_av").alias("after")] if value else []))


def move_conflicts(moves: DataFrame) -> DataFrame:
    """(old_path, targets): paths that a move manifest (old_path, new_path) moves to more than one place."""
    return moves.where("old_path is not null and new_path is not null").groupBy("old_path").agg(F.array_sort(F.collect_set("new_path")).alias("targets")).where("size(targets) > 1")


def followed(moves: DataFrame) -> DataFrame:
    """A move manifest (old_path, new_path), one row a path, with chains of moves followed to their ends. Moves in a circle end somewhere in it.

    A move listed several times counts once; of several targets of one path the least counts (see move_conflicts); nulls and moves to the same
    place go. Each round doubles how far every chain is followed and is cut, so plans don't grow.
    """
    one = moves.where("old_path is not null and new_path is not null and old_path <> new_path")
    now, before = cut(one.groupBy("old_path").agg(F.min("new_path").alias("new_path"))), None
    while True:
        ahead = now.select(F.col("old_path").alias("new_path"), F.col("new_path").alias("_next"))
        step = cut(now.join(ahead, "new_path", "left").select("old_path", "new_path", F.when(F.col("_next") != F.col("new_path"), F.col("_next")).alias("_next")))
        n = step.where("_next is not null").count()
        if n == 0 or n == before:  # only circles are left
            return now
        now, before = step.select("old_path", F.coalesce("_next", "new_path").alias("new_path")), n


def rewritten(refs: DataFrame, moves: DataFrame, path: str = "path") -> DataFrame:
    """References with paths as the move manifest (old_path, new_path) has them, as many rows as before; a path without a move stays.

    Of several targets of one path the least counts. See followed() for chains.
    """
    one = moves.groupBy(F.col("old_path").alias("_old")).agg(F.min("new_path").alias("_new"))
    return refs.join(one, refs[path] == one["_old"], "left").withColumn(path, F.coalesce("_new", F.col(path))).drop("_old", "_new")


def verified(found: DataFrame, manifest: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """ok, changed, missing or extra, for every key of files or manifest."""
    f, m = found.select(key, F.col(digest).alias("_f")), manifest.select(key, F.col(digest).alias("_m"))
    state = F.when(F.col("_m").isNull(), "extra").when(F.col("_f").isNull(), "missing").when(F.col("_f") == F.col("_m"), "ok").otherwise("changed")
    return f.join(m, key, "full_outer").select(key, state.alias("state"))


def same_content(df: DataFrame, key: str, content: str) -> DataFrame:
    """Digests that several keys share: digest, how many, the least key."""
    return df.groupBy(F.sha2(F.col(content).cast("string"), 256).alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def missing(expected: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Expected rows that aren't found."""
    return expected.join(found.select(*on), on, "left_anti")


def present(expected: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Expected rows that are found."""
    return expected.join(found.select(*on), on, "left_semi")


def consumers(assets: DataFrame, path: str = "path", depends_on: str = "depends_on") -> DataFrame:
    """(asset, consumer): who depends on what, from each asset's array of dependencies, which may repeat or be null."""
    return assets.select(F.explode(F.array_distinct(depends_on)).alias("asset"), F.col(path).alias("consumer")).where("asset is not null")


def with_roles(assets: DataFrame, roles: list[str], every: bool = False, column: str = "roles") -> DataFrame:
    """Assets whose array of role tags holds any of the roles, or all; matched lists which."""
    wanted = F.array(*(F.lit(r) for r in dict.fromkeys(roles)))
    found = assets.withColumn("matched", F.array_intersect(column, wanted))
    return found.where(F.size("matched") >= (len(set(roles)) if every else 1))
