"""Updates of a table of texts by patches: backup, apply, validate, commit or roll back; and revert with a fallback."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import patches as pt
from tidemill.session import cut

#: Rows that updates add to a ledger.
ENTRY = "edit_id string, action string, outcome string, revert_method string, artifacts array<string>"


class Update(NamedTuple):
    """texts (path, text) afterwards, backups (edit_id, path, text, sha256) taken before, and ledger rows of ENTRY."""

    texts: DataFrame
    backups: DataFrame
    ledger: DataFrame


def _digest(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _entries(edits: DataFrame, action: str) -> DataFrame:
    return edits.select("edit_id", F.lit(action).alias("action"), "outcome", F.col("revert_method").cast("string").alias("revert_method"), "artifacts")


def _files(paths) -> F.Column:
    return F.array_sort(F.collect_set(paths))


def apply_update(texts: DataFrame, patches: DataFrame, check: Callable[[DataFrame], DataFrame] | None = None) -> Update:
    """Applies patches (edit_id, patch), at most one edit a path; check(texts) gives findings (file, level, ...).

    An edit as a whole commits if none of its hunks is rejected and no file of it has a FAIL finding afterwards; else it rolls back:
    all its files keep their text, and its artifacts name the '.rej' files. One whose patch has no hunk is 'ok' and changes nothing. Backups
    hold every file of every edit as it was (a file not there before has a null text and digest).
    """
    rows = cut(pt.hunks(patches))
    owner = rows.select("edit_id", "path").distinct()
    mine = owner.select("path").distinct()
    before = texts.select("path", "text").join(mine, "path", "left_semi")
    after = cut(pt.applied(before, rows))
    bad = after.where(F.size("rejected") > 0).select("path", F.concat("path", F.lit(".rej")).alias("_rej"))
    if check is not None:
        failed = check(pt.standing(after).select(F.col("path").alias("file"), "text")).where("level = 'FAIL'").select(F.col("file").alias("path"), F.lit(True).alias("_failed")).distinct()
    else:
        failed = mine.where("false").withColumn("_failed", F.lit(True))
    by_file = owner.join(bad, "path", "left").join(failed, "path", "left")
    verdict = by_file.groupBy("edit_id").agg(F.max(F.col("_rej").isNotNull() | F.coalesce("_failed", F.lit(False))).alias("_bad"), _files("_rej").alias("artifacts"))
    edits = patches.select("edit_id").distinct().join(verdict, "edit_id", "left")
    outcome = F.when(F.col("_bad").isNull(), "ok").when(F.col("_bad"), "roll_back").otherwise("commit")
    edits = cut(edits.select("edit_id", outcome.alias("outcome"), F.lit(None).alias("revert_method"), F.coalesce("artifacts", F.array().cast("array<string>")).alias("artifacts")))
    committed = owner.join(edits.where("outcome = 'commit'").select("edit_id"), "edit_id", "left_semi").select("path")
    out = texts.select("path", "text").join(committed, "path", "left_anti").unionByName(pt.standing(after).join(committed, "path", "left_semi"))
    held = owner.join(before.withColumn("_there", F.lit(True)), "path", "left")
    backups = held.select("edit_id", "path", F.when(F.col("_there"), F.coalesce("text", F.lit(""))).alias("text"), F.when(F.col("_there"), _digest(F.col("text"))).alias("sha256"))
    return Update(out, backups, _entries(edits, "apply"))


def revert(texts: DataFrame, patches: DataFrame, backups: DataFrame) -> Update:
    """Undoes edits (edit_id, patch), at most one a path, with backups (edit_id, path, text, sha256) to hold the results against.

    An edit is undone by its reversed hunks if all of them fit and every file then has the digest that its backup lists
    (outcome ok, reverse_patch); else from its backup, if every backup text has its own digest (outcome warn, backup_restore); else its
    files stay as they are (outcome fail, no method). Artifacts name the '.rej' files of a reverse patch that didn't fit. The digest null
    stands for a file that wasn't there before the edit; to undo that is to remove it.
    """
    rows = cut(pt.hunks(patches))
    owner = rows.select("edit_id", "path").distinct()
    mine = owner.select("path").distinct()
    here = texts.select("path", "text")
    back = cut(pt.applied(here.join(mine, "path", "left_semi"), pt.reversed_hunks(rows)))
    kept = backups.select("edit_id", "path", F.col("text").alias("_backup"), F.col("sha256").alias("_sum"), F.lit(True).alias("_listed"))
    by_file = owner.join(back, "path").join(kept, ["edit_id", "path"], "left")
    there = ~F.col("state").isin("deleted", "missing")
    fits = (F.size("rejected") == 0) & F.coalesce("_listed", F.lit(False)) & F.when(there, _digest(F.col("text"))).eqNullSafe(F.col("_sum"))
    sound = F.coalesce("_listed", F.lit(False)) & F.when(F.col("_backup").isNotNull(), _digest(F.col("_backup"))).eqNullSafe(F.col("_sum"))
    by_file = cut(by_file.select("edit_id", "path", "text", there.alias("_there"), "_backup", fits.alias("_fits"), sound.alias("_sound"), F.when(F.size("rejected") > 0, F.concat("path", F.lit(".rej"))).alias("_rej")))
    edits = by_file.groupBy("edit_id").agg(F.min("_fits").alias("_fits"), F.min("_sound").alias("_sound"), _files("_rej").alias("artifacts"))
    method = F.when(F.col("_fits"), "reverse_patch").when(F.col("_sound"), "backup_restore")
    outcome = F.when(F.col("_fits"), "ok").when(F.col("_sound"), "warn").otherwise("fail")
    edits = cut(edits.select("edit_id", outcome.alias("outcome"), method.alias("revert_method"), "artifacts"))
    changed = by_file.join(edits.where("outcome <> 'fail'").select("edit_id", "revert_method"), "edit_id")
    undone = changed.select("path", F.when(F.col("revert_method") == "reverse_patch", F.when(F.col("_there"), F.coalesce("text", F.lit("")))).otherwise(F.col("_backup")).alias("text"))
    out = here.join(undone.select("path"), "path", "left_anti").unionByName(undone.where("text is not null"))
    return Update(out, backups, _entries(edits, "revert"))
