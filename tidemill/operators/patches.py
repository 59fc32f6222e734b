"""Unified diffs made, parsed, applied and reversed over tables of texts.

A text is an array of units, lines with their newline if they have one, so that 'no newline at end of file' needs no
special case and an applied diff gives the other text byte for byte. Texts meet hunks in one join by path; each
text is then folded over its hunks by array functions in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from tidemill.operators.batches import flat_map, give_back, slices
from tidemill.session import cut

NO_NEWLINE = "\\ No newline at end of file"
_UNIT = "[^\n]*\n|[^\n]+"
_HEADER = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")

HUNK = "path string, hunk int, old_start long, new_start long, old array<string>, new array<string>, lines array<string>, sound boolean, creates boolean, deletes boolean"


def units(text: Column) -> Column:
    """Lines with their newlines; none for null or empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_UNIT), F.lit(0))


def diff_of(path: str, before: str | None, after: str | None, context: int = 3) -> str:
    """The unified diff of two texts, '' for equal ones; a null text is a file that isn't there."""
    import difflib

    old, new = (re.findall(_UNIT, x or "") for x in (before, after))
    names = ("/dev/null" if x is None else f"{side}/{path}" for side, x in (("a", before), ("b", after)))
    return "".join(x if x.endswith("\n") else f"{x}\n{NO_NEWLINE}\n" for x in difflib.unified_diff(old, new, *names, n=context))


@F.arrow_udf(StringType())
def unified_diff(path: pa.Array, before: pa.Array, after: pa.Array) -> pa.Array:
    """The unified diff of two texts; Python in Arrow batches, a few rows of which are objects at a time, since no built-in function makes one."""
    parts = [pa.array([diff_of(*x) for x in zip(*(c.to_pylist() for c in some))], pa.string()) for some in zip(*map(slices, (path, before, after)))]
    give_back()
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def _path(name: str) -> str | None:
    name = name.split("\t")[0].strip()
    return None if name == "/dev/null" else re.sub(r"^[ab]/", "", name)


def parsed(patch: str | None) -> Iterator[tuple]:
    """HUNK rows of a patch. A hunk that ends early or has a line of no kind isn't sound; text around hunks is passed over."""
    old_path = new_path = None
    n, hunk, left = 0, None, (0, 0)

    def row(h: dict) -> tuple:
        path = new_path or old_path
        return path, h["n"], h["old_start"], h["new_start"], h["old"], h["new"], h["lines"], h["sound"] and left == (0, 0), old_path is None, new_path is None

    for line in re.findall(_UNIT, patch or ""):
        kind = line[0] if line != "\n" else " "
        if hunk and kind == "\\":
            last = hunk["lines"][-1:]
            hunk["lines"].append(line)
            for side, tags in (("old", " -"), ("new", " +")):
                if last and last[0][0] in tags and hunk[side]:
                    hunk[side][-1] = hunk[side][-1].removesuffix("\n")
        elif hunk and left != (0, 0):
            body = line[1:] if line != "\n" else line
            if kind not in " +-":
                hunk["sound"], left = False, (0, 0)
                continue
            hunk["lines"].append(kind + body)
            if kind in " -":
                hunk["old"].append(body)
            if kind in " +":
                hunk["new"].append(body)
            left = (left[0] - (kind in " -"), left[1] - (kind in " +"))
        else:
            found = _HEADER.match(line)
            if hunk and (found or line.startswith(("--- ", "diff "))):
                yield row(hunk)
                hunk = None
            if line.startswith("--- "):
                old_path, n = _path(line[4:]), 0
            elif line.startswith("+++ "):
                new_path = _path(line[4:])
            elif found:
                a, b, c, d = (int(x) if x else 1 for x in found.groups())
                hunk, left, n = {"n": n, "old_start": a, "new_start": c, "old": [], "new": [], "lines": [], "sound": True}, (b, d), n + 1
    if hunk:
        yield row(hunk)


def hunks(patches: DataFrame) -> DataFrame:
    """(edit_id, columns of HUNK): the hunks of patches (edit_id, patch), in order within each path."""
    rows = patches.select("edit_id", "patch")
    return flat_map(rows, lambda edit_id, patch: ((edit_id, *h) for h in parsed(patch)), f"edit_id {rows.schema['edit_id'].dataType.simpleString()}, {HUNK}")


def reversed_hunks(rows: DataFrame) -> DataFrame:
    """Hunks that undo those given."""
    turn = {"+": "-", "-": "+"}
    swap = F.transform("lines", lambda x: F.when(x.startswith("+"), F.concat(F.lit(turn["+"]), F.substring(x, 2, 1 << 30))).when(x.startswith("-"), F.concat(F.lit(turn["-"]), F.substring(x, 2, 1 << 30))).otherwise(x))
    other = {"old": "new", "new": "old", "old_start": "new_start", "new_start": "old_start", "creates": "deletes", "deletes": "creates"}
    return rows.select(*(swap.alias(c) if c == "lines" else F.col(other.get(c, c)).alias(c) for c in rows.columns))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _placed(have: Column, rows: Column) -> Column:
    """Where each hunk goes: an array of (at, hunk), at being null for those rejected.

    A hunk goes where its old lines stand: at the place that its header says, moved as the hunk before was, or else at the nearest
    place after that hunk (of two equally near the earlier).
    """
    n = F.size(have)

    def place(state: Column, h: Column) -> Column:
        size = F.size(h["old"])
        want = (h["old_start"] - F.when(size > 0, 1).otherwise(0)).cast("int") + state["shift"]
        same = lambda p: (have[p] == h["old"][0]) & (F.slice(have, p + 1, F.greatest(size, F.lit(1))) == h["old"])
        last = n - size
        near = F.array_min(F.transform(F.filter(F.sequence(state["end"], last), same), lambda p: F.struct(F.abs(p - want).alias("far"), p.alias("p"))))["p"]
        fits = (want >= state["end"]) & (want <= last)
        at = F.when(~h["sound"], None).when(size == 0, F.when(fits, want)).when(fits & same(want), want).when(last >= state["end"], near)
        step = lambda at: F.struct(
            F.when(at.isNull(), state["end"]).otherwise(at + size).cast("int").alias("end"),
            F.when(at.isNull(), state["shift"]).otherwise(state["shift"] + at - want).cast("int").alias("shift"),
            F.concat(state["placed"], F.array(F.struct(at.cast("int").alias("at"), h.alias("h")))).alias("placed"),
        )
        return _let(at, step)

    none = F.from_json(F.lit("[]"), f"array<struct<at: int, h: struct<{_fields()}>>>")
    return F.aggregate(rows, F.struct(F.lit(0).alias("end"), F.lit(0).alias("shift"), none.alias("placed")), place)["placed"]


_CARRIED = "hunk int, old_start long, new_start long, old array<string>, new array<string>, lines array<string>, sound boolean, creates boolean, deletes boolean"


def _fields() -> str:
    return _CARRIED.replace(" array", ": array").replace(" int", ": int").replace(" long", ": long").replace(" boolean", ": boolean")


def applied(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, text, state, placed, rejected): texts (path, text) after the hunks of one edit a path.

    state: kept (no hunk), patched, created, deleted, partly (some hunks rejected), rejected (all), missing (a hunk for a path that isn't
    there, all rejected). Rejected hunks leave their lines alone and are returned whole. A null text is an empty file. A path that several
    edits change belongs to applied_in_order().
    """
    own = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*(c.split()[0] for c in _CARRIED.split(", "))))).alias("_hunks"))
    both = texts.select("path", F.col("text").alias("_text"), F.lit(True).alias("_there")).join(own, "path", "full_outer")
    there, creates = F.coalesce("_there", F.lit(False)), F.exists("_hunks", lambda h: h["creates"])
    able = there | creates
    have = F.when(able, units(F.col("_text"))).otherwise(F.array().cast("array<string>"))
    steps = both.withColumn("_have", have).withColumn("_placed", F.when(F.col("_hunks").isNotNull() & able, _placed(F.col("_have"), F.col("_hunks"))).when(F.col("_hunks").isNotNull(), F.transform("_hunks", lambda h: F.struct(F.lit(None).cast("int").alias("at"), h.alias("h")))))
    good = F.filter("_placed", lambda p: p["at"].isNotNull())
    bad = F.transform(F.filter("_placed", lambda p: p["at"].isNull()), lambda p: p["h"])
    steps = steps.withColumn("_good", good).withColumn("rejected", F.coalesce(bad, F.from_json(F.lit("[]"), f"array<struct<{_fields()}>>")))
    end = lambda i: F.when(i == 0, 0).otherwise(F.get("_good", i - 1)["at"] + F.size(F.get("_good", i - 1)["h"]["old"]))
    parts = F.transform("_good", lambda p, i: F.concat(F.slice("_have", end(i) + 1, p["at"] - end(i)), p["h"]["new"]))
    rest = F.slice("_have", end(F.size("_good")) + 1, F.greatest(F.size("_have") - end(F.size("_good")), F.lit(0)))
    new = F.when(F.size("_good") > 0, F.concat(F.array_join(F.flatten(parts), ""), F.array_join(rest, ""))).otherwise(F.col("_text"))
    n_good, n_bad = F.coalesce(F.size("_good"), F.lit(0)), F.size("rejected")
    gone = F.exists("_hunks", lambda h: h["deletes"]) & (n_bad == 0) & (new == "")
    state = F.when(F.col("_hunks").isNull(), "kept").when(~able, "missing").when(n_good == 0, "rejected").when(n_bad > 0, "partly").when(gone, "deleted").when(~there, "created").otherwise("patched")
    return steps.select("path", F.when(~gone | F.col("_hunks").isNull(), new).alias("text"), state.alias("state"), F.greatest(n_good, F.lit(0)).alias("placed"), "rejected")


def standing(after: DataFrame) -> DataFrame:
    """The texts (path, text) that are there after applied()."""
    return after.where("state not in ('deleted', 'missing')").select("path", "text")


def rejects(after: DataFrame) -> DataFrame:
    """(path, text) of the '.rej' files that applied() leaves: each rejected hunk in unified form."""
    count = lambda h, c: F.size(h[c]).cast("string")
    head = lambda h: F.concat(F.lit("@@ -"), h["old_start"].cast("string"), F.lit(","), count(h, "old"), F.lit(" +"), h["new_start"].cast("string"), F.lit(","), count(h, "new"), F.lit(" @@\n"))
    body = F.array_join(F.transform("rejected", lambda h: F.concat(head(h), F.array_join(h["lines"], ""))), "")
    name = lambda side: F.concat(F.lit(side), F.col("path"), F.lit("\n"))
    return after.where(F.size("rejected") > 0).select(F.concat("path", F.lit(".rej")).alias("path"), F.concat(name("--- a/"), name("+++ b/"), body).alias("text"))


def applied_in_order(texts: DataFrame, rows: DataFrame, order: str = "edit_id") -> tuple[DataFrame, DataFrame]:
    """Texts after all edits of every path by ascending `order`, and the hunks rejected on the way (order, path, hunk).

    One round for the first edit of every path, one for the second, and so on; only paths that a round changes are joined, and each round is cut.
    """
    ranked = cut(rows.withColumn("_turn", F.dense_rank().over(Window.partitionBy("path").orderBy(order))))
    most = ranked.agg(F.max("_turn")).first()[0] or 0
    lost = None
    for turn in range(1, most + 1):
        now = ranked.where(F.col("_turn") == turn)
        mine = now.select("path", F.col(order)).distinct()
        step = cut(applied(texts.join(mine.select("path"), "path", "left_semi"), now.drop("_turn")))
        bad = step.select("path", F.explode("rejected.hunk").alias("hunk")).join(mine, "path").select(order, "path", "hunk")
        lost = bad if lost is None else lost.unionByName(bad)
        texts = cut(texts.join(mine.select("path"), "path", "left_anti").select("path", "text").unionByName(standing(step)))
    return texts, lost if lost is not None else rows.select(order, "path", "hunk").where("false")
