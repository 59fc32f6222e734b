"""Markdown files as rows. Line order is carried as pos; partition order is never relied on."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.operators.batches import flat_map
from tidemill.session import cut, tasks_for

#: Lines of a part of a file whose lines are read in order.
ROWS = 1 << 18

FRONT_MATTER = "title string, audience array<string>, owners array<string>, status string, version string, updated date, summary string, tags array<string>, legacy_source string"
_FIELDS = f"{FRONT_MATTER}, found boolean"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text), one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line)."""
    return read_texts(spark, path).select("file", F.posexplode(F.split("text", "\r?\n", -1)).alias("pos", "line"))


def placeholder(text: Column) -> Column:
    """Whether an entry is a template's stand-in; such rows are kept and flagged."""
    return text.rlike(r"(?i)^(\[.*\]|<.*>|tbd|todo|none|n/a|\.\.\.|placeholder.*|your .* here)$")


def parted(lines: DataFrame) -> DataFrame:
    """Lines with _part, the number of one of as many ranges of (file, pos) as ROWS asks for; a long file lies in several, whose order is the lines'."""
    if "_part" in lines.columns:
        return lines
    ranged = lines.repartitionByRange(tasks_for(lines, ROWS), "file", "pos")
    return cut(ranged.withColumn("_part", F.spark_partition_id()))


def _handed_on(rows: DataFrame, what: Column, over: Column, name: str) -> DataFrame:
    """rows with `name`: `over`, a window column over the other parts of the file, of `what`, an aggregate of each part (as _x). Null for a file of one part.

    Only files of several parts are handed on: two a part at most, so their rows are broadcast.
    """
    each = rows.groupBy("file", "_part").agg(what.alias("_x")).withColumn("_spans", F.count("*").over(Window.partitionBy("file"))).where("_spans > 1")
    found = each.select(F.col("file").alias("_file"), F.col("_part").alias("_at"), over.alias(name))
    return rows.join(F.broadcast(found), F.col("file").eqNullSafe(F.col("_file")) & (F.col("_part") == F.col("_at")), "left").drop("_file", "_at")


def _sectioned(lines: DataFrame) -> DataFrame:
    above = Window.partitionBy("file", "_part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    rows = parted(lines).withColumn("_fence", F.col("line").rlike(r"^ {0,3}(```|~~~)"))
    rows = _handed_on(rows, F.count_if("_fence"), F.sum("_x").over(before), "_open")
    marked = rows.withColumn("_fences", F.count_if("_fence").over(above) + F.coalesce("_open", F.lit(0)))
    marked = marked.withColumn("code", F.col("_fence") | (F.col("_fences") % 2 == 1)).drop("_fence", "_fences", "_open")
    marked = marked.withColumn("heading", F.when(~F.col("code"), F.nullif(F.regexp_extract("line", r"^#{2,6}\s+(.*?)\s*$", 1), F.lit(""))))
    at = F.when(F.col("heading").isNotNull(), F.col("pos"))
    marked = _handed_on(marked, F.max_by("heading", at), F.last("_x", ignorenulls=True).over(before), "_under")
    return marked.withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(above), F.col("_under"))).drop("_under")


def sectioned(lines: DataFrame) -> DataFrame:
    """Lines with the second-level (or deeper) heading that they stand under (null before the first), and whether they are code between fences.

    A line of three or more backticks or tildes opens or ends code; see blocks() for fences within fences. A file's lines are shared by
    tasks (parted()): each part is told how many fences and which heading came before it.
    """
    return _sectioned(lines).drop("_part")


def checklist(lines: DataFrame) -> DataFrame:
    """(file, section, pos, checked, text, is_placeholder) of '- [x]' and '- [ ]' items outside code."""
    item = r"^\s*[-*]\s+\[([ xX])\]\s*(.*?)\s*$"
    out = sectioned(lines).where(F.col("line").rlike(item) & ~F.col("code")).select("file", "section", "pos", (F.lower(F.regexp_extract("line", item, 1)) == "x").alias("checked"), F.regexp_extract("line", item, 2).alias("text"))
    return out.withColumn("is_placeholder", placeholder(F.col("text")))


def bullets(lines: DataFrame) -> DataFrame:
    """(file, section, pos, text, is_placeholder) of plain bullets under headings, outside code; those above any heading have a null section."""
    item = r"^\s*[-*]\s+(?!\[[ xX]\])(.*?)\s*$"
    out = sectioned(lines).where(F.col("line").rlike(item) & ~F.col("code")).select("file", "section", "pos", F.regexp_extract("line", item, 1).alias("text"))
    return out.withColumn("is_placeholder", placeholder(F.col("text")))


def pipe_rows(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of pipe tables outside code that have as many cells as columns, without header and rule rows. A row's header is the row before a rule; '\\|' is a bar within a cell."""
    rule = F.col("line").rlike(r"^\s*\|?(\s*:?-{3,}:?\s*\|)+\s*(:?-{3,}:?)?\s*$")
    inner = F.regexp_replace(F.trim("line"), r"^\||(?<!\\)\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.regexp_replace(F.trim(c), r"\\\|", "|"))
    rows = _sectioned(lines).withColumn("_rule", F.coalesce(rule & ~F.col("code"), F.lit(False)))
    rows = _handed_on(rows, F.min_by("_rule", "pos"), F.lead("_x").over(Window.partitionBy("file").orderBy("_part")), "_next")
    rows = rows.withColumn("_header", F.coalesce(F.lead("_rule").over(Window.partitionBy("file", "_part").orderBy("pos")), "_next", F.lit(False)))
    rows = rows.where(F.col("line").rlike(r"^\s*\|.*\|\s*$") & ~F.col("_rule") & ~F.col("_header") & ~F.col("code")).withColumn("_cells", cells).where(F.size("_cells") == len(columns))
    return rows.select("file", "pos", *(F.col("_cells")[i].alias(c) for i, c in enumerate(columns)))


def decisions(lines: DataFrame) -> DataFrame:
    """(file, pos, date, decision, rationale); bullets outside the table aren't decisions."""
    return pipe_rows(lines, ["date", "decision", "rationale"]).withColumn("date", F.col("date").try_cast("date"))


def catalogue(lines: DataFrame) -> DataFrame:
    """(key, description, body, kind): each key of the index table with the text under its heading; a key without one has a null body."""
    index = pipe_rows(lines, ["key", "description"]).withColumn("key", F.regexp_replace("key", "`", ""))
    under = sectioned(lines).where("section is not null and heading is null").groupBy("file", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    under = under.select("file", F.regexp_replace("section", "`", "").alias("key"), F.regexp_replace("body", r"^\s+|\s+$", "").alias("body"))
    return index.join(under, ["file", "key"], "left").select("key", "description", "body", F.when(F.col("key").startswith("bundle_"), "bundle").otherwise("atomic").alias("kind"))


def pick(catalogue_rows: DataFrame, key: str) -> DataFrame:
    return catalogue_rows.where(F.col("key") == key)


def parse_front_matter(text: str | None) -> dict | None:
    """The YAML block at a text's start as a dict, or None."""
    import yaml

    text = (text or "").replace("\r\n", "\n")
    if not text.startswith("---\n") or "\n---" not in text[3:]:
        return None
    try:
        found = yaml.safe_load(text[4 : max(4, text.index("\n---", 3))]) or {}
    except yaml.YAMLError:
        return None
    if not isinstance(found, dict):
        return None
    out: dict = {"found": True}
    for field in ("audience", "owners", "tags"):
        x = found.get(field)
        out[field] = None if x is None else [str(y) for y in (x if isinstance(x, list) else [x])]
    for field in ("title", "status", "version", "summary", "legacy_source"):
        out[field] = None if found.get(field) is None else str(found[field]).strip()
    import datetime

    day = found.get("updated")
    out["updated"] = day if isinstance(day, datetime.date) else None
    return out


def front_matter(texts: DataFrame) -> DataFrame:
    """(file, columns of FRONT_MATTER, found): nulls, and found false, where a file has no such block."""
    parse = F.udf(parse_front_matter, _FIELDS, useArrow=True)
    return texts.select("file", parse("text").alias("m")).select("file", "m.*").withColumn("found", F.coalesce("found", F.lit(False)))


def yaml_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An authoritative YAML list of records as rows, or several such files; a file is small and read whole."""

    def parse(text: str) -> list:
        import yaml

        found = yaml.safe_load(text) or []
        return found if isinstance(found, list) else [found]

    return read_texts(spark, path).select(F.explode(F.udf(parse, f"array<struct<{schema}>>", useArrow=True)("text")).alias("r")).select("r.*")


def domain_view(index: DataFrame, column: str, domain: str) -> str:
    """Makes a temporary view of one domain's rows of an index, named index_<domain>; returns its name."""
    import re

    name = "index_" + re.sub(r"\W+", "_", domain).lower()
    index.where(F.col(column) == domain).createOrReplaceTempView(name)
    return name


def to_yaml(rows: DataFrame) -> DataFrame:
    """One YAML document a row (file, value), made at the edge."""

    def dump(text: str) -> str:
        import json

        import yaml

        return yaml.safe_dump(json.loads(text), sort_keys=True, allow_unicode=True)

    return rows.select(F.udf(dump, "string", useArrow=True)(F.to_json(F.struct(*rows.columns))).alias("value"))


BLOCK = "pos int, kind string, level int, section string, text string, checked boolean, cells array<string>, header array<string>"


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_HEADING = re.compile(r"(#{1,6})\s+(.*?)(?:\s+#+)?\s*$")
_ITEM = re.compile(r"\s*[-*]\s+\[([ xX])\]\s*(.*?)\s*$")
_BULLET = re.compile(r"\s*[-*]\s+(.*?)\s*$")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)\s*$")
_BREAK = re.compile(r" {0,3}([-*_]\s*){3,}$")


def parsed_blocks(text: str | None) -> Iterator[tuple]:
    """Rows of BLOCK for a text, in one pass over its lines; a line is matched only against what its characters allow.

    kind: front, heading, item, bullet, header, row, code or text; blank lines, rules and fences give none. A fence is ended by one of the
    same character that is at least as long. A heading may be underlined. A table begins with a header over a rule and ends with a line without
    bars. section is the nearest heading above of level 2 to 6.
    """
    lines = (text or "").replace("\r\n", "\n").split("\n")
    fence, section, header, i = None, None, None, 0
    if lines[0] == "---" and "---" in lines[1:]:
        end = lines.index("---", 1)
        yield from ((p, "front", None, None, lines[p], None, None, None) for p in range(1, end))
        i = end + 1
    while i < len(lines):
        line, pos = lines[i], i
        after = lines[i + 1] if i + 1 < len(lines) else ""
        i += 1
        mark = _FENCE.match(line) if "```" in line or "~~~" in line else None
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
                fence = None
            else:
                yield pos, "code", None, section, line, None, None, None
            continue
        if mark:
            fence, header = mark[1], None
            continue
        if header and "|" not in line:
            header = None
        if header:
            yield pos, "row", None, section, line, None, _cells(line), header
        elif "|" in line and "-" in after and _RULE.match(after):
            header = _cells(line)
            yield pos, "header", None, section, line, None, header, None
            i += 1
        elif not (bare := line.lstrip()):
            continue
        elif line[0] == "#" and (found := _HEADING.match(line)):
            level = len(found[1])
            section = found[2] if level > 1 else section
            yield pos, "heading", level, section, found[2], None, None, None
        elif bare[0] in "-*" and (found := _ITEM.match(line)):
            yield pos, "item", None, section, found[2], found[1] in "xX", None, None
        elif bare[0] in "-*" and (found := _BULLET.match(line)):
            if found[1].strip("-* "):
                yield pos, "bullet", None, section, found[1], None, None, None
        else:
            ruled = bare[0] in "-*_" and _BREAK.match(line)
            if not ruled and after.lstrip(" ")[:1] in ("=", "-") and _UNDERLINE.match(after):
                level = 1 if "=" in after else 2
                section = line.strip() if level > 1 else section
                yield pos, "heading", level, section, line.strip(), None, None, None
                i += 1
            elif not ruled:
                yield pos, "text", None, section, line, None, None, None


_ENDS, _BAR = re.compile(r"^\||(?<!\\)\|$"), re.compile(r"(?<!\\)\|")
_RULE = re.compile(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def _cells(line: str) -> list[str]:
    inner = line.strip()
    if "\\" not in inner:
        return [c.strip() for c in inner.removeprefix("|").removesuffix("|").split("|")]
    return [c.strip().replace("\\|", "|") for c in _BAR.split(_ENDS.sub("", inner))]


def blocks(texts: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """(file, columns of BLOCK) of texts (file, text): every kind of record, or those of `kinds`, from one pass, without a shuffle; a null text has none."""
    wanted = None if kinds is None else frozenset(kinds)
    return flat_map(texts.select("file", "text"), lambda file, text: ((file, *b) for b in parsed_blocks(text) if wanted is None or b[1] in wanted), f"file string, {BLOCK}")


def block_items(rows: DataFrame) -> DataFrame:
    """checklist() from blocks."""
    return rows.where("kind = 'item'").select("file", "section", "pos", "checked", "text", placeholder(F.col("text")).alias("is_placeholder"))


def block_bullets(rows: DataFrame) -> DataFrame:
    """bullets() from blocks."""
    return rows.where("kind = 'bullet'").select("file", "section", "pos", "text", placeholder(F.col("text")).alias("is_placeholder"))


def block_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(file, pos, columns): rows of the tables whose header names those columns, in any case and order; a row that is short has nulls at its end."""
    at = lambda c: F.array_position(F.transform("header", lambda h: F.lower(h)), c.lower()).cast("int")
    mine = rows.where("kind = 'row'").where(F.least(*(at(c) for c in columns), F.lit(1)) > 0)
    return mine.select("file", "pos", *(F.get("cells", at(c) - 1).alias(c) for c in columns))
