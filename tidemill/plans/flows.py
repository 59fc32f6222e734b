"""Validation, session status, archive preview, update verification and the health suite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions.text import leftover_level, resolved, style
from tidemill.operators import compare, latest, rollup
from tidemill.sources import markdown

FINDING = "file string, check string, level string, message string"
#: Most entries shown of each list.
CAPS = {"goals": 5, "doing": 5, "next": 5, "decisions": 3, "causes": 5}


def _found(df: DataFrame, check: str, level: Column, message: Column) -> DataFrame:
    return df.select("file", F.lit(check).alias("check"), level.alias("level"), message.alias("message"))


def findings(texts: DataFrame, required: DataFrame, headings: DataFrame, limit: int = 120, strict: bool = False) -> DataFrame:
    """One row a finding: required files that are missing, required headings (file, heading) that a file lacks, style, leftovers (*.orig, *.rej)."""
    lines = texts.select("file", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    files = _found(compare.missing(required, texts, ["file"]), "files", F.lit("FAIL"), F.lit("missing"))
    have = lines.select("file", F.regexp_extract("line", r"^#+\s+(.*?)\s*$", 1).alias("heading")).where("heading <> ''")
    heads = _found(compare.missing(headings.join(texts.select("file"), "file", "left_semi"), have, ["file", "heading"]), "headers", F.lit("FAIL"), F.col("heading"))
    s = texts.select("file", style(F.col("text"), limit).alias("s"))
    styles = _found(s.where("s.long_lines > 0"), "style", F.lit("WARN"), F.lit("long lines")).unionByName(_found(s.where("s.tabs > 0"), "style", F.lit("WARN"), F.lit("tabs")))
    left = _found(texts.where(F.col("file").rlike(r"\.(orig|rej)$")), "leftovers", leftover_level(strict), F.lit("leftover"))
    return files.unionByName(heads).unionByName(styles).unionByName(left)


def schema_findings(texts: DataFrame, fields: list[str]) -> DataFrame:
    """The schema family: front matter fields that a file with front matter lacks, and files without any."""
    meta = markdown.front_matter(texts)
    lacking = F.filter(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    rows = meta.select("file", F.explode(F.when(F.col("found"), lacking).otherwise(F.array(F.lit("no front matter")))).alias("what"))
    return _found(rows, "schema", F.lit("WARN"), F.col("what"))


def coherence_findings(texts: DataFrame) -> DataFrame:
    """The coherence family (as read here): relative links '[..](path)' that lead, from their file's folder, to no file among the texts.

    The message is the path that was looked for. Links within a file, with a scheme or from the root aren't looked at; an anchor, a query or a title after the path is left out.
    """
    form = r"\]\(\s*<?(?![A-Za-z][A-Za-z0-9+.-]*:|[#/?])([^)#?\s>]+)"
    links = texts.select("file", F.explode(F.regexp_extract_all("text", F.lit(form), 1)).alias("link")).distinct()
    targets = links.select("file", resolved(F.col("file"), F.col("link")).alias("target")).distinct()
    known = texts.select(F.col("file").alias("target"))
    return _found(compare.missing(targets, known, ["target"]), "coherence", F.lit("WARN"), F.col("target"))


def all_findings(texts: DataFrame, required: DataFrame, headings: DataFrame, fields: list[str], limit: int = 120, strict: bool = False) -> DataFrame:
    """All five check families: files, headers, schema, style (and leftovers), coherence."""
    return findings(texts, required, headings, limit, strict).unionByName(schema_findings(texts, fields)).unionByName(coherence_findings(texts))


def validation(findings_: DataFrame, n_files: int) -> DataFrame:
    """The one-row result: status, files, errors, warns. No findings: PASS."""
    out = rollup.checks_rollup(findings_, [], F.col("level") == "FAIL", F.col("level") == "WARN")
    return out.select("status", F.lit(n_files).alias("files"), F.col("errors").cast("int").alias("errors"), F.col("warns").cast("int").alias("warns"))


def root_causes(findings_: DataFrame) -> DataFrame:
    return findings_.where(F.col("level").isin("WARN", "FAIL"))


def _first(rows: DataFrame, name: str, text: str, *order: Column) -> DataFrame:
    """The first rows of a list by an order, numbered by pos; the window is over those few rows."""
    top = rows.orderBy(*order).limit(CAPS[name])
    return top.select("file", F.lit(name).alias("list"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("pos"), F.col(text).alias("text"))


def session_status(lines: DataFrame, validator_lines: DataFrame, findings_: DataFrame | None = None) -> DataFrame:
    """(list, rank, text): goals, doing, next, latest decisions, root causes, and the validator's last two lines, capped.

    Decisions go by date, undated ones last, of equal dates the lower in the file first. Root causes are those of findings_, FAIL
    before WARN. A list without entries has one row, '(none)'.
    """
    lines = markdown.parted(lines)
    items = markdown.checklist(lines).select("file", F.lower("section").alias("list"), F.col("pos").cast("long").alias("pos"), "text").where("list in ('doing', 'next')")
    goals = markdown.bullets(lines).where(F.lower("section").contains("goal")).select("file", F.lit("goals").alias("list"), F.col("pos").cast("long").alias("pos"), "text")
    made = _first(markdown.decisions(lines), "decisions", "decision", F.desc_nulls_last("date"), F.desc("pos"), F.asc("file"))
    shown = latest.capped(items.unionByName(goals), CAPS, "list", "pos").unionByName(made)
    names = ["goals", "doing", "next", "decisions"]
    if findings_ is not None:
        names.append("causes")
        shown = shown.unionByName(_first(root_causes(findings_), "causes", "message", F.asc("level"), F.asc("file"), F.asc("check"), F.asc("message")))
    spine = lines.sparkSession.createDataFrame([(x,) for x in names], "list string")
    empty = spine.join(shown, "list", "left_anti").select(F.lit(None).cast("string").alias("file"), "list", F.lit(0).cast("long").alias("pos"), F.lit("(none)").alias("text"))
    shown = shown.unionByName(empty)
    ends = latest.last_lines(validator_lines, 2).select("file", F.lit("validator").alias("list"), F.col("pos").cast("long").alias("pos"), F.col("line").alias("text"))
    return shown.unionByName(ends)


def archive_preview(lines: DataFrame) -> DataFrame:
    """(kind, n, note): finished items, decisions and goals, zeros noted, nothing written."""
    spine = lines.sparkSession.createDataFrame([("done",), ("decisions",), ("goals",)], "kind string")
    lines = markdown.parted(lines)
    done = markdown.checklist(lines).where("checked").select(F.lit("done").alias("k"))
    made = markdown.decisions(lines).select(F.lit("decisions").alias("k"))
    goals = markdown.bullets(lines).where(F.lower("section").contains("goal")).select(F.lit("goals").alias("k"))
    n = rollup.counts_with_zeros(spine, done.unionByName(made).unionByName(goals), "kind", "k")
    return n.withColumn("note", F.when(F.col("n") == 0, "none, which is no failure"))


def update_outcome(findings_: DataFrame, n_files: int, leftovers: DataFrame, sums: DataFrame) -> DataFrame:
    """commit or roll_back: roll back if validation fails, leftovers exist or a checksum differs (sums as of compare.verified)."""
    bad = sums.where("state <> 'ok'").agg(F.count("*").alias("bad_sums")).crossJoin(leftovers.agg(F.count("*").alias("leftovers")))  # one row each
    out = validation(findings_, n_files).crossJoin(bad)
    return out.withColumn("outcome", F.when((F.col("status") == "FAIL") | (F.col("bad_sums") > 0) | (F.col("leftovers") > 0), "roll_back").otherwise("commit"))


def change_review(changes: DataFrame) -> DataFrame:
    """(kind, file, n) of a change set (kind, file, line)."""
    return rollup.counts(changes, "kind", "file")


def health_suite(spark: SparkSession, **tools: DataFrame) -> DataFrame:
    """Tool outputs (path, metric, value) in one frame, with each tool's and metric's summary as rows of path null."""
    every = rollup.suite(**tools)
    total = rollup.summary(every, ["tool", "metric"], "value").select("tool", F.lit(None).cast("string").alias("path"), "metric", F.col("total").alias("value"))
    return every.unionByName(total)
