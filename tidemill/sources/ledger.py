"""Append-only JSON-lines ledgers, checksum lists, run snapshots and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions.text import stamp_of

LEDGER = "edit_id string, action string, outcome string, revert_method string, artifacts array<string>, seq long, _corrupt_record string"
RESULT = "status string, files int, errors int, warns int"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Entries with their place, by which later ones are greater; a broken line has its text in _corrupt_record and nulls elsewhere.

    The place is an entry's seq, then its file's modification time and name, the part of the file, and the line's number
    within that part (a part is read from its start by one task). Entries without seq are so in the order of files and lines, before any with one.
    """
    at = ["_metadata.file_modification_time", "_metadata.file_name", "_metadata.file_block_start"]
    lines = spark.read.text(path).select("value", F.struct(*at, F.monotonically_increasing_id().alias("line")).alias("at")).where("trim(value) <> ''")
    entry = F.from_json("value", LEDGER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.select("at", entry.alias("e")).select("at", "e.*")
    return rows.select(F.struct(F.coalesce("seq", F.lit(-1)).alias("seq"), "at.*").alias("place"), *rows.columns[1:])


def append_ledger(entries: DataFrame, path: str) -> None:
    """Adds entries as JSON lines. Spark's commit makes them visible as a whole; it promises no fsync, which sources.ledger_source does."""
    entries.coalesce(1).write.mode("append").json(path)


def last_entry(ledger: DataFrame, action: str | None = None) -> DataFrame:
    """The last whole entry, or the last of one action, in one aggregate."""
    rows = ledger.where(F.col("_corrupt_record").isNull())
    rows = rows.where(F.col("action") == action) if action else rows
    names = ["edit_id", "action", "outcome", "revert_method"]
    return rows.agg(F.max_by(F.struct("place", *names), "place").alias("e")).where("e is not null").select("e.*")


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of 'digest  path' lines."""
    form = r"^([0-9a-f]{64})\s+\*?(.+)$"
    return spark.read.text(path).where(F.col("value").rlike(form)).select(F.regexp_extract("value", form, 2).alias("path"), F.regexp_extract("value", form, 1).alias("sha256"))


def file_sums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def read_results(lines: DataFrame) -> DataFrame:
    """Validation results (RESULT) among lines of validator output, 'VALIDATION_JSON: {...}' or a bare object; other lines are passed over.

    agrees says whether the nearest status line ('VALIDATION_STATUS: PASS') before it names the same status; null without one.
    """
    body = F.regexp_extract("line", r"^\s*(?:VALIDATION_JSON:)?\s*(\{.*)$", 1)
    said = F.nullif(F.regexp_extract("line", r"^\s*VALIDATION_STATUS:\s*(\w+)", 1), F.lit(""))
    before = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("said", F.last(said, ignorenulls=True).over(before)).where(body != "")
    out = rows.select("file", "pos", "said", F.from_json(body, RESULT).alias("r")).where("r.status in ('PASS', 'WARN', 'FAIL')")
    return out.select("file", "pos", "r.*", (F.col("said") == F.col("r.status")).alias("agrees"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(edit_id, path, sha256) of backup manifests, objects with edit_id and files of path and sha256: a file is one object, over any lines, or JSON lines."""
    form = "edit_id string, files array<struct<path: string, sha256: string>>"
    whole = spark.read.text(path, wholetext=True)
    one = F.from_json("value", form, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    many = F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, form))
    single = F.size(F.split(F.regexp_replace("value", r"(?s)\}\s*\n\s*\{.*", "}\n{"), r"\}\n\{")) == 1
    rows = whole.select(F.explode(F.when(single, F.array(one)).otherwise(many)).alias("r")).select("r.*")
    return rows.select("edit_id", F.explode("files").alias("f")).select("edit_id", "f.*")


def write_snapshot(rows: DataFrame, path: str) -> None:
    """Adds a run (with a run_date column) to the timeline."""
    rows.write.mode("append").partitionBy("run_date").parquet(path)


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of each tool's latest run: a join with one row a tool, so older partitions are read for two columns only."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("tool").agg(F.max("run_date").alias("run_date"))
    return rows.join(last, ["tool", "run_date"], "left_semi")


def notes(spark: SparkSession, path: str) -> DataFrame:
    """(file, description, stamp) of notes by their names; no content is read."""
    name = F.col("_metadata.file_name")
    files = spark.read.text(path, wholetext=True).select(name.alias("file"))
    return files.select("file", F.regexp_replace("file", r"[ _-]*\d{4}-\d{2}-\d{2}_\d{6}\.txt$|\.txt$", "").alias("description"), stamp_of(F.col("file")).alias("stamp"))


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
