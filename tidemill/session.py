"""Session defaults, tables by name, and cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tidemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; conf overrides."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows of a task whose memory follows its rows (sorts, hash maps), so that more input makes more tasks and not larger ones.
ROWS = 1 << 18


def tasks_for(df: DataFrame, rows: int = ROWS) -> int:
    """Partitions of about `rows` rows of df; counts them."""
    return df.count() // rows + 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in a local session where it is unset (tests)."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", place)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its rows in the checkpoint folder, so that loops neither recompute rounds nor let plans grow."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
