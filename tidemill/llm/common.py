"""Pieces that several operators share: staged tables, names, batches, words."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: ASCII white space, as a Java regular expression class and as Python characters.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\r\x0b\x0c"

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where unset (tests)."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = f"{tempfile.mkdtemp(prefix='tidemill-')}"
        spark.conf.set("spark.checkpoint.dir", place)
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    """Lets the JVM remove path when it ends, which it does with the driver, whether or not the session was stopped before."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(target)  # only what is there is listed for removal
    system.deleteOnExit(target)


def staged(df: DataFrame, tag: str, codec: str = "zstd", by: str | None = None, parts: int = 0, moved: bool = True) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage: the rows are the same however often they are read
    and whichever executors are lost later. Shuffle files of the write go at
    its end where Spark can do that; the table goes when the driver exits, after spark.stop() too and that of a failed write too.
    With a column by, the table is bucketed by it in that many parts, so that later groupings by it don't shuffle the table again;
    rows that lie together by that column already needn't be moved for it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _remove_at_exit(spark, path)
    before = spark.conf.get(_CLEAN, None)
    with contextlib.suppress(Exception):
        spark.conf.set(_CLEAN, "true")
    try:
        if by is None:
            df.write.mode("append").option("compression", codec).parquet(path)
        else:
            name = f"staged_{uuid.uuid4().hex}"
            (df.repartition(parts, by) if moved else df).write.bucketBy(parts, by).option("path", path).option("compression", codec).format("parquet").saveAsTable(name)
    finally:
        with contextlib.suppress(Exception):
            spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path) if by is None else spark.table(name)
    out.staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a staged table that nothing will read again."""
    _remove(df.sparkSession, df.staged_at)


def input_bytes(df: DataFrame) -> int:
    """The planner's estimate of df's size; it follows the input's files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, each: int = 32 << 20) -> int:
    """Partitions of about `each` bytes; never fewer than the session's shuffle partitions, which also serve where the planner can't tell the size."""
    size, least = input_bytes(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 60 else max(least, min(-(-size // each), 200_000))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def exact(docs: DataFrame) -> DataFrame:
    """docs with columns whose lower-case name another column has renamed, so that 'text' means that one alone."""
    names = docs.columns
    if len({c.lower() for c in names}) == len(names):
        return docs
    return docs.toDF(*(c if c == c.lower() else f"{c}__{i}" for i, c in enumerate(names)))


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns; whatever else documents carry is left behind. Of names that differ only in case the exact one counts."""
    docs = exact(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def give_back() -> None:
    """Returns memory that a Python worker no longer uses to the system; workers live on, and would keep what the largest batch took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, make: Callable[..., Callable[[Iterable[tuple]], Iterator[tuple]]], schema: str | StructType, *args, flush_bytes: int = 8 << 20) -> DataFrame:
    """mapInArrow over tuples: make(*args) runs once a task and gives a generator function over rows.

    Output leaves in batches of about flush_bytes, so a task holds one input
    batch and one output batch at a time.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        kept: list[tuple] = []
        size = 0
        for out in make(*args)(rows):
            kept.append(out)
            size += 32 + sum(len(x) for x in out if isinstance(x, (bytes, str, list)))
            if size >= flush_bytes or len(kept) >= 20_000:
                yield _batch(kept, arrow)
                kept, size = [], 0
        if kept:
            yield _batch(kept, arrow)
        kept = []
        give_back()

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
