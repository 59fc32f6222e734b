from pyspark.sql import functions as F

from tidemill.operators.latest import newest_per_key
from tidemill.streaming.events import first_seen, keep_newest, sessions, stream_of, windowed


def _events(spark, tmp_path, rows):
    spark.createDataFrame(rows, "event_id long, ts string, user_id long").select("event_id", F.to_timestamp_ntz("ts").alias("ts"), "user_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def _run(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_windows_sessions_and_late_rows(spark, tmp_path):
    path = _events(spark, tmp_path, [(1, "2024-01-01 10:00:00", 1), (2, "2024-01-01 10:10:00", 1), (3, "2024-01-01 15:00:00", 1)])
    schema = spark.read.parquet(path).schema
    stream = stream_of(spark, path, schema, files_per_trigger=1)
    batch = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(_run(windowed(stream, ["user_id"], "1 hour"), "complete", "w1")) == sorted(windowed(batch, ["user_id"], "1 hour").collect())
    assert [r.n for r in sorted(sessions(batch, ["user_id"], "30 minutes").collect())] == [2, 1]
    _events(spark, tmp_path, [(5, "2024-01-01 23:00:00", 1)])
    _events(spark, tmp_path, [(4, "2024-01-01 10:20:00", 1)])  # later than the watermark that the batch before last left
    kept = _run(windowed(stream_of(spark, path, schema, files_per_trigger=1), ["user_id"], "1 hour", late="1 hour"), "append", "w2")
    assert sum(r.n for r in kept if r.start.hour == 10) == 2
    assert sorted(r.n for r in _run(sessions(stream_of(spark, path, schema, files_per_trigger=1), ["user_id"], "30 minutes"), "append", "w4")) == [1, 2]  # 15:00 and the two rows of 10:00; the last is still open
    assert len(_run(first_seen(stream_of(spark, path, schema), ["user_id"]), "append", "w3")) == 1


def test_retention(spark, tmp_path):
    path = _events(spark, tmp_path, [(i, f"2024-01-01 10:{i:02d}:00", i % 2) for i in range(30)])
    _events(spark, tmp_path, [(i, f"2024-01-02 10:{i:02d}:00", i % 2) for i in range(30, 36)])
    schema = spark.read.parquet(path).schema
    keep_newest(stream_of(spark, path, schema, files_per_trigger=1), str(tmp_path / "out"), ["user_id"], "ts", "event_id", 4, str(tmp_path / "cp")).awaitTermination()
    import glob

    last = max(glob.glob(str(tmp_path / "out" / "batch=*")))
    want = newest_per_key(spark.read.parquet(path), ["user_id"], "ts", "event_id", 4)
    assert {r.event_id for r in spark.read.parquet(last).collect()} == {r.event_id for r in want.collect()}
