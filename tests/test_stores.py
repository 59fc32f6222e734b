"""Ledgers with durable commits, capped stores with compaction, and entries kept over a stream."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import latest
from tidemill.sources import ledger_source as ls
from tidemill.streaming import entries as en
from tidemill.streaming.store import CappedStore


def _rows(spark, *rows):
    return spark.createDataFrame([(e, a, o, i) for i, (e, a, o) in enumerate(rows)], "edit_id string, action string, outcome string, seq long")


@pytest.fixture
def source(spark, tmp_path):
    ls.register(spark)
    path = str(tmp_path / "ledger")
    return lambda: spark.read.format(ls.NAME).option("path", path), lambda df: df.write.format(ls.NAME).option("path", path).mode("append").save(), tmp_path / "ledger"


def test_commits_are_whole(spark, source, monkeypatch):
    read, write, path = source
    synced = []
    real = os.fsync
    monkeypatch.setattr(os, "fsync", lambda f: (synced.append(f), real(f)))
    write(_rows(spark, ("e1", "apply", "commit"), ("e2", "apply", None)).repartition(2))
    write(_rows(spark, ("e1", "revert", "ok")))
    assert [(r.edit_id, r.action, r.commit) for r in read().load().orderBy("commit", "seq").collect()] == [("e1", "apply", 1), ("e2", "apply", 1), ("e1", "revert", 2)]
    # written but not committed: a crash between the two leaves nothing to read, and the next commit is not disturbed
    ledger = ls._Ledger({"path": str(path)})
    message = ledger.stage(iter([("lost", "apply", "ok", 9)]), ["edit_id", "action", "outcome", "seq"])
    assert (path / "data" / message.file).exists() and len(synced) == 2
    assert read().load().count() == 3
    # half a line in a file that a commit names doesn't become an entry
    ledger.commit([message])
    assert len(synced) == 6  # the file and its folder; the commit's file, its folder twice, the ledger's folder
    with (path / "data" / message.file).open("a") as f:
        f.write('{"edit_id": "half')
    assert {r.edit_id for r in read().load().collect()} == {"e1", "e2", "lost"}
    with pytest.raises(Exception, match="only added to"):
        _rows(spark, ("x", "y", "z")).write.format(ls.NAME).option("path", str(path)).mode("overwrite").save()


def test_two_writers_take_different_numbers(tmp_path):
    a, b = (ls._Ledger({"path": str(tmp_path / "l")}) for _ in range(2))
    a.commit([a.stage(iter([("a",)]), ["edit_id"])])
    seen = b.commits
    b.commits = lambda *x: []  # b looked before a committed
    b.commit([b.stage(iter([("b",)]), ["edit_id"])])
    b.commits = seen
    assert [n for n, _ in b.commits()] == [1, 2]


def test_failed_write_leaves_nothing(spark, source):
    read, write, path = source
    boom = F.udf(lambda i: 1 // (i - 2), "int")
    with pytest.raises(Exception, match="ZeroDivision|division"):
        write(_rows(spark, ("a", "x", None), ("b", "x", None), ("c", "x", None)).withColumn("outcome", boom("seq").cast("string")))
    assert read().load().count() == 0


def test_ranges_filters_and_broken_lines(spark, source, tmp_path):
    rng = random.Random(2)
    lines = [json.dumps({"edit_id": f"é{i}", "action": rng.choice(["apply", "revert"]), "seq": i, "artifacts": ["x"] * rng.randint(0, 5)}) if i % 11 else rng.choice(["{broken", "[1]", "", "  "]) for i in range(200)]
    file = tmp_path / "manifest.log.jsonl"
    file.write_text("\n".join(lines) + '\n{"edit_id": "torn')
    whole = [x for x in lines if x.strip()]
    for split in (40, 100, 1 << 20):
        found = spark.read.format(ls.NAME).option("path", str(file)).option("split_bytes", split).load()
        assert sorted(r.at for r in found.collect()) == sorted(len("\n".join(lines[:i]).encode()) + (i > 0) for i, x in enumerate(lines) if x.strip())
        assert found.where("broken is not null").count() == sum(not x.startswith('{"') for x in whole)
    some = found.where("action = 'revert' and seq > 50")
    assert {r.seq for r in some.collect()} == {json.loads(x)["seq"] for x in whole if x.startswith('{"') and json.loads(x)["action"] == "revert" and json.loads(x)["seq"] > 50}
    wanted = ls.Wanted()
    reader = ls._Reader(ls._Ledger({"path": str(file)}))
    assert list(reader.pushFilters([ls.EqualTo(("action",), "revert"), ls.EqualTo(("part",), 1), ls.GreaterThan(("seq",), 50)])) == [ls.EqualTo(("part",), 1)]
    assert all(wanted(x) for x in ({}, {"seq": 1}))


def test_stream_follows_commits_and_a_growing_file(spark, source, tmp_path):
    read, write, path = source
    file = tmp_path / "log.jsonl"
    file.write_text('{"edit_id": "a", "seq": 1}\n{"edit_id": "b", "se')
    write(_rows(spark, ("c1", "apply", None)))

    def run(at, name):
        q = spark.readStream.format(ls.NAME).option("path", str(at)).load().writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.edit_id for r in spark.read.parquet(str(tmp_path / f"{name}-out")).collect())

    assert run(file, "file") == ["a"] and run(path, "ledger") == ["c1"]
    with file.open("a") as f:
        f.write('q": 2}\n{"edit_id": "c"}\n')
    write(_rows(spark, ("c2", "apply", None), ("c3", "apply", None)))
    assert run(file, "file") == ["a", "b", "c"] and run(path, "ledger") == ["c1", "c2", "c3"]
    assert run(file, "file") == ["a", "b", "c"]


def test_stream_writer_takes_a_batch_once(tmp_path):
    ledger = ls._Ledger({"path": str(tmp_path / "l"), "name": "s"})
    w = ls._StreamWriter(ledger, ["edit_id"])
    for batch in (0, 1, 1):
        w.commit([w.write(iter([(f"b{batch}",)]))], batch)
    assert [(c["batch"], c["rows"]) for _, c in ledger.commits()] == [(0, 1), (1, 1)]
    assert len(list((tmp_path / "l" / "data").iterdir())) == 2


def test_capped_store_stays_bounded(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        store = CappedStore(spark, str(tmp_path / "s"), "k int, t long, id long", ["k"], "t", "id", keep=3, runs=4)
        assert store.read().count() == 0
        rng, rows, opened, most = random.Random(1), [], None, 0
        for batch in range(50):
            new = [(rng.randint(0, 2), rng.randint(0, 1000), batch * 10 + i) for i in range(5)]
            rows += new
            store.append(spark.createDataFrame(new, "k int, t long, id long").coalesce(1), batch)
            if batch % 10 == 5:
                store.append(spark.createDataFrame(new, "k int, t long, id long"), batch)  # repeated: nothing
            most = max(most, sum(1 for p in (tmp_path / "s").rglob("*.parquet")))
            if batch == 30:
                opened, want = store.read(), sorted(map(tuple, store.read().collect()))
            if batch == 31:
                assert sorted(map(tuple, opened.collect())) == want  # a reader keeps the version that it opened
        best = {k: sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], -r[2]))[:3] for k in range(3)}
        assert sorted(map(tuple, store.read().collect())) == sorted(r for x in best.values() for r in x)
        assert most <= 3 * 4 and len(list((tmp_path / "s" / "manifests").glob("*.json"))) <= 2
        (tmp_path / "s" / "runs" / "left-by-a-crash").mkdir()
        store.append(spark.createDataFrame([(9, 1, 1)], "k int, t long, id long"))
        assert not (tmp_path / "s" / "runs" / "left-by-a-crash").exists()
        number, _ = store._last()
        store._last = lambda: (number - 1, {"runs": [], "batches": []})
        with pytest.raises(RuntimeError, match="another writer"):
            store.append(spark.createDataFrame([(9, 1, 2)], "k int, t long, id long"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_last_entries_over_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rng = random.Random(7)
        rows = [(f"e{rng.randint(0, 12)}", f"2024-01-01 10:{i // 2 % 60:02d}:00", i, rng.choice(["apply", "revert", "note"]), rng.choice(["ok", "warn", None]), None) for i in range(120)]
        rows += [("never", "2024-01-01 10:00:00", 500, "apply", None, None), ("other", "2024-01-03 00:00:00", 501, "apply", "ok", None)]
        rng.shuffle(rows)
        rows = [r for r in rows if r[0] != "other"] + [("other", "2024-01-03 00:00:00", 501, "apply", "ok", None), ("late", "2024-01-01 09:00:00", 502, "revert", "ok", "reverse_patch"), ("e1", "2024-01-01 09:00:00", 503, "revert", "warn", "backup_restore")]
        schema = "edit_id string, ts string, seq long, action string, outcome string, revert_method string"
        frame = spark.createDataFrame(rows, schema).withColumn("at", F.to_timestamp("ts")).drop("ts")
        for i in range(0, len(rows), 45):
            part = frame.where(F.col("seq").isin([r[2] for r in rows[i : i + 45]]))
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        frame.where("edit_id = 'other'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # late rows are dropped by the watermark that the batch before last left
        too_late = spark.createDataFrame([("e2", "2024-01-01 09:00:00", 600, "revert", "ok", "reverse_patch")], schema).withColumn("at", F.to_timestamp("ts")).drop("ts")
        too_late.select(frame.columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        seen = []
        q = en.last_entries(stream, "2 hours", 3_600_000).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = en.holding(spark.createDataFrame(seen, en.OUT))
        names = ["seq", "action", "outcome", "revert_method"]
        want = {("last", *r) for r in map(tuple, latest.latest(frame, ["edit_id"], ["seq"], *names).collect())} | {("revert", *r) for r in map(tuple, latest.latest_where(frame, F.col("action") == "revert", ["edit_id"], ["seq"], *names).collect())}
        assert {(r.kind, r.edit_id, *(r[n] for n in names)) for r in got.where("kind <> 'unresolved'").collect()} == want
        assert "never" in {r.edit_id for r in got.where("kind = 'unresolved'").collect()}
        assert not {r.edit_id for r in got.where("kind = 'unresolved'").collect()} & {"late", "other"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
