"""As-of and interval joins against plain loops; timelines, sketches and cubes."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import sketches, temporal, timeline
from tidemill.operators.cubes import cube_distinct


def plan_of(df):
    return df._jdf.queryExecution().toString()


def _asof(left, right, strict, within):
    out = []
    for k, t, x in left:
        fits = [r for r in right if None not in (k, t, r[0], r[1]) and r[0] == k and (r[1] < t if strict else r[1] <= t)]
        best = max(fits, key=lambda r: (r[1], r[2]), default=None)
        out.append((k, t, x, best[2] if best and (within is None or t - best[1] <= within) else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("strict", "within", "width"), [(False, None, 10), (True, None, 3), (False, 7, 1000), (True, 5, 1)])
def test_asof(spark, strict, within, width):
    rng = random.Random(width)
    hot = lambda: None if rng.random() < 0.03 else 0 if rng.random() < 0.9 else rng.randint(1, 4)
    when = lambda: None if rng.random() < 0.03 else rng.randint(-50, 200)
    left = [(hot(), when(), i) for i in range(300)] + [(9, 5, 1000), (9, 5, 1000)]
    right = [(hot(), when(), i) for i in range(150)]
    a, b = spark.createDataFrame(left, "k long, t long, x long"), spark.createDataFrame(right, "k long, at long, y long")
    got = temporal.asof_join(a, b, ["k"], "t", "at", {"y": "last"}, "y", width, strict, within)
    assert got.columns == ["k", "t", "x", "last"]
    assert sorted(map(tuple, got.collect()), key=str) == _asof(left, right, strict, within)
    inner = temporal.asof_join(a, b, ["k"], "t", "at", {"y": "last"}, "y", width, strict, within, how="inner")
    assert inner.count() == sum(r[3] is not None for r in _asof(left, right, strict, within))
    assert temporal.asof_join(a, b.where("false"), ["k"], "t", "at", {"y": "last"}, "y", width).where("last is not null").count() == 0
    plan = plan_of(got)
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_campaigns_meet_days_not_orders(spark, tmp_path):
    from tidemill.catalog import QUERIES

    spark.range(40).selectExpr("id as p_partkey", "cast(8 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(5000).selectExpr("cast(0.01 + id as decimal(15,2)) as o_totalprice", "date'1995-01-20' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["orders_in_campaigns"](spark, str(tmp_path))
    rows = {tuple(r) for r in got.collect()}
    assert rows == {(p, 5000, 12497550.0) for p in range(11, 20)}
    plan = plan_of(got).split("Physical Plan")[1]
    assert plan.index("Join") < plan.index("partial_count")  # orders are counted by day below the join


def test_asof_splits_a_hot_key(spark):
    """No window holds more rows than one bucket of the key."""
    left = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    right = spark.range(0, 5000, 50).select(F.lit(1).alias("k"), F.col("id").alias("at"))
    got = temporal.asof_join(left, right, ["k"], "t", "at", {"at": "last"}, "at", 100)
    assert got.where("last = t - t % 50").count() == 5000
    assert "hashpartitioning(k#" in plan_of(got) and ", _b#" in plan_of(got)


def test_overlaps(spark):
    rng = random.Random(1)
    some = lambda n: [(rng.randint(0, 2) if rng.random() > 0.05 else None, (s := rng.randint(-300, 300)) if rng.random() > 0.05 else None, s + rng.choice([0, 0, 1, 3, 10, 40, 200, 555, -1]), i) for i in range(n)]
    a, b = some(120), some(90)
    left, right = spark.createDataFrame(a, "k int, s long, e long, x int"), spark.createDataFrame(b, "k int, s2 long, e2 long, y int")
    over = lambda p, q: None not in (p[1], q[1]) and p[1] <= p[2] and q[1] <= q[2] and p[1] <= q[2] and q[1] <= p[2]
    for base in (1, 16):
        keyed = temporal.overlap_join(left, right, ["k"], ("s", "e"), ("s2", "e2"), base)
        assert sorted((r.x, r.y) for r in keyed.collect()) == sorted((p[3], q[3]) for p in a for q in b if p[0] == q[0] is not None and over(p, q))
        free = temporal.overlap_join(left, right.withColumnRenamed("k", "k2"), [], ("s", "e"), ("s2", "e2"), base)
        assert sorted((r.x, r.y) for r in free.collect()) == sorted((p[3], q[3]) for p in a for q in b if over(p, q))
        assert "NestedLoop" not in plan_of(free) and "Cartesian" not in plan_of(free)
    assert temporal.overlap_join(left.where("false"), right, ["k"], ("s", "e"), ("s2", "e2")).count() == 0
    dates = spark.sql("select date'2024-01-01' as s, date'2024-01-05' as e"), spark.sql("select timestamp'2024-01-03 00:00:00' as t")
    assert temporal.overlap_join(dates[0].selectExpr("timestamp(s) as s", "timestamp(e) as e"), dates[1], [], ("s", "e"), ("t", "t"), 3_600_000_000).count() == 1
    with pytest.raises(TypeError):
        temporal.number(left.select(F.col("k").cast("string").alias("k")), "k")


def _intervals(runs):
    """{(key, value, from, to)} of a list of (run, {key: value}) by a plain loop."""
    out, open_ = set(), {}
    for run, rows in runs:
        for k in list(open_):
            if k not in rows or rows[k] != open_[k][0]:
                v, since = open_.pop(k)
                out.add((k, v, since, run))
        for k, v in rows.items():
            open_.setdefault(k, (v, run))
    return out | {(k, v, since, None) for k, (v, since) in open_.items()}


def _files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_timeline(spark, tmp_path):
    rng = random.Random(5)
    runs, now = [], {k: rng.randint(0, 2) for k in range(40)}
    for d in range(5):
        for k in rng.sample(range(45), 6):
            now[k] = None if rng.random() < 0.2 else rng.randint(0, 2)
        for k in rng.sample(sorted(now), 3):
            now.pop(k)
        runs.append((f"2024-01-{d + 1:02d}", dict(now)))
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "k long, v long")
    every = spark.createDataFrame([(k, run, v) for run, rows in runs for k, v in rows.items()], "k long, run string, v long")
    got = timeline.intervals(every, ["k"], "run", "v")
    assert {(r.k, r.v, r.valid_from, r.valid_to) for r in got.collect()} == _intervals(runs)

    t = timeline.Timeline(spark, str(tmp_path / "t"), ["k"], "v", buckets=16)
    text = lambda x: None if x is None else str(x)
    for run, rows in runs:
        t.merge(frame(rows), run)
    have = lambda: {(r.k, r.v, text(r.valid_from), text(r.valid_to)) for r in t.read().collect()}
    assert have() == _intervals(runs)
    before = _files(tmp_path / "t")
    t.merge(frame(runs[-1][1]), runs[-1][0])  # the same run again
    assert have() == _intervals(runs)
    after = _files(tmp_path / "t")
    assert {p for p in before if after.get(p) != before[p]} <= {p for p in before if f"valid_to={runs[-1][0]}" in p}
    changed = dict(runs[-1][1])
    changed[next(iter(changed))] = 77
    assert t.merge(frame(changed), runs[-1][0]) <= 1  # another last run: one key's bucket
    assert have() == _intervals([*runs[:-1], (runs[-1][0], changed)])
    assert {(r.k, r.v) for r in t.at(runs[2][0]).collect()} == set(runs[2][1].items())
    with pytest.raises(ValueError):
        t.merge(frame(runs[0][1]), runs[0][0])
    last = dict(list(changed.items())[:1])
    t.merge(frame(last), "2024-01-09")  # most keys go
    assert have() == _intervals([*runs[:-1], (runs[-1][0], changed), ("2024-01-09", last)])


def test_sketches(spark, tmp_path):
    day = lambda d: spark.range(d * 1000, d * 1000 + 3000).select((F.col("id") % 2).alias("k"), F.col("id").alias("user"), (F.col("id") % 1000).alias("v"))
    for d in range(4):
        sketches.store_run(sketches.run_sketches(day(d), ["k"], "user", "v"), str(tmp_path / "s"), d)
    sketches.store_run(sketches.run_sketches(day(1), ["k"], "user", "v"), str(tmp_path / "s"), 1)
    kept = sketches.stored(spark, str(tmp_path / "s"))
    rows = sketches.merged(kept, ["k"]).select("k", "n", "total", sketches.distinct("ids").alias("d"), sketches.quantile("spread", 0.5).alias("q")).collect()
    assert len(rows) == 2
    for r in rows:
        assert r.n == 6000 and abs(r.d - 3000) <= 3 * 0.0082 * 3000 and abs(r.q - 500) <= 3 * 0.008 * 1000
    for r in sketches.trend(kept, ["k"], "run").collect():
        assert abs(r.ids_seen - 1500) <= 60 and abs(r.ids_new - (1500 if r.run == 0 else 500)) <= 120
    odd = spark.createDataFrame([("a", None, None), ("a", "x", None)], "k string, user string, v double")
    one = sketches.merged(sketches.run_sketches(odd, ["k"], "user", "v"), ["k"]).select("n", sketches.distinct("ids").alias("d")).first()
    assert (one.n, one.d) == (2, 1)


def test_cubes(spark):
    rows = [("a", 1, "u"), ("a", 1, "u"), ("a", 2, "v"), (None, 2, "u"), ("b", None, None)]
    df = spark.createDataFrame(rows, "x string, y int, id string")
    got = {(r.x, r.y, r.level): (r.n, r.ids, r.s) for r in cube_distinct(df, ["x", "y"], "id", {"s": "y"}).collect()}
    assert got[None, None, 3] == (5, 2, 6) and got["a", None, 1] == (3, 2, 4) and got[None, None, 1] == (1, 1, 2) and got[None, 2, 2] == (2, 2, 4) and got["b", None, 0] == (1, 0, None)
    sets = cube_distinct(df, ["x", "y"], "id", sets=[["x"], []])
    assert sorted((r.level, r.n) for r in sets.collect()) == [(1, 1), (1, 1), (1, 3), (3, 5)]
    plan = plan_of(cube_distinct(df, ["x", "y"], "id")).split("Physical Plan")[1]
    below = plan.index("Expand")
    assert "HashAggregate" in plan[below:] and "_id" in plan[below:]


def test_cubes_tell_ids_apart_where_they_lie(spark, monkeypatch):
    from tidemill.operators import cubes

    monkeypatch.setattr(cubes, "ROWS", 50)
    df = spark.range(400).selectExpr("cast(id % 3 as int) as x", "if(id % 7 = 0, null, id % 2) as y", "id % 37 as c")
    got = cube_distinct(df, ["x", "y"], "c")
    want = df.cube("x", "y").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.count_distinct("c").alias("ids"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = plan_of(got).split("Physical Plan")[1]
    expanded = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "level#" in line and (" c#" in line or " _id#" in line)]
    assert not expanded and ", 9), REPARTITION_BY_NUM" in plan  # ids aren't shuffled once a set; tasks follow rows
