"""As-of and interval joins, validity intervals, sketches and cubes over the driver's tables, each with the same question in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import cubes, sketches, temporal, timeline
from tidemill.queries import query
from tidemill.session import ROWS, cut, shared_folder, table, tasks_for

_DAY = 86_400_000_000


@query("""with e as (select user_id, ts, max(event_id) as error_id from events where event_type = 'error' group by 1, 2)
select a.event_id as event_id, e.error_id as error_id from events a asof left join e on a.user_id = e.user_id and a.ts > e.ts""")
def last_error_before_events(spark, sf):
    """As-of join: each event with its user's last error before it."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return temporal.asof_join(e, e.where("event_type = 'error'"), ["user_id"], "ts", "ts", {"event_id": "error_id"}, "event_id", 7 * _DAY, strict=True).select("event_id", "error_id")


@query("""with w as (select o_custkey, o_orderkey, o_orderdate::date as s, o_orderdate::date + (3 * (o_orderkey % 40))::int as e from orders)
select a.o_custkey as o_custkey, count(*) as pairs, min(a.o_orderkey)::bigint as first_order, max(b.o_orderkey)::bigint as last_order
from w a join w b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.s <= b.e and b.s <= a.e group by 1""")
def overlapping_order_windows(spark, sf):
    """Interval join by key: a customer's orders whose windows overlap."""
    w = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("s"), F.expr("date_add(to_date(o_orderdate), cast(3 * (o_orderkey % 40) as int))").alias("e"))
    other = w.select("o_custkey", F.col("o_orderkey").alias("other"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    pairs = temporal.overlap_join(w, other, ["o_custkey"], ("s", "e"), ("s2", "e2"), base=16).where("o_orderkey < other")
    return pairs.groupBy("o_custkey").agg(F.count("*").alias("pairs"), F.min("o_orderkey").alias("first_order"), F.max("other").alias("last_order"))


@query("""with c as (select p_partkey, date '1995-01-01' + (p_partkey % 700)::int as s, date '1995-01-01' + (p_partkey % 700 + p_size % 9)::int as e from part)
select p_partkey, count(*) as orders, sum(o_totalprice::decimal(18, 2))::double as total from c join orders on o_orderdate::date between s and e group by 1""")
def orders_in_campaigns(spark, sf):
    """Range join without a key: orders that fall into campaigns of a few days."""
    day = lambda days: F.date_add(F.lit("1995-01-01").cast("date"), days.cast("int"))
    c = table(spark, sf, "part").select("p_partkey", day(F.col("p_partkey") % 700).alias("s"), day(F.col("p_partkey") % 700 + F.col("p_size") % 9).alias("e"))
    o = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("price"))  # a row a day, exact sums
    pairs = temporal.overlap_join(F.broadcast(o), c.repartition(tasks_for(c, ROWS)), [], ("day", "day"), ("s", "e"), base=4)
    return pairs.groupBy("p_partkey").agg(F.sum("n").alias("orders"), F.sum("price").cast("double").alias("total"))


_STATES = "select user_id, strftime(ts, '%Y-%m-%d') as run, arg_max(event_type, (ts, event_id)) as state from events group by 1, 2"


def _states(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd").alias("run")
    return table(spark, sf, "events").groupBy("user_id", day).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


@query(f"""with s as ({_STATES}), n as (select run, row_number() over (order by run) as n from (select distinct run from s)),
t as (select *, case when state = lag(state) over (partition by user_id order by n) and n - 1 = lag(n) over (partition by user_id order by n) then 0 else 1 end as new from s join n using (run)),
i as (select *, sum(new) over (partition by user_id order by n) as island from t),
g as (select user_id, any_value(state) as state, min(run) as valid_from, max(n) + 1 as n from i group by user_id, island)
select user_id, state, valid_from, run as valid_to from g left join n using (n)""")
def state_intervals(spark, sf):
    """Each user's last event of a day as a state that holds over intervals of days."""
    return timeline.intervals(_states(spark, sf), ["user_id"], "run", "state")


@query("""with s as (select l_suppkey, strftime(l_shipdate::date, '%Y') as run, count(*) % 4 as lines from lineitem where strftime(l_shipdate::date, '%Y') >= '1996' group by 1, 2),
n as (select run, row_number() over (order by run) as n from (select distinct run from s)),
t as (select *, case when lines = lag(lines) over w and n - 1 = lag(n) over w then 0 else 1 end as new from s join n using (run) window w as (partition by l_suppkey order by n)),
i as (select *, sum(new) over (partition by l_suppkey order by n) as island from t),
g as (select l_suppkey, any_value(lines) as lines, min(run) as valid_from, max(n) + 1 as n from i group by l_suppkey, island)
select l_suppkey, lines::bigint as lines, valid_from, run as valid_to from g left join n using (n)""")
def merged_timeline(spark, sf):
    """Years of supplier figures merged run by run into a timeline table, the last run twice."""
    import uuid

    line = table(spark, sf, "lineitem").select("l_suppkey", F.date_format(F.to_date("l_shipdate"), "yyyy").alias("run")).where("run >= '1996'")
    figures = cut(line.groupBy("l_suppkey", "run").agg((F.count("*") % 4).alias("lines")))
    runs = sorted(r[0] for r in figures.select("run").distinct().collect())
    kept = timeline.Timeline(spark, f"{shared_folder(spark)}/timeline-{uuid.uuid4().hex}", ["l_suppkey"], "lines", buckets=8)
    for run in [*runs, runs[-1]]:
        kept.merge(figures.where(F.col("run") == run).select("l_suppkey", "lines"), run)
    return kept.read()


@query("select event_type, count(*) as n, true as ids_near, true as median_near from events group by 1")
def merged_sketches(spark, sf):
    """Distinct users and median value of each event type, merged from daily sketches and held against exact figures."""
    e = table(spark, sf, "events")
    daily = cut(sketches.run_sketches(e, ["event_type", F.to_date("ts").alias("day")], "user_id", "value"))
    total = sketches.merged(daily, ["event_type"]).select("event_type", "n", sketches.distinct("ids").alias("d"), sketches.quantile("spread", 0.5).alias("q"))
    below = e.join(F.broadcast(total), "event_type").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") <= F.col("q")).alias("low"), F.count("value").alias("values"))  # one row an event type
    both = total.join(below, "event_type")
    near = F.abs(F.col("d") - F.col("users")) <= F.greatest(F.lit(2), 0.03 * F.col("users"))
    return both.select("event_type", "n", near.alias("ids_near"), (F.abs(F.col("low") / F.col("values") - 0.5) <= 0.03).alias("median_near"))


@query("""select o_orderstatus, o_orderpriority, strftime(o_orderdate::date, '%Y') as year, grouping_id(o_orderstatus, o_orderpriority, strftime(o_orderdate::date, '%Y'))::bigint as level,
count(*) as n, count(distinct o_custkey) as ids from orders group by cube (o_orderstatus, o_orderpriority, strftime(o_orderdate::date, '%Y'))""")
def customers_cube(spark, sf):
    """Grouping sets: orders and distinct customers for every subset of status, priority and year."""
    o = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", F.date_format(F.to_date("o_orderdate"), "yyyy").alias("year"), "o_custkey")
    return cubes.cube_distinct(o, ["o_orderstatus", "o_orderpriority", "year"], "o_custkey")
