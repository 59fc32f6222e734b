"""The described operations over the driver's tables, each with the same question in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text as tx
from tidemill.operators import compare, latest, reach, rollup
from tidemill.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("select event_id, ts, user_id, event_type, value from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as r from events) where r <= 10")
def newest_10_events_per_type(spark, sf):
    """Keep the newest ten of each key."""
    return latest.newest_per_key(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value"), ["event_type"], "ts", "event_id")


@query("select event_type, greatest(count(*) - 10, 0)::bigint as stale from events group by 1")
def stale_events_per_type(spark, sf):
    """What retention would drop."""
    return latest.stale_per_key(table(spark, sf, "events"), ["event_type"])


@query("select event_type, max(ts) as ts, arg_max(event_id, ts) as event_id from events group by 1")
def latest_event_per_type(spark, sf):
    """The latest run of each tool."""
    return latest.latest(table(spark, sf, "events"), ["event_type"], ["ts", "event_id"], "ts", "event_id")


@query("select user_id, max(ts) as ts, arg_max(value, ts) as value from events where event_type = 'error' group by 1")
def latest_error_per_user(spark, sf):
    """The last entry of one action."""
    return latest.latest_where(table(spark, sf, "events"), F.col("event_type") == "error", ["user_id"], ["ts", "event_id"], "ts", "value")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 3")
def top_3_orders(spark, sf):
    """The last three."""
    return latest.top(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 3, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("select event_type, event_id from (select *, row_number() over (partition by event_type order by event_id) as r from events where event_type in ('click', 'error', 'view')) where r <= case event_type when 'click' then 5 when 'error' then 3 else 2 end")
def capped_events(spark, sf):
    """Caps by section."""
    return latest.capped(table(spark, sf, "events").select("event_type", "event_id"), {"click": 5, "error": 3, "view": 2}, "event_type", "event_id")


@query("select conv_id, arg_min(text, turn) as first, arg_max(text, turn) as last from conversations group by 1")
def first_and_last_turn(spark, sf):
    """First and last bullet."""
    return latest.first_and_last(table(spark, sf, "conversations"), ["conv_id"], "turn", "text")


_LINES = "(select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents)"


@query(f"select file, pos::bigint as pos, line from (select doc_id as file, pos, line, row_number() over (partition by doc_id order by pos desc) as r from {_LINES}) where r <= 2")
def last_two_lines(spark, sf):
    """The last two lines, verbatim. Taken from each text's array, so no shuffle ranks lines."""
    parts = F.split("text", "\n", -1)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("file"), parts.alias("parts"))
    tail = F.transform(F.sequence(F.greatest(F.size("parts") - 2, F.lit(0)), F.size("parts") - 1), lambda i: F.struct(i.cast("long").alias("pos"), F.col("parts")[i].alias("line")))
    return docs.select("file", F.explode(tail).alias("x")).select("file", "x.pos", "x.line")


@query(f"select file, line from (select doc_id as file, line, row_number() over (partition by doc_id order by pos desc) as r from {_LINES} where regexp_matches(line, '(?i)licen[cs]e')) where r = 1")
def last_licence_line(spark, sf):
    """The last line of a kind."""
    lines = tx.lines(table(spark, sf, "documents").select(F.col("doc_id").alias("file"), "text").where(F.col("text").rlike("(?i)licen[cs]e")), "file", "text")
    return latest.last_matching(lines, "(?i)licen[cs]e")


@query("select user_id, n, errors, warns, case when errors > 0 then 'FAIL' when warns > 0 then 'WARN' else 'PASS' end as status from (select user_id, count(*) as n, count(*) filter (where event_type = 'error') as errors, count(*) filter (where event_type = 'view') as warns from events group by 1)")
def checks_per_user(spark, sf):
    """Errors, warnings and status."""
    return rollup.checks_rollup(table(spark, sf, "events"), ["user_id"], F.col("event_type") == "error", F.col("event_type") == "view")


@query("select event_type, count(*) as n from events group by 1")
def events_by_kind(spark, sf):
    """Counts by kind."""
    return rollup.counts(table(spark, sf, "events"), "event_type")


@query("select o_orderkey, count(l_orderkey) as n from orders left join lineitem on o_orderkey = l_orderkey group by 1")
def lines_per_order(spark, sf):
    """Zeros kept."""
    return rollup.counts_with_zeros(table(spark, sf, "orders"), table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey")


@query(f"select line, count(*) as n from {_LINES} group by 1 having count(*) > 1")
def repeated_lines(spark, sf):
    """Duplicate headings."""
    return rollup.repeated(tx.lines(table(spark, sf, "documents"), "doc_id", "text"), "line")


@query("select event_type, day, n, n - lag(n) over (partition by event_type order by day) as delta from (select event_type, strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by 1, 2)")
def daily_trend(spark, sf):
    """Health over time."""
    return rollup.trend(table(spark, sf, "events"), ["event_type"], F.date_format("ts", "yyyy-MM-dd"))


@query("select user_id, event_type, count(distinct ts::date) as runs from events group by 1, 2 having count(distinct ts::date) >= 12")
def recurring_issues(spark, sf):
    """What keeps coming back."""
    return rollup.recurring(table(spark, sf, "events"), ["user_id", "event_type"], F.to_date("ts"), 12)


@query("select event_type, count(value) as n, round(sum(value), 4) as total, min(value) as least, max(value) as most from events group by 1")
def tool_summaries(spark, sf):
    """Summaries, and summaries of them (by user and type, then by type)."""
    fine = rollup.summary(table(spark, sf, "events"), ["event_type", "user_id"], "value")
    return rollup.summary_of(fine, ["event_type"]).withColumn("total", F.round("total", 4))


@query("select 'events' as tool, strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by 2 union all select 'orders', strftime(o_orderdate, '%Y-%m-%d'), count(*) from orders group by 2")
def suite_snapshot(spark, sf):
    """Outputs of all tools in one frame."""
    daily = lambda name, ts: rollup.counts(table(spark, sf, name).select(F.date_format(ts, "yyyy-MM-dd").alias("day")), "day")
    return rollup.suite(events=daily("events", "ts"), orders=daily("orders", "o_orderdate"))


@query("select source, lang, count(*) as n from documents group by 1, 2")
def change_review(spark, sf):
    """A change set by kind and file."""
    return rollup.counts(table(spark, sf, "documents"), "source", "lang")


@query("select conv_id, count(*) as n from conversations group by 1 having count(*) > 6")
def conversations_over_limit(spark, sf):
    """Files with too many changed lines."""
    return rollup.repeated(table(spark, sf, "conversations"), "conv_id", 6)


@query("select d.doc_id, coalesce(l.quality, 1)::int as quality, case when l.doc_id is null then 'global' else 'project' end as tier from documents d left join labels l using (doc_id)")
def quality_override(spark, sf):
    """Project over global."""
    base = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("quality"))
    return compare.overridden(base, table(spark, sf, "labels"), ["doc_id"], "quality")


@query("select coalesce(b.item_id, l.doc_id) as id, case when b.item_id is null then 'added' when l.doc_id is null then 'deleted' else 'kept' end as change from benchmark b full join labels l on b.item_id = l.doc_id")
def benchmark_label_difference(spark, sf):
    """Added, deleted, kept."""
    return compare.difference(table(spark, sf, "benchmark").select(F.col("item_id").alias("id")), table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id")


@query("select page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') as path, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) as host from pages")
def clean_page_urls(spark, sf):
    """Paths found and rewritten."""
    return table(spark, sf, "pages").select("page_id", tx.clean_url(F.col("url")).alias("path"), tx.host(F.col("url")).alias("host"))


@query("select p_partkey, case when p_type = (select min(p_type) from part) then 'moved' else p_type end as path from part")
def rewritten_part_types(spark, sf):
    """References through a move manifest of one entry."""
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("path"))
    moves = parts.agg(F.min("path").alias("old_path")).withColumn("new_path", F.lit("moved"))
    return compare.rewritten(parts, moves)


@query("select 'd' || (l.l_suppkey % 7)::varchar as src, count(*) as n from lineitem l group by 1")
def consumers_per_asset(spark, sf):
    """Consumers of an asset."""
    return rollup.counts(table(spark, sf, "lineitem").select(F.concat(F.lit("d"), (F.col("l_suppkey") % 7).cast("string")).alias("src")), "src")


@query("with recursive e as (select distinct r_name as src, n_name as dst from region join nation on n_regionkey = r_regionkey union select distinct n_name, 's' || (s_suppkey % 5)::varchar from nation join supplier on s_nationkey = n_nationkey), p(src, dst) as (select src, dst from e union select p.src, e.dst from p join e on p.dst = e.src) select src, dst from p")
def dependency_reach(spark, sf):
    """Everything that a change reaches."""
    region, nation, supplier = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    a = region.join(nation, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    b = nation.join(supplier, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("src"), F.concat(F.lit("s"), (F.col("s_suppkey") % 5).cast("string")).alias("dst"))
    return reach.reachable(spark, a.unionByName(b).distinct()).select("src", "dst")


@query("select sha256(text) as digest, count(*) as n, min(doc_id) as first from documents group by 1 having count(*) > 1")
def shared_digests(spark, sf):
    """Equal checksums."""
    return compare.same_content(table(spark, sf, "documents"), "doc_id", "text")


@query("select coalesce(d.doc_id, l.doc_id) as doc_id, case when l.doc_id is null then 'extra' when d.doc_id is null then 'missing' when d.n_chars % 2 = l.quality then 'ok' else 'changed' end as state from documents d full join labels l on d.doc_id = l.doc_id")
def verified_labels(spark, sf):
    """Files against their manifest."""
    return compare.verified(table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 2).alias("sha256")), table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("sha256")), "doc_id")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def orders_without_lines(spark, sf):
    """Required and absent."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return compare.missing(orders, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"]).select(F.col("k").alias("o_orderkey"))


@query("select doc_id from documents where doc_id in (select doc_id from labels)")
def labelled_documents(spark, sf):
    """Present artifacts."""
    return compare.present(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


@query("select doc_id, len(string_split(text, chr(10)))::bigint as n_lines, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))::bigint as longest, len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 400))::bigint as long_lines, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, chr(9))))::bigint as tabs from documents")
def style_figures(spark, sf):
    """Line lengths and tabs."""
    return table(spark, sf, "documents").select("doc_id", tx.style(F.col("text"), 400).alias("s")).select("doc_id", "s.*")


@query("select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[\\w.+-]+@[\\w-]+(\\.[\\w-]+)+', '[mail]', 'g'), '(?i)\\b(token|secret|password|api[_-]?key)\\s*[:=]\\s*\\S+', '\\1=[secret]', 'g'), '\\b\\d{12,19}\\b', '[number]', 'g')) as digest from documents")
def redacted_digests(spark, sf):
    """Redaction."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.redact(F.col("text")), 256).alias("digest"))


@query("select c_custkey, coalesce(case when c_acctbal > 5000 then 'flag' end, case when c_nationkey < 5 then 'env' end, c_mktsegment) as setting from customer")
def layered_settings(spark, sf):
    """Flag over environment over default."""
    c = table(spark, sf, "customer")
    return c.select("c_custkey", tx.setting(F.when(F.col("c_acctbal") > 5000, F.lit("flag")), F.when(F.col("c_nationkey") < 5, F.lit("env")), F.col("c_mktsegment")).alias("setting"))


@query("select user_id, case when count(*) >= 80 then 'mature' when count(*) >= 60 then 'growth' else 'scaffold' end as stage from events group by 1")
def stage_per_user(spark, sf):
    """Stage gates."""
    return rollup.counts(table(spark, sf, "events"), "user_id").select("user_id", tx.stage(F.col("n"), 60, 80).alias("stage"))


@query("select o_orderkey, date_diff('day', o_orderdate::date, date '2001-08-01')::bigint as stale_days from orders")
def order_freshness(spark, sf):
    """Days since an update."""
    return table(spark, sf, "orders").select("o_orderkey", tx.stale_days(F.to_date("o_orderdate"), F.lit("2001-08-01").cast("date")).cast("long").alias("stale_days"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def event_properties(spark, sf):
    """Fields of JSON lines."""
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and starts_with(c_name, 'C')")
def assets_by_role(spark, sf):
    """Assets by tag and prefix."""
    c = table(spark, sf, "customer")
    return c.where(F.array_contains(F.array(F.lit("BUILDING"), F.lit("MACHINERY")), F.col("c_mktsegment")) & tx.prefixed(F.col("c_name"), "C")).select("c_custkey")


@query("select r_name, n_name, count(*) as n from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey group by rollup (r_name, n_name)")
def customers_rollup(spark, sf):
    """General: roll-up over a star join."""
    joined = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(table(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def pricing_summary(spark, sf):
    """General: filtered aggregate."""
    li = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("select date_trunc('hour', ts) as start, date_trunc('hour', ts) + interval 1 hour as end, event_type, count(*) as n from events group by 1, 2, 3")
def hourly_windows(spark, sf):
    """General: the batch form of the streaming window."""
    from tidemill.streaming.events import windowed

    out = windowed(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"], "1 hour")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
