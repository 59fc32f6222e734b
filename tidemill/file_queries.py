"""Readers, writers and stores over files that queries first write into the session's folder from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import compare, reach
from tidemill.plans import flows
from tidemill.queries import query
from tidemill.session import ROWS, cut, shared_folder, table, tasks_for
from tidemill.sources import ledger, ledger_source, markdown
from tidemill.streaming import entries
from tidemill.streaming.store import CappedStore


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _written(lines: DataFrame, name: str, by: str | None = None) -> str:
    """A folder of text files with the column value; a folder of its own for each value of `by`."""
    place = _place(lines.sparkSession, name)
    (lines.write.partitionBy(by) if by else lines.write).text(place)
    return place


def _entries(spark, sf) -> DataFrame:
    """Events as ledger entries: a user's events are entries of one edit."""
    e = table(spark, sf, "events")
    action = F.when(F.col("event_type") == "error", "revert").otherwise("apply")
    outcome = F.when(F.col("event_id") % 4 > 0, F.when(F.col("event_id") % 4 == 1, "ok").otherwise("commit"))
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("edit_id"), action.alias("action"), outcome.alias("outcome"), F.col("event_id").alias("seq"))


_ENTRIES = "(select 'u' || user_id as edit_id, case event_type when 'error' then 'revert' else 'apply' end as action, case when event_id % 4 > 0 then case event_id % 4 when 1 then 'ok' else 'commit' end end as outcome, event_id as seq from events)"


@query(f"""select action, count(*) as n, count(outcome) as with_outcome, max(seq)::bigint as last, arg_max(edit_id, seq) as last_edit from {_ENTRIES} group by 1
union all select 'broken', (select count(*) from events where event_id % 50 = 0), 0, null, null""")
def ledger_lines(spark, sf):
    """A ledger read back from JSON lines, broken ones kept apart, with the last entry of each action."""
    e = _entries(spark, sf)
    lines = e.select(F.to_json(F.struct(*e.columns)).alias("value"))
    broken = e.where("seq % 50 = 0").select(F.concat(F.lit('{"edit_id": "'), "edit_id").alias("value"))
    rows = cut(ledger.read_ledger(spark, _written(lines.unionByName(broken), "ledger")))
    good = rows.where("_corrupt_record is null")
    by_action = good.groupBy("action").agg(F.count("*").alias("n"), F.count("outcome").alias("with_outcome"), F.max("place.seq").alias("last"), F.max_by("edit_id", "place").alias("last_edit"))
    bad = rows.where("_corrupt_record is not null").agg(F.count("*").alias("n"))
    return by_action.unionByName(bad.select(F.lit("broken").alias("action"), "n", F.lit(0).cast("long").alias("with_outcome"), F.lit(None).cast("long").alias("last"), F.lit(None).cast("string").alias("last_edit")))


@query(f"""select edit_id, count(*) as n, max(seq)::bigint as last, (max(seq) filter (where action = 'revert'))::bigint as last_revert, 2::bigint as commits from {_ENTRIES} where outcome in ('ok', 'commit') group by 1""")
def committed_entries(spark, sf):
    """Entries added in two durable commits, read through the data source with filters pushed to it."""
    ledger_source.register(spark)
    place, e = _place(spark, "commits"), _entries(spark, sf)
    for part in (e.where("seq % 2 = 0"), e.where("seq % 2 = 1")):
        part.write.format(ledger_source.NAME).option("path", place).mode("append").save()
    rows = spark.read.format(ledger_source.NAME).option("path", place).load()
    commits = rows.agg(F.count_distinct("commit").alias("commits"))
    found = rows.where("outcome in ('ok', 'commit')").groupBy("edit_id").agg(F.count("*").alias("n"), F.max("seq").alias("last"), F.max(F.when(F.col("action") == "revert", F.col("seq"))).alias("last_revert"))
    return found.join(F.broadcast(commits))  # one row


@query(f"""select edit_id, 'last' as kind, max(seq)::bigint as seq, arg_max(action, seq) as action from {_ENTRIES} group by 1
union all select edit_id, 'revert', max(seq)::bigint, 'revert' from {_ENTRIES} where action = 'revert' group by 1""")
def streamed_last_entries(spark, sf):
    """The last entry and last revert of each edit, kept in state over a stream of entries that come in no order."""
    place = _place(spark, "entries")
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    rows = _entries(spark, sf).withColumn("revert_method", F.lit(None).cast("string")).join(e, F.col("seq") == F.col("event_id")).drop("event_id")
    rows.repartition(3, F.xxhash64("seq")).write.parquet(f"{place}/in")
    before = spark.conf.get(_PROVIDER)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{place}/in")
        out = entries.last_entries(stream, "36500 days", 10**15).writeStream.outputMode("update").option("checkpointLocation", f"{place}/checkpoint")
        out.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{place}/out/batch={n}")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    found = spark.read.schema(f"{entries.OUT}, batch int").parquet(f"{place}/out")
    return entries.holding(found).select("edit_id", "kind", "seq", "action")


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@query("select event_type, event_id, ts from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as r from events) where r <= 10")
def capped_store_events(spark, sf):
    """The newest ten of each key in a store that is appended to in batches and compacts itself."""
    e = table(spark, sf, "events").select("event_type", "event_id", "ts")
    store = CappedStore(spark, _place(spark, "store"), e.schema, ["event_type"], "ts", "event_id", keep=10, runs=3)
    for i in range(4):
        store.append(e.where(F.col("event_id") % 4 == i), batch=i)
    return store.read()


@query("""select 'n' || c_nationkey as edit_id, case when c_custkey % 10 = 0 then 'changed' when c_custkey % 10 = 1 then 'missing' when c_custkey % 10 = 2 then 'extra' else 'ok' end as state, count(*) as n from customer group by 1, 2""")
def backup_manifests(spark, sf):
    """Manifests over many lines and checksum lists, read and held against digests."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("edit_id"), F.concat(F.lit("files/"), F.col("c_custkey").cast("string")).alias("path"), F.sha2("c_name", 256).alias("sha256"), (F.col("c_custkey") % 10).alias("kind"))
    listed = c.where("kind <> 2").withColumn("file", F.pmod(F.xxhash64("path"), F.lit(8)))
    files = listed.groupBy("edit_id", "file").agg(F.collect_list(F.struct("path", "sha256")).alias("files"))  # a manifest of part of a nation's files
    body = F.regexp_replace(F.to_json(F.struct("edit_id", "files")), r"([\[{,])", "$1\n  ")
    manifest = ledger.read_manifest(spark, _written(files.select(body.alias("value"), F.concat("edit_id", F.lit("-"), F.col("file").cast("string")).alias("name")), "manifests", "name"))
    found = c.where("kind <> 1").select("path", F.concat("sha256", F.lit("  "), "path").alias("line"), "sha256", "kind")
    sums = ledger.read_sums(spark, _written(found.select(F.when(F.col("kind") == 0, F.concat(F.sha2("path", 256), F.lit("  "), "path")).otherwise(F.col("line")).alias("value")), "sums"))
    states = compare.verified(sums, manifest.select("path", "sha256"))
    return states.join(c.select("path", "edit_id"), "path").groupBy("edit_id", "state").agg(F.count("*").alias("n"))


@query("select n_name as path, 'r' || n_regionkey as domain, n_nationkey::bigint as rank, ['nation', 'region ' || n_regionkey][2] as role from nation where n_regionkey in (1, 2)")
def yaml_index_domains(spark, sf):
    """An index of YAML files read as rows, with a view for each domain."""
    n = table(spark, sf, "nation")
    entry = F.concat(F.lit("- path: "), "n_name", F.lit("\n  domain: r"), F.col("n_regionkey").cast("string"), F.lit("\n  rank: "), F.col("n_nationkey").cast("string"), F.lit("\n  roles: [nation, region "), F.col("n_regionkey").cast("string"), F.lit("]"))
    index = markdown.yaml_index(spark, _written(n.select(entry.alias("value"), "n_regionkey"), "index", "n_regionkey"), "path: string, domain: string, rank: long, roles: array<string>")
    index = cut(index)
    views = [markdown.domain_view(index, "domain", d) for d in ("r1", "r2")]
    rows = spark.table(views[0]).unionByName(spark.table(views[1]))
    return rows.where(F.array_contains("roles", "nation")).select("path", "domain", "rank", F.col("roles")[1].alias("role"))


@query("""with d as (select strftime(ts, '%Y-%m-%d') as run_date, event_type as tool, count(*) as n from events group by 1, 2), k as (select distinct run_date from d order by 1 desc limit 3)
select tool, arg_max(n, run_date) as n, max(run_date) as run_date from d where run_date in (select run_date from k) group by 1""")
def latest_snapshots(spark, sf):
    """Runs kept as a timeline of snapshots, and each tool's latest."""
    d = cut(table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_date"), F.col("event_type").alias("tool")).agg(F.count("*").alias("n")))
    place = _place(spark, "snapshots")
    days = sorted(r[0] for r in d.select("run_date").distinct().orderBy(F.desc("run_date")).limit(3).collect())
    for day in days:
        ledger.write_snapshot(d.where(F.col("run_date") == day), place)
    return ledger.latest_snapshot(spark, place).select("tool", "n", F.col("run_date").cast("string").alias("run_date"))


def _orders_as_text(spark, sf) -> DataFrame:
    """A Markdown file an order: front matter, a table of its lines (with bars in cells), code that looks like records, and one item."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    tasks = tasks_for(lines, ROWS)
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").repartition(tasks, "o_orderkey")
    line = F.concat(F.lit("| "), F.col("l_partkey").cast("string"), F.lit(" | qty\\|"), F.col("l_linenumber").cast("string"), F.lit(" |"))
    rows = lines.repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("line")))).alias("t"))  # an order's lines
    table_text = F.array_join(F.transform("t", lambda x: x["line"]), "\r\n")
    parts = [F.lit("---\r\ntitle: order\r\n---\r\nOrder\r\n=====\r\nLines\r\n-----\r\n| Part | Note |\r\n|---|:-:|\r\n"), table_text, F.lit("\r\n\r\n````\r\n```\r\n- [ ] no item\r\n| no | row |\r\n## no heading\r\n````\r\n## To do\r\n- ["), F.when(F.col("o_orderstatus") == "F", "x").otherwise(" "), F.lit("] close "), F.col("o_orderkey").cast("string"), F.lit("\r\n* remark\r\n")]
    return o.join(rows, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").cast("string").alias("file"), F.concat(*parts).alias("text"))


@query("select l_orderkey::varchar as file, l_partkey::varchar as part, 'qty|' || l_linenumber as note from lineitem join orders on o_orderkey = l_orderkey")
def table_rows_of_files(spark, sf):
    """Tables of files, one pass over each file: bars in cells, code passed over, CRLF."""
    return markdown.block_table(markdown.blocks(_orders_as_text(spark, sf), ["row"]), ["part", "note"]).select("file", "part", "note")


@query("""with o as (select distinct o_orderkey, o_orderstatus from orders join lineitem on o_orderkey = l_orderkey)
select o_orderkey::varchar as file, 'To do' as section, 'close ' || o_orderkey as text, o_orderstatus = 'F' as checked, 1::bigint as bullets, 3::bigint as headings, 4::bigint as code from o""")
def items_of_files(spark, sf):
    """Items, bullets, headings and code of files from the same pass."""
    rows = markdown.blocks(_orders_as_text(spark, sf), ["item", "bullet", "heading", "code"])  # a file has an item, so none is lost
    count = lambda kind: F.count_if(F.col("kind") == kind).alias({"bullet": "bullets", "heading": "headings"}.get(kind, kind))
    one = lambda c: F.max(F.when(F.col("kind") == "item", F.col(c))).alias(c)
    return rows.groupBy("file").agg(one("section"), one("text"), one("checked"), count("bullet"), count("heading"), count("code"))


@query("""with f as (select s_suppkey as k, s_nationkey as n, 'd' || (s_suppkey % 3) || '/s' || s_suppkey || '.md' as file from supplier)
select file, 'schema' as check, case when k % 4 = 0 then 'no front matter' else 'version' end as message from f where k % 4 < 2
union all select file, 'coherence', case when k % 2 = 0 then 'd' || ((k + 1) % 3) || '/gone.md' else '../out.md' end from f where k % 5 = 0
union all select file, 'style', 'tabs' from f where n % 3 = 0 union all select file, 'headers', 'Summary' from f where n % 2 = 0 union all select 'd9/none.md', 'files', 'missing'
union all select 'd0/left.md.orig', x, y from (values ('leftovers', 'leftover'), ('schema', 'no front matter')) v(x, y)""")
def check_families(spark, sf):
    """Findings of all five check families, with links resolved from their file's folder."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    path = lambda k: F.concat(F.lit("d"), (k % 3).cast("string"), F.lit("/s"), k.cast("string"), F.lit(".md"))
    k, own = F.col("k"), path(F.col("k"))
    front = F.when(k % 4 == 0, "").when(k % 4 == 1, "---\ntags: [a]\nowners: me\n---\n").otherwise("---\ntags: [a]\nowners: me\nversion: '1'\n---\n")
    fine = F.concat(F.lit("[a](./"), F.regexp_extract(own, "[^/]+$", 0), F.lit("#part) [b](../"), own, F.lit(' "title") [w](https://x.org) [h](#h)\n'))
    dead = F.when(k % 5 == 0, F.when(k % 2 == 0, F.concat(F.lit("[c](../x/../d"), ((k + 1) % 3).cast("string"), F.lit("/gone.md)\n"))).otherwise("[d](../../out.md)\n")).otherwise("")
    text = F.concat(front, F.when(F.col("n") % 2 == 0, "# Other\n").otherwise("# Summary\n"), fine, dead, F.when(F.col("n") % 3 == 0, "\tx\n").otherwise("x\n"))
    texts = s.select(own.alias("file"), text.alias("text")).unionByName(spark.createDataFrame([("d0/left.md.orig", "")], "file string, text string"))
    required = texts.select("file").unionByName(spark.createDataFrame([("d9/none.md",)], "file string"))
    headings = texts.where("not file like '%.orig'").select("file", F.lit("Summary").alias("heading"))
    return flows.all_findings(texts, required, headings, ["tags", "owners", "version"]).select("file", "check", "message")


@query("""with o as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as r, count(*) over (partition by o_custkey) as n from orders)
select o_orderkey, (n - r)::bigint as reached, (n - r)::int as hops from o where r = 1 + n // 3 and n > r""")
def order_chain_reach(spark, sf):
    """What some nodes reach, without the reach of all: orders after one in a customer's chain of orders."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey")
    o = table(spark, sf, "orders").select("o_orderkey", F.lead("o_orderkey").over(w.orderBy("o_orderkey")).alias("next"), F.row_number().over(w.orderBy("o_orderkey")).alias("r"), F.count("*").over(w).alias("n"))
    edges = o.where("next is not null").select(F.col("o_orderkey").alias("src"), F.col("next").alias("dst"))
    seeds = o.where("r = 1 + floor(n / 3)").select(F.col("o_orderkey").alias("src"))
    found = reach.reach_from(edges, seeds)
    return found.groupBy(F.col("src").alias("o_orderkey")).agg(F.count("*").alias("reached"), F.max("hops").alias("hops"))


@query("select l_partkey as asset, count(distinct l_orderkey) as consumers, min(l_orderkey)::bigint as first from lineitem group by 1")
def consumers_from_dependencies(spark, sf):
    """Consumers of each asset from the dependency arrays of others."""
    assets = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.collect_set("l_partkey").alias("depends_on"))  # an order's parts
    return compare.consumers(assets).groupBy("asset").agg(F.count("*").alias("consumers"), F.min("consumer").alias("first"))


@query("select p_partkey, len(list_intersect(string_split(p_name, ' '), ['red', 'ring', 'small']))::bigint as matched from part where len(list_intersect(string_split(p_name, ' '), ['red', 'ring', 'small'])) > 0")
def parts_by_roles(spark, sf):
    """Assets that have any of some roles, from their arrays of role tags."""
    assets = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("roles"))
    return compare.with_roles(assets, ["red", "ring", "small"]).select("p_partkey", F.size("matched").cast("long").alias("matched"))
