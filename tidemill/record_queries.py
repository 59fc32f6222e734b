"""The readers and rules for files, over texts made of the driver's tables, each with the same question in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import text as tx
from tidemill.operators import compare
from tidemill.plans import flows
from tidemill.queries import ORACLES, QUERIES, query
from tidemill.session import table
from tidemill.sources import ledger, markdown

__all__ = ["ORACLES", "QUERIES"]


def _text(*parts) -> F.Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(_text(F.col("doc_id"), ".md").alias("file"), "text")


def _items(spark, sf) -> DataFrame:
    """A checklist a nation: a heading for each market segment, an item for each customer, checked if the balance is positive."""
    c = table(spark, sf, "customer").withColumn("file", F.col("c_nationkey").cast("string"))
    heads = c.select("file", "c_mktsegment").distinct().select("file", F.struct("c_mktsegment", F.lit(-1).cast("bigint").alias("n")).alias("pos"), _text("## ", F.col("c_mktsegment")).alias("line"))
    box = F.when(F.col("c_acctbal") > 0, "- [x] ").otherwise("- [ ] ")
    return heads.unionByName(c.select("file", F.struct("c_mktsegment", F.col("c_custkey").alias("n")).alias("pos"), F.concat(box, "c_name").alias("line")))


def _decisions(spark, sf) -> DataFrame:
    """A decision table for each priority: one row an order."""
    o = table(spark, sf, "orders")
    cells = ["| ", F.to_date("o_orderdate"), " | order ", F.col("o_orderkey"), " | ", F.col("o_orderstatus"), " |"]
    rows = o.select(F.col("o_orderpriority").alias("file"), (F.col("o_orderkey") + 2).alias("pos"), _text(*cells).alias("line"))
    top = F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("pos"), F.lit("| Date | Decision | Rationale |").alias("line")), F.struct(F.lit(0).cast("long").alias("pos"), F.lit("|---|---|---|").alias("line"))))
    return rows.unionByName(o.select(F.col("o_orderpriority").alias("file")).distinct().select("file", top.alias("t")).select("file", "t.*"))


@query("select doc_id || '.md' as file, count(*) as n_lines, sum(length(line))::bigint as n_chars from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by 1")
def lines_of_files(spark, sf):
    """Texts as lines with their places."""
    lines = tx.lines(_documents(spark, sf), "file", "text")
    return lines.groupBy("file").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


@query("select c_nationkey::varchar as file, c_mktsegment as section, count(*) as items, count(*) filter (where c_acctbal > 0) as done from customer group by 1, 2")
def checklist_items(spark, sf):
    """Checklists to rows, under their headings."""
    items = markdown.checklist(_items(spark, sf))
    return items.groupBy("file", "section").agg(F.count("*").alias("items"), F.count_if("checked").alias("done"))


@query("select c_nationkey::varchar as file, c_mktsegment as section, c_name as text from customer where c_acctbal <= 0")
def open_items(spark, sf):
    """What is still to do."""
    return markdown.checklist(_items(spark, sf)).where("not checked").select("file", "section", "text")


@query("select c_nationkey::varchar as file, c_mktsegment as section, c_name as text from customer")
def headed_bullets(spark, sf):
    """Plain bullets under headings."""
    lines = _items(spark, sf).withColumn("line", F.regexp_replace("line", r"^- \[[x ]\]", "-"))
    return markdown.bullets(lines).select("file", "section", "text")


@query("select o_orderpriority as file, strftime(o_orderdate, '%Y-%m-%d') as date, 'order ' || o_orderkey as decision, o_orderstatus as rationale from orders")
def decision_rows(spark, sf):
    """Pipe tables to rows, without header and rule rows."""
    return markdown.decisions(_decisions(spark, sf)).select("file", F.date_format("date", "yyyy-MM-dd").alias("date"), "decision", "rationale")


@query("select 'decisions' as list, 'order ' || o_orderkey as text from orders order by o_orderdate::date desc, o_orderkey desc limit 3")
def last_decisions(spark, sf):
    """The last three decisions of a session's status."""
    lines = _decisions(spark, sf).withColumn("file", F.lit("log")).where("pos > 0 or file is null")
    return flows.session_status(lines, lines.limit(0)).where("list = 'decisions'").select("list", "text")


@query("select p_brand as key, 'parts of ' || p_brand as description, string_agg(p_name, chr(10) order by p_partkey) as body, 'atomic' as kind from part group by 1")
def part_catalogue(spark, sf):
    """An index table with the text under each key's heading."""
    p = table(spark, sf, "part")
    keys = p.groupBy("p_brand").agg(F.min("p_partkey").alias("at"))
    row = lambda kind, a, b, line: keys.select(F.struct(F.lit(kind).alias("k"), (F.col("p_brand") if a else F.lit("")).alias("b"), F.lit(b).cast("bigint").alias("n")).alias("pos"), line.alias("line"))
    top = [("| Key | Description |", 0), ("|---|---|", 1)]
    head = p.sparkSession.range(1).select(F.explode(F.array(*(F.struct(F.struct(F.lit(0).alias("k"), F.lit("").alias("b"), F.lit(n).cast("bigint").alias("n")).alias("pos"), F.lit(x).alias("line")) for x, n in top))).alias("r")).select("r.*")
    index = row(1, True, 0, _text("| `", F.col("p_brand"), "` | parts of ", F.col("p_brand"), " |"))
    headings = row(2, True, -1, _text("## `", F.col("p_brand"), "`"))
    bodies = p.select(F.struct(F.lit(2).alias("k"), F.col("p_brand").alias("b"), F.col("p_partkey").alias("n")).alias("pos"), F.col("p_name").alias("line"))
    lines = head.unionAll(index).unionAll(headings).unionAll(bodies).withColumn("file", F.lit("book.md"))
    return markdown.catalogue(lines)


@query("select 's' || s_suppkey as file, s_name as title, ['n' || s_nationkey, 'all'][1] as first_tag, s_suppkey || '.1' as version from supplier")
def supplier_front_matter(spark, sf):
    """Front matter to columns."""
    s = table(spark, sf, "supplier")
    text = _text("---\ntitle: ", F.col("s_name"), "\ntags: [n", F.col("s_nationkey"), ", all]\nversion: '", F.col("s_suppkey"), ".1'\n---\nbody")
    return markdown.front_matter(s.select(_text("s", F.col("s_suppkey")).alias("file"), text.alias("text"))).select("file", "title", F.col("tags")[0].alias("first_tag"), "version")


@query("select 'n_name: ' || n_name || chr(10) || 'n_nationkey: ' || n_nationkey || chr(10) as value from nation")
def nations_as_yaml(spark, sf):
    """Rows as YAML documents."""
    return markdown.to_yaml(table(spark, sf, "nation").select("n_name", "n_nationkey"))


@query("select event_id, date_trunc('second', ts) as stamp from events")
def note_stamps(spark, sf):
    """Notes by the stamp in their names."""
    e = table(spark, sf, "events")
    return e.select("event_id", tx.stamp_of(F.concat(F.lit("plan_"), F.date_format("ts", "yyyy-MM-dd_HHmmss"), F.lit(".txt"))).alias("stamp"))


@query("select doc_id, case when toxic = 1 then 'FAIL' else 'WARN' end as level from labels where toxic = 1 or quality = 0")
def root_cause_lines(spark, sf):
    """Warnings and failures only."""
    level = F.when(F.col("toxic") == 1, "FAIL").when(F.col("quality") == 0, "WARN").otherwise("PASS")
    return flows.root_causes(table(spark, sf, "labels").select("doc_id", level.alias("level"))).select("doc_id", "level")


@query("""with t as (select doc_id || '.md' as file, string_split(text, chr(10)) as lines, text from documents)
select 'style' as check, 'long lines' as message, count(*) as n from t where regexp_matches(text, '(^|\n)[^\n]{121,}') having count(*) > 0
union all select 'style', 'tabs', count(*) from t where contains(text, chr(9)) having count(*) > 0
union all select 'files', 'missing', count(*) from labels l where not exists (select 1 from documents d where d.doc_id = l.doc_id + 5) having count(*) > 0
union all select 'headers', 'Summary', count(*) from t where not regexp_matches(text, '(^|\\n)#+\\s+Summary\\s*(\\n|$)') having count(*) > 0""")
def validator_findings(spark, sf):
    """Findings of the check families over documents."""
    texts = _documents(spark, sf)
    required = table(spark, sf, "labels").select(_text(F.col("doc_id") + 5, ".md").alias("file"))
    headings = texts.select("file", F.lit("Summary").alias("heading"))
    return flows.findings(texts, required, headings).groupBy("check", "message").agg(F.count("*").alias("n"))


@query("""select case when exists (select 1 from labels where toxic = 1) then 'FAIL' else 'PASS' end as status, (select count(*) from documents)::int as files,
(select count(*) from labels where toxic = 1)::int as errors, (select count(*) from labels where toxic = 0 and quality = 0)::int as warns, case when exists (select 1 from labels where toxic = 1) then 'roll_back' else 'commit' end as outcome""")
def update_outcomes(spark, sf):
    """What becomes of an update by its findings."""
    lab = table(spark, sf, "labels")
    level = F.when(F.col("toxic") == 1, "FAIL").when(F.col("quality") == 0, "WARN")
    found = lab.where("toxic = 1 or quality = 0").select(_text(F.col("doc_id"), ".md").alias("file"), F.lit("labels").alias("check"), level.alias("level"), F.lit("").alias("message"))
    sums = lab.select("doc_id", F.lit("ok").alias("state"))
    out = flows.update_outcome(found, table(spark, sf, "documents").count(), lab.where("false"), sums)
    return out.select("status", "files", "errors", "warns", "outcome")


@query("select ps.suffix as suffix, case when ps.suffix in ('orig', 'rej') then 'FAIL' end as level, count(*) as n from (select case p_size % 4 when 0 then 'orig' when 1 then 'rej' else 'md' end as suffix from part) ps group by 1, 2")
def leftover_levels(spark, sf):
    """Leftover originals when strict."""
    suffix = F.when(F.col("p_size") % 4 == 0, "orig").when(F.col("p_size") % 4 == 1, "rej").otherwise("md")
    p = table(spark, sf, "part").select(suffix.alias("suffix"))
    return p.groupBy("suffix", F.when(F.col("suffix").isin("orig", "rej"), tx.leftover_level(True)).alias("level")).agg(F.count("*").alias("n"))


@query("select case when p_size % 3 = 0 then 'global' when p_size % 3 = 1 then 'project' end as scope, count(*) as n from part group by 1")
def scopes_of_names(spark, sf):
    """Scope by file name."""
    name = F.concat(F.lit("docs/"), F.element_at(F.array(F.lit("std-global-"), F.lit("std-project-"), F.lit("notes-")), (F.col("p_size") % 3 + 1).cast("int")), F.col("p_partkey").cast("string"), F.lit(".md"))
    return table(spark, sf, "part").groupBy(tx.scope(name).alias("scope")).agg(F.count("*").alias("n"))


@query("select s_suppkey, 'supplier ' || s_suppkey || ' at /srv/data' || s_nationkey || '/in.txt' as line, '/srv/data' || s_nationkey || '/in.txt' as found from supplier")
def hard_coded_paths(spark, sf):
    """Absolute paths in lines."""
    line = _text("supplier ", F.col("s_suppkey"), " at /srv/data", F.col("s_nationkey"), "/in.txt")
    return table(spark, sf, "supplier").select("s_suppkey", line.alias("line")).withColumn("found", tx.hard_coded_path(F.col("line")))


@query("select p_partkey from part where p_size > 10 and not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45)")
def assets_to_deprecate(spark, sf):
    """Assets past their first stage that nothing consumes."""
    uses = table(spark, sf, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.array(F.first("l_quantity")).alias("consumers"))
    stage = tx.stage(F.col("p_size"), 11, 40)
    return table(spark, sf, "part").join(uses, "p_partkey", "left").where(tx.to_deprecate(stage, F.col("consumers"))).select("p_partkey")


@query("select doc_id from documents where len(string_split(text, chr(10))) > 1 and lang = 'en'")
def reports_for_yaml(spark, sf):
    """Reports of several sections that tools read."""
    sections = F.size(F.split("text", "\n", -1))
    return table(spark, sf, "documents").where(tx.to_yaml_report(sections, F.col("lang") == "en")).select("doc_id")


@query("select case when p_size % 5 = 0 then 'historical' else 'canonical' end as tier, count(*) as n from part group by 1")
def canonical_and_historical(spark, sf):
    """Canonical from historical paths."""
    path = F.concat(F.when(F.col("p_size") % 5 == 0, "docs/archive/").otherwise("docs/archway/"), F.col("p_name"))
    return table(spark, sf, "part").groupBy(tx.tier(path).alias("tier")).agg(F.count("*").alias("n"))


@query("select l_suppkey as asset, l_partkey as consumer, count(*) as n from lineitem where l_suppkey % 7 = 0 group by 1, 2")
def consumers_of_assets(spark, sf):
    """Consumers of an asset, from its array of consumers."""
    assets = table(spark, sf, "lineitem").where("l_suppkey % 7 = 0").groupBy("l_suppkey", "l_linenumber").agg(F.collect_list("l_partkey").alias("consumers"))
    return assets.select(F.col("l_suppkey").alias("asset"), F.explode("consumers").alias("consumer")).groupBy("asset", "consumer").agg(F.count("*").alias("n"))


@query("""select b.conv_id as conv_id, b.turn as turn, (a.text = b.text)::int as same from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1""")
def turn_differences(spark, sf):
    """Whether the unified diff of a turn and the next is empty."""
    c = table(spark, sf, "conversations")
    pairs = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before")).join(c.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", (tx.unified_diff(F.col("before"), F.col("text")) == "").cast("int").alias("same"))


@query("select user_id, count(*) as sessions, sum(n)::bigint as events from (select user_id, s, count(*) as n from (select user_id, sum(new) over (partition by user_id order by ts, event_id) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as new from events)) group by 1, 2) group by 1")
def sessions_per_user(spark, sf):
    """General: the batch form of streaming sessions."""
    from tidemill.streaming.events import sessions

    s = sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "30 minutes")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").cast("long").alias("events"))


@query("select 'part' || (p_partkey % 50) as old_path, 'part' || case when p_partkey % 50 >= 40 then p_partkey % 50 else 40 + (p_partkey % 50) % 10 end as path, count(*) as n from part group by 1, 2")
def followed_moves(spark, sf):
    """References through chains of moves."""
    p = table(spark, sf, "part").select((F.col("p_partkey") % 50).alias("k"))
    moves = p.distinct().where("k < 40").select(_text("part", F.col("k")).alias("old_path"), _text("part", F.col("k") + 10).alias("new_path"))
    refs = p.select(_text("part", F.col("k")).alias("path"), _text("part", F.col("k")).alias("was"))
    return compare.rewritten(refs, compare.followed(moves)).groupBy(F.col("was").alias("old_path"), "path").agg(F.count("*").alias("n"))


@query("select c_custkey as pos, case when c_acctbal > 0 then 'PASS' else 'WARN' end as status, c_nationkey as files, (c_acctbal > 0) as agrees from customer")
def validator_results(spark, sf):
    """Result lines of validator output, held against the status line before."""
    c = table(spark, sf, "customer")
    status = F.when(F.col("c_acctbal") > 0, "PASS").otherwise("WARN")
    body = _text('VALIDATION_JSON: {"status": "', status, '", "files": ', F.col("c_nationkey"), ', "errors": 0, "warns": 0}')
    said = c.select(F.col("c_custkey").cast("string").alias("file"), F.lit(-1).cast("bigint").alias("pos"), F.lit("VALIDATION_STATUS: PASS").alias("line"))
    lines = said.unionByName(c.select(F.col("c_custkey").cast("string").alias("file"), F.col("c_custkey").alias("pos"), body.alias("line")))
    return ledger.read_results(lines).select("pos", "status", "files", "agrees")
