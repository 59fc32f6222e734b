"""Updates of texts by patches, over texts and edits made of the driver's tables, each with the same question in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import patches as pt
from tidemill.plans import updates
from tidemill.queries import query
from tidemill.session import cut, table

#: Every seventh line from the fourth on gets a mark.
_EDITED = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: case when i % 7 = 4 then x || ' (edited)' else x end), chr(10))"
_LONG = "len(string_split(text, chr(10))) >= 4"


def _edits(spark, sf) -> DataFrame:
    """(doc_id, path, before, after, patch) of documents: an edit in every seventh line."""
    d = table(spark, sf, "documents")
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 7 == 3, F.concat(x, F.lit(" (edited)"))).otherwise(x))
    both = d.select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("before"), F.array_join(lines, "\n").alias("after"))
    return both.withColumn("patch", pt.unified_diff("path", "before", "after"))


def _patches(edits: DataFrame) -> DataFrame:
    return edits.select(F.col("doc_id").cast("string").alias("edit_id"), "patch")


@query(f"select 'docs/' || doc_id || '.md' as path, case when {_LONG} then 'patched' else 'kept' end as state, md5({_EDITED}) as digest from documents")
def patched_documents(spark, sf):
    """Each document's diff, applied to the document, gives the edited one."""
    edits = cut(_edits(spark, sf))
    done = pt.applied(edits.select("path", F.col("before").alias("text")), pt.hunks(_patches(edits)))
    return done.select("path", "state", F.md5("text").alias("digest"))


@query(f"select 'docs/' || doc_id || '.md' as path, md5(text) as digest from documents where {_LONG}")
def unpatched_documents(spark, sf):
    """Reversed hunks give the document before."""
    edits = cut(_edits(spark, sf))
    done = pt.applied(edits.select("path", F.col("after").alias("text")), pt.reversed_hunks(pt.hunks(_patches(edits))))
    return done.where("state = 'patched'").select("path", F.md5("text").alias("digest"))


@query(f"""select 'docs/' || doc_id || '.md' as path, case doc_id % 3 when 0 then 'patched' when 1 then 'rejected' else 'missing' end as state,
case when doc_id % 3 = 0 then md5({_EDITED}) when doc_id % 3 = 1 then md5('another text') end as digest, doc_id % 3 > 0 as has_reject from documents where {_LONG}""")
def patch_states(spark, sf):
    """Patches over the right text, over another, and over none, with their reject files."""
    edits = cut(_edits(spark, sf))
    text = F.when(F.col("doc_id") % 3 == 0, F.col("before")).otherwise("another text")
    done = cut(pt.applied(edits.where("doc_id % 3 < 2").select("path", text.alias("text")), pt.hunks(_patches(edits)))).where("state <> 'kept'")
    left = pt.rejects(done).select(F.regexp_replace("path", r"\.rej$", "").alias("path"), F.lit(True).alias("has_reject"))
    return done.join(left, "path", "left").select("path", "state", F.md5("text").alias("digest"), F.coalesce("has_reject", F.lit(False)).alias("has_reject"))


@query(f"""select doc_id::varchar as edit_id, case when not {_LONG} then 'ok' when contains(text, chr(9)) or doc_id % 5 = 0 then 'roll_back' else 'commit' end as outcome,
case when doc_id % 5 = 0 and {_LONG} then 1 else 0 end::bigint as artifacts, md5(case when doc_id % 5 = 0 then 'moved on' when not {_LONG} or contains(text, chr(9)) then text else {_EDITED} end) as digest from documents""")
def update_ledger(spark, sf):
    """Updates are applied, validated, and committed or rolled back; the ledger has what became of each."""
    edits = cut(_edits(spark, sf))
    now = edits.select("path", F.when(F.col("doc_id") % 5 == 0, "moved on").otherwise(F.col("before")).alias("text"))
    check = lambda t: t.where(F.col("text").contains("\t")).select("file", F.lit("FAIL").alias("level"))
    done = updates.apply_update(now, _patches(edits), check)
    texts = done.texts.select(F.regexp_extract("path", r"(\d+)\.md$", 1).alias("edit_id"), F.md5("text").alias("digest"))
    return done.ledger.select("edit_id", "outcome", F.size("artifacts").cast("long").alias("artifacts")).join(texts, "edit_id")


@query(f"""select doc_id::varchar as edit_id, case doc_id % 3 when 0 then 'ok' when 1 then 'warn' else 'fail' end as outcome,
case doc_id % 3 when 0 then 'reverse_patch' when 1 then 'backup_restore' end as revert_method, md5(case when doc_id % 3 = 2 then 'changed since' else text end) as digest from documents where {_LONG}""")
def reverted_updates(spark, sf):
    """Updates are undone by the reversed patch, else from a backup with the right digest, else not at all."""
    edits = cut(_edits(spark, sf).where(F.size(F.split("before", "\n", -1)) >= 4))
    third = F.col("doc_id") % 3
    now = edits.select("path", F.when(third == 0, F.col("after")).otherwise("changed since").alias("text"))
    backups = edits.select(F.col("doc_id").cast("string").alias("edit_id"), "path", F.when(third == 2, "damaged").otherwise(F.col("before")).alias("text"), F.sha2("before", 256).alias("sha256"))
    done = updates.revert(now, _patches(edits), backups)
    texts = done.texts.select(F.regexp_extract("path", r"(\d+)\.md$", 1).alias("edit_id"), F.md5("text").alias("digest"))
    return done.ledger.select("edit_id", "outcome", "revert_method").join(texts, "edit_id")


@query("""with turns as (select conv_id, turn, len(string_split(text, chr(10))) as lines, max(turn) over (partition by conv_id) as last from conversations)
select conv_id::varchar as conv_id, coalesce(sum(lines) filter (where turn * 2 > last), 0)::bigint as added, 0::bigint as removed from turns group by 1 having sum(lines) filter (where turn * 2 > last) > 0""")
def diff_line_counts(spark, sf):
    """Added and removed lines of the diff between a conversation's first half and all of it."""
    c = table(spark, sf, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    rows = c.join(last, "conv_id").groupBy(F.col("conv_id").cast("string").alias("conv_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text", (F.col("turn") * 2 > F.col("last")).alias("late")))).alias("t"))  # a conversation's turns make one text
    text = lambda of: F.array_join(F.transform(of, lambda x: F.concat(x["text"], F.lit("\n"))), "")
    both = rows.select("conv_id", text(F.filter("t", lambda x: ~x["late"])).alias("before"), text(F.col("t")).alias("after"))
    found = pt.hunks(both.select(F.col("conv_id").alias("edit_id"), pt.unified_diff("conv_id", "before", "after").alias("patch")))
    tagged = lambda tag: F.sum(F.size(F.filter("lines", lambda x: x.startswith(tag)))).cast("long")
    return found.groupBy(F.col("edit_id").alias("conv_id")).agg(tagged("+").alias("added"), tagged("-").alias("removed"))
