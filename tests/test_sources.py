import datetime
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import text as tx
from tidemill.operators import compare, latest, reach
from tidemill.plans import flows
from tidemill.sources import ledger, markdown

PROGRESS = "# Progress\n\n## Done\n- [x] set up\n- [x] first table\n\n## Doing\n- [ ] second table\n- [ ] [placeholder]\n\n## Next\n"
DECISIONS = "- loose bullet above the title\n# Decisions\n\n| Date | Decision | Rationale |\n|------|----------|-----------|\n| 2024-03-02 | use one index | less to keep in step |\n| soon | open | |\n"
GOALS = "# Context\n## Current goals\n- finish the reader\n- TBD\n## Blockers\n"


def _write(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / name.replace("__", ".")).write_text(text)
    return str(tmp_path)


def _lines(spark, path):
    return markdown.read_lines(spark, path).withColumn("file", F.regexp_extract("file", "[^/]+$", 0)).cache()


def test_markdown(spark, tmp_path):
    lines = _lines(spark, _write(tmp_path, progress__md=PROGRESS, decisions__md=DECISIONS, goals__md=GOALS))
    items = [(r.section, r.checked, r.text, r.is_placeholder) for r in markdown.checklist(lines).orderBy("pos").collect()]
    assert items == [("Done", True, "set up", False), ("Done", True, "first table", False), ("Doing", False, "second table", False), ("Doing", False, "[placeholder]", True)]
    made = [(r.date, r.decision, r.rationale) for r in markdown.decisions(lines).orderBy("pos").collect()]
    assert made == [(datetime.date(2024, 3, 2), "use one index", "less to keep in step"), (None, "open", "")]
    assert {(r.section, r.text, r.is_placeholder) for r in markdown.bullets(lines).collect()} == {(None, "loose bullet above the title", False), ("Current goals", "finish the reader", False), ("Current goals", "TBD", True)}
    status = flows.session_status(lines, lines.where("file = 'goals.md'")).collect()
    assert {(r.list, r.text) for r in status} >= {("goals", "finish the reader"), ("doing", "second table"), ("decisions", "use one index"), ("validator", "## Blockers")}
    assert {(r.kind, r.n, r.note is None) for r in flows.archive_preview(lines).collect()} == {("done", 2, True), ("decisions", 2, True), ("goals", 2, True)}
    empty = flows.archive_preview(lines.where("file = 'none'")).collect()
    assert all(r.n == 0 and r.note for r in empty) and len(empty) == 3


def test_catalogue_and_front_matter(spark, tmp_path):
    book = "---\ntitle: Prompts\naudience: [people, tools]\nowners: me\nupdated: 2024-05-01\nversion: 1.10.0\n---\n| Key | Description |\n|---|---|\n| `one` | first |\n| `bundle_two` | second |\n| `lost` | no body |\n\n## `one`\ndo this\n\n## bundle_two\nand that\nthen this\n"
    path = _write(tmp_path, book__md=book, bare__md="no block")
    rows = {r.key: r for r in markdown.catalogue(_lines(spark, path)).collect()}
    assert rows["one"].body == "do this" and rows["bundle_two"].body == "and that\nthen this" and rows["lost"].body is None
    assert rows["bundle_two"].kind == "bundle" and markdown.pick(markdown.catalogue(_lines(spark, path)), "one").count() == 1
    meta = {r.file.rsplit("/", 1)[1]: r for r in markdown.front_matter(markdown.read_texts(spark, path)).collect()}
    assert meta["book.md"].audience == ["people", "tools"] and meta["book.md"].owners == ["me"] and meta["book.md"].updated == datetime.date(2024, 5, 1) and meta["book.md"].version == "1.10.0"
    assert meta["bare.md"].title is None
    (tmp_path / "index.yaml").write_text("- path: a\n  roles: [x, y]\n- path: b\n  roles: []\n")
    index = markdown.yaml_index(spark, str(tmp_path / "index.yaml"), "path:string,roles:array<string>")
    assert [r.path for r in index.where(F.array_contains("roles", "x")).collect()] == ["a"]
    assert markdown.to_yaml(index.where("path = 'a'")).first().value == "path: a\nroles:\n- x\n- y\n"


def test_ledger_and_sums(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    entries = [{"edit_id": "e1", "action": "apply", "outcome": "commit"}, {"edit_id": "e1", "action": "revert", "outcome": "ok", "revert_method": "reverse_patch"}, {"edit_id": "e2", "action": "apply", "outcome": "ok", "artifacts": ["x.rej"]}]
    log.write_text("\n".join(map(json.dumps, entries)) + '\n{"edit_id": broken\n')
    rows = ledger.read_ledger(spark, str(log)).cache()
    assert rows.count() == 4 and rows.where("_corrupt_record is not null").count() == 1
    assert ledger.last_entry(rows).first().edit_id == "e2" and ledger.last_entry(rows, "revert").first().revert_method == "reverse_patch"
    assert ledger.last_entry(rows, "none").count() == 0
    ledger.append_ledger(rows.where("_corrupt_record is null").select("edit_id", "action", "outcome"), str(tmp_path / "out"))
    ledger.append_ledger(rows.limit(1).select("edit_id", "action", "outcome"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    more = spark.createDataFrame([("e9", "apply", "ok")], "edit_id string, action string, outcome string")
    ledger.append_ledger(more, str(tmp_path / "out"))
    again = ledger.read_ledger(spark, str(tmp_path / "out"))
    assert again.count() == 5 and ledger.last_entry(again).first().edit_id == "e9" and ledger.last_entry(again, "revert").first().edit_id == "e1"
    (tmp_path / "seq.jsonl").write_text('{"edit_id": "late", "seq": 7}\n{"edit_id": "early", "seq": 3}\n{"edit_id": "none"}\n')
    assert ledger.last_entry(ledger.read_ledger(spark, str(tmp_path / "seq.jsonl"))).first().edit_id == "late"
    (tmp_path / "manifest.jsonl").write_text('{"edit_id": "e1", "files": [{"path": "a", "sha256": "x"}, {"path": "b", "sha256": "y"}]}\n')
    assert {tuple(r) for r in ledger.read_manifest(spark, str(tmp_path / "manifest.jsonl")).collect()} == {("e1", "a", "x"), ("e1", "b", "y")}
    (tmp_path / "d").mkdir()
    for n in "abc":
        (tmp_path / "d" / n).write_text(n)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    (tmp_path / "SUMS").write_text(f"{digest('a')}  a\n{digest('z')}  b\n{digest('q')}  q\n")
    found = ledger.file_sums(spark, str(tmp_path / "d")).withColumn("path", F.regexp_extract("path", "[^/]+$", 0))
    states = compare.verified(found, ledger.read_sums(spark, str(tmp_path / "SUMS")))
    assert {r.path: r.state for r in states.collect()} == {"a": "ok", "b": "changed", "c": "extra", "q": "missing"}
    lines = spark.createDataFrame([("v", 0, "checking"), ("v", 1, '{"status": "WARN", "files": 3, "errors": 0, "warns": 1}'), ("v", 2, "{bad")], "file string, pos int, line string")
    assert [(r.status, r.files, r.agrees) for r in ledger.read_results(lines).collect()] == [("WARN", 3, None)]
    said = ["VALIDATION_STATUS: PASS", 'VALIDATION_JSON: {"status": "PASS", "files": 2, "errors": 0, "warns": 0}', 'VALIDATION_JSON: {"status": "FAIL", "files": 2, "errors": 1, "warns": 0}']
    lines = spark.createDataFrame([("v", i, x) for i, x in enumerate(said)], "file string, pos int, line string")
    assert [(r.status, r.agrees) for r in ledger.read_results(lines).orderBy("pos").collect()] == [("PASS", True), ("FAIL", False)]


def test_session_lists(spark):
    table = ["| Date | Decision | Rationale |", "|---|---|---|", "| soon | undated 1 | |", "| 2029-03-01 | far | |", "| 2024-01-01 | old | |", "| later | undated 2 | |", "| 2029-03-01 | far too | |"]
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(table)], "file string, pos int, line string")
    causes = spark.createDataFrame([("f", "style", "WARN", f"w{i}") for i in range(4)] + [("f", "files", "FAIL", "gone"), ("f", "files", "FAIL", "lost")], flows.FINDING)
    rows = flows.session_status(lines, lines.limit(0), causes).orderBy("list", "pos").collect()
    assert [r.text for r in rows if r.list == "decisions"] == ["far too", "far", "old"]
    assert [r.text for r in rows if r.list == "causes"] == ["gone", "lost", "w0", "w1", "w2"]
    assert [r.text for r in rows if r.list in ("goals", "doing", "next")] == ["(none)"] * 3


def test_schema_coherence_and_flags(spark):
    texts = spark.createDataFrame([("a.md", "---\ntitle: A\n---\n- see [b](b.md) and [c](c.md) and [w](https://x.org)"), ("b.md", "# B\nprose"), ("old/z.md", "")], "file string, text string")
    assert {(r.file, r.message) for r in flows.schema_findings(texts, ["title", "owners"]).collect()} == {("a.md", "owners"), ("b.md", "no front matter"), ("old/z.md", "no front matter")}
    assert [(r.file, r.message) for r in flows.coherence_findings(texts).collect()] == [("a.md", "c.md")]
    assert [r.t for r in texts.select(tx.tier(F.col("file")).alias("t")).collect()] == ["canonical", "canonical", "historical"]
    body = texts.select(tx.bullets_first(F.regexp_replace("text", "(?s)^---.*---", "")).alias("b"))
    assert [r.b for r in body.collect()] == [True, False, None]
    assets = spark.createDataFrame([("a", "mature", []), ("b", "mature", ["x"]), ("c", "scaffold", []), ("d", "growth", None)], "path string, stage string, consumers array<string>")
    assert [r.path for r in assets.where(tx.to_deprecate(F.col("stage"), F.col("consumers"))).collect()] == ["a", "d"]
    assert [tx_ for tx_ in spark.createDataFrame([(3, True), (1, True), (3, None)], "n int, ai boolean").select(tx.to_yaml_report(F.col("n"), F.col("ai")).alias("y")).toPandas().y] == [True, False, False]
    moves = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("p", "q"), ("q", "p")], "old_path string, new_path string")
    refs = spark.createDataFrame([("a",), ("c",), ("z",)], "path string")
    assert sorted(r.path for r in compare.rewritten(refs, compare.followed(moves)).collect()) == ["d", "d", "z"]
    edges = spark.createDataFrame([("std", "lint"), ("std", "book")], "asset string, consumer string")
    assert markdown.domain_view(edges, "asset", "std") == "index_std" and spark.table("index_std").count() == 2


def test_snapshots_and_notes(spark, tmp_path):
    for day, value in (("2024-01-01", 1.0), ("2024-01-02", 2.0)):
        ledger.write_snapshot(spark.createDataFrame([("lint", "p", "m", value, day)], "tool string, path string, metric string, value double, run_date string"), str(tmp_path / "t"))
    assert [r.value for r in ledger.latest_snapshot(spark, str(tmp_path / "t")).collect()] == [2.0]
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "plan_2024-05-01_123456.txt").write_text("x")
    (tmp_path / "n" / "plain.txt").write_text("x")
    assert {(r.description, r.stamp) for r in ledger.notes(spark, str(tmp_path / "n")).collect()} == {("plan", datetime.datetime(2024, 5, 1, 12, 34, 56)), ("plain", None)}


def test_validation_and_update(spark):
    texts = spark.createDataFrame([("a.md", "# One\nok"), ("b.md", "# Two\n" + "x" * 130), ("c.md.orig", "\t")], "file string, text string")
    required = spark.createDataFrame([("a.md",), ("gone.md",)], "file string")
    heads = spark.createDataFrame([("a.md", "One"), ("b.md", "Three")], "file string, heading string")
    found = flows.findings(texts, required, heads)
    assert {(r.file, r.check, r.level) for r in found.collect()} == {("gone.md", "files", "FAIL"), ("b.md", "headers", "FAIL"), ("b.md", "style", "WARN"), ("c.md.orig", "style", "WARN"), ("c.md.orig", "leftovers", "WARN")}
    assert tuple(flows.validation(found, 3).first()) == ("FAIL", 3, 2, 3) and tuple(flows.validation(found.where("false"), 3).first()) == ("PASS", 3, 0, 0)
    assert flows.findings(texts, required, heads, strict=True).where("check = 'leftovers'").first().level == "FAIL"
    ok = spark.createDataFrame([("a", "ok")], "path string, state string")
    assert flows.update_outcome(found.where("false"), 3, texts.where("false"), ok).first().outcome == "commit"
    assert flows.update_outcome(found.where("false"), 3, texts.where("false"), ok.withColumn("state", F.lit("changed"))).first().outcome == "roll_back"
    suite = flows.health_suite(spark, lint=spark.createDataFrame([("p", "m", 1.0), ("q", "m", 2.0)], "path string, metric string, value double"))
    assert suite.where("path is null").first().value == 3.0


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    lit = F.lit
    assert get(tx.scope(lit("docs/std-global-clean.md"))) == "global" and get(tx.scope(lit("other.md"))) is None
    assert get(tx.hard_coded_path(lit("open('/home/me/x.txt')"))) == "/home/me/x.txt" and get(tx.hard_coded_path(lit("a/b"))) is None
    assert get(tx.version_key(lit("1.10.x"))) == [1, 10, 0] and get(tx.version_key(lit("1.10")) > tx.version_key(lit("1.9")))
    assert get(tx.redact(lit("me@x.org token=abc 4111111111111111"))) == "[mail] token=[secret] [number]"
    assert get(tx.unified_diff(lit("a\nb"), lit("a\nc"))).split("\n")[-5:-1] == ["-b", "\\ No newline at end of file", "+c", "\\ No newline at end of file"]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert {(r.src, r.dst) for r in reach.reachable(spark, edges).collect()} == {(s, d) for s in "abc" for d in "abc"} | {("x", "y")}
    rows = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, 1, "c")], "id int, t int, v string").withColumn("k", lit(1))
    assert [r.id for r in latest.newest_per_key(rows, ["k"], "t", "id", 2).orderBy("id").collect()] == [1, 2]


def test_one_pass_over_markdown(spark):
    text = "---\r\ntitle: x\r\n---\r\n# Top\r\n- loose\r\n\r\nUnder\r\n-----\r\n- [x] done\r\n~~~~ md\r\n- [ ] in code\r\n~~~\r\n| a | b |\r\n~~~~\r\n* star\r\n| Date | Decision | Rationale |\r\n|:--|---|--:|\r\n| 2024-01-02 | a\\|b | c |\r\n| short | |\r\n\r\n| no | table | here |\r\n## Last ##\r\n---\r\nprose | with bar\r\n"
    texts = spark.createDataFrame([("f", text), ("open", "```\n- [ ] never closed"), ("null", None), ("empty", "")], "file string, text string")
    rows = markdown.blocks(texts).cache()
    got = [(r.kind, r.section, r.text) for r in rows.where("file = 'f'").orderBy("pos").collect()]
    assert got == [
        ("front", None, "title: x"), ("heading", None, "Top"), ("bullet", None, "loose"), ("heading", "Under", "Under"), ("item", "Under", "done"), ("code", "Under", "- [ ] in code"), ("code", "Under", "~~~"),
        ("code", "Under", "| a | b |"), ("bullet", "Under", "star"), ("header", "Under", "| Date | Decision | Rationale |"), ("row", "Under", "| 2024-01-02 | a\\|b | c |"), ("row", "Under", "| short | |"),
        ("text", "Under", "| no | table | here |"), ("heading", "Last", "Last"), ("text", "Last", "prose | with bar"),
    ]
    assert {r.file for r in rows.collect()} == {"f", "open"} and rows.where("file = 'open'").first().kind == "code"
    made = markdown.block_table(rows, ["decision", "date"]).orderBy("pos").collect()
    assert [(r.decision, r.date) for r in made] == [("a|b", "2024-01-02"), ("", "short")]
    # over plain files, line-based readers agree
    plain = spark.createDataFrame([("p", PROGRESS), ("d", DECISIONS), ("g", GOALS), ("c", "## A\n```\n- [x] code\n## B\n| x | y | z |\n|---|---|---|\n| 2024-01-01 | code | |\n```\n- [ ] real\n- plain\n| Date | Decision | Rationale |\n|---|---|---|\n| 2024-01-01 | x \\| y | |\n")], "file string, text string")
    lines = plain.select("file", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    one = markdown.blocks(plain)
    assert same(markdown.checklist(lines), markdown.block_items(one)) and same(markdown.bullets(lines), markdown.block_bullets(one))
    table = markdown.block_table(one, ["date", "decision", "rationale"]).withColumn("date", F.col("date").try_cast("date"))
    assert same(markdown.decisions(lines), table) and {r.decision for r in markdown.decisions(lines).collect()} == {"use one index", "open", "x | y"}


def test_links_from_their_folder(spark):
    texts = spark.createDataFrame([
        ("docs/a.md", "[1](sub/b.md) [2](./sub/b.md#p) [3](../r.md \"t\") [4](<sub/b.md>) [5](sub/../a.md?x) [6](/root.md) [7](mailto:x@y) [8](sub%2Fb.md)\n[9](b.md) [10](../../out.md)"), ("docs/sub/b.md", "[1](../a.md)"), ("r.md", None),
    ], "file string, text string")
    assert {(r.file, r.message) for r in flows.coherence_findings(texts).collect()} == {("docs/a.md", "docs/b.md"), ("docs/a.md", "../out.md")}
    urls = texts.withColumn("file", F.concat(F.lit("file:///base/"), "file"))
    assert {r.message for r in flows.coherence_findings(urls).collect()} == {"file:///base/docs/b.md", "file:///out.md"}


def test_front_matter_found(spark):
    texts = spark.createDataFrame([("a", "---\ntags: [x]\nowners: me\n---\n"), ("b", "---\r\ntitle: T\r\nversion: 1\r\n---\r\nbody"), ("c", "none"), ("d", None), ("e", "---\n---\n"), ("f", "---\n: bad: [\n---\n")], "file string, text string")
    assert {r.file: (r.found, r.title, r.tags) for r in markdown.front_matter(texts).collect()} == {"a": (True, None, ["x"]), "b": (True, "T", None), "c": (False, None, None), "d": (False, None, None), "e": (True, None, None), "f": (False, None, None)}
    assert {(r.file, r.message) for r in flows.schema_findings(texts, ["tags", "title"]).collect()} == {("a", "title"), ("b", "tags"), ("c", "no front matter"), ("d", "no front matter"), ("e", "tags"), ("e", "title"), ("f", "no front matter")}


def test_moves_listed_twice_and_at_odds(spark):
    moves = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("b", "c"), ("x", "z"), ("x", "y"), ("q", "q"), (None, "n"), ("n", None)] + [(f"m{i}", f"m{i + 1}") for i in range(40)], "old_path string, new_path string")
    got = {r.old_path: r.new_path for r in compare.followed(moves).collect()}
    assert got == {"a": "c", "b": "c", "x": "y", **{f"m{i}": "m40" for i in range(40)}}
    refs = spark.createDataFrame([("a",), ("x",), ("x",), ("none",), (None,)], "path string")
    assert sorted(map(str, (r.path for r in compare.rewritten(refs, moves).collect()))) == ["None", "b", "none", "y", "y"]
    assert [tuple(r) for r in compare.move_conflicts(moves).collect()] == [("x", ["y", "z"])]


def test_manifest_forms(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"edit_id": "e1", "files": [{"path": "a", "sha256": "1"}, {"path": "b", "sha256": "2"}]}, indent=2))
    (tmp_path / "many.json").write_text('{"edit_id": "e2", "files": [{"path": "c", "sha256": "3"}]}\n{"edit_id": "e3", "files": [{"path": "d", "sha256": "4"}]}\n')
    (tmp_path / "single.json").write_text('{"edit_id": "e4", "files": [{"path": "e", "sha256": "5"}, {"path": "f", "sha256": "6"}]}')
    got = {tuple(r) for r in ledger.read_manifest(spark, str(tmp_path)).collect()}
    assert got == {("e1", "a", "1"), ("e1", "b", "2"), ("e2", "c", "3"), ("e3", "d", "4"), ("e4", "e", "5"), ("e4", "f", "6")}


def test_reach_of_seeds(spark):
    from tidemill.operators import reach

    edges = spark.createDataFrame([(i, i + 1) for i in range(2000)] + [(5000, 5000 + i) for i in range(1, 3000)] + [(8100, 8101), (8101, 8102), (8102, 8100), (8100, 8101), (None, 1), (1, None)], "src long, dst long")
    seeds = spark.createDataFrame([(0,), (1500,), (5000,), (8100,), (99,), (99,), (None,), (7777,)], "src long")
    got = {(r.src, r.dst): r.hops for r in reach.reach_from(edges, seeds).collect()}
    want = {(s, d): d - s for s in (0, 1500, 99) for d in range(s + 1, 2001)} | {(5000, 5000 + i): 1 for i in range(1, 3000)} | {(8100, 8101): 1, (8100, 8102): 2, (8100, 8100): 3}
    assert got == want
    import random

    rng = random.Random(1)
    some = spark.createDataFrame([(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(45)], "src long, dst long")
    inside, joined = (sorted(map(tuple, reach.reach_from(some, some.select("src").limit(20), held=h).collect())) for h in (1000, 3))
    assert inside == joined and inside
    near = reach.reach_from(some, some.select("src"), most_hops=2)
    assert {r.hops for r in near.collect()} <= {1, 2} and near.count() == reach.reach_from(some, some.select("src"), most_hops=2, held=3).count()


def test_dependencies_and_roles(spark):
    assets = spark.createDataFrame([("a", ["x", "x", None], ["r1", "r2"]), ("b", ["x", "y"], ["r2"]), ("c", None, None), ("d", [], [])], "path string, depends_on array<string>, roles array<string>")
    assert sorted(tuple(r) for r in compare.consumers(assets).collect()) == [("x", "a"), ("x", "b"), ("y", "b")]
    assert {r.path for r in compare.with_roles(assets, ["r1", "r2"]).collect()} == {"a", "b"} and {r.path for r in compare.with_roles(assets, ["r1", "r2"], every=True).collect()} == {"a"}


def test_caps_limit_groups_early(spark):
    rows = spark.range(1000).select((F.col("id") % 2).cast("string").alias("s"), F.col("id").alias("pos"))
    got = latest.capped(rows, {"0": 5, "1": 2}, "s", "pos")
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()
    assert sorted((r.s, r.pos) for r in got.collect()) == [("0", 0), ("0", 2), ("0", 4), ("0", 6), ("0", 8), ("1", 1), ("1", 3)]


@pytest.mark.parametrize("name", ["items_of_files", "table_rows_of_files"])
def test_tasks_of_files_follow_rows(spark, monkeypatch, name):
    from tidemill import file_queries
    from tidemill.catalog import QUERIES

    monkeypatch.setattr(file_queries, "ROWS", 500)
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString().split("Physical Plan")[1]
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 500 + 1
    assert n > 4 and f", {n}), REPARTITION_BY_NUM" in plan


def test_some_kinds_of_blocks(spark):
    texts = spark.createDataFrame([("f", "## a\n- [x] b\n\\- c\n| h |\n|---|\n| v\\|w |\n* d\n"), ("g", None)], "file string, text string")
    every = [r for r in markdown.blocks(texts).collect() if r.kind in ("row", "item")]
    assert markdown.blocks(texts, ["row", "item"]).collect() == every and every[1].cells == ["v|w"]


def test_a_long_file_is_shared_by_tasks(spark, monkeypatch):
    rng = random.Random(5)
    kinds = ["## h{}", "```", "- [x] i{}", "- b{}", "| a{} | b |", "|---|---|", "text {}"]
    lines = [(f, p, rng.choices(kinds, [2, 1, 4, 4, 8, 2, 4])[0].format(p)) for f, n in (("long", 300), ("b", 3), (None, 60), ("c", 1)) for p in range(n)]
    df = spark.createDataFrame(lines, "file string, pos long, line string")
    readers = [markdown.sectioned, markdown.checklist, markdown.bullets, lambda x: markdown.pipe_rows(x, ["x", "y"])]
    whole = [sorted(map(str, r(df).collect())) for r in readers]
    monkeypatch.setattr(markdown, "ROWS", 20)
    parts = markdown.parted(df)
    assert parts.where("file = 'long'").select("_part").distinct().count() > 5 and parts.groupBy("_part").count().agg(F.max("count")).first()[0] < 100
    assert [sorted(map(str, r(df).collect())) for r in readers] == whole
    above = {}
    for f, p, line in lines:  # the same by a plain loop
        code, head = above.get(f, (False, None))
        fence = line.startswith("```")
        head = line[3:] if not code and line.startswith("## ") else head
        above[f] = (code != fence, head)
        assert f"Row(file={f!r}, pos={p}, line={line!r}, code={code or fence}, heading={line[3:] if not code and line.startswith('## ') else None!r}, section={head!r})" in whole[0]


def test_searches_cost_what_they_reach(spark):
    import numpy as np

    graph = reach._Graph([(i, i + 1) for i in range(0, 3000, 3)] + [(1, 4), (4, 1)])
    seen = np.zeros(len(graph.nodes), np.uint64)
    found = [(h, len(s)) for h, s, _ in graph.levels([graph.number[0], graph.number[3]], None, seen)]
    assert found == [(1, 2), (2, 2), (3, 0)] and not seen.any()  # one array serves all blocks of seeds


def test_edges_are_not_shuffled_again(spark):
    edges = spark.range(200).selectExpr("id as src", "id + 1 as dst")
    at = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = reach.reach_from(edges, spark.range(3).selectExpr("id * 100 as src"), most_hops=3, held=0)
        assert {(r.src, r.dst, r.hops) for r in found.collect()} == {(s, s + h, h) for s in (0, 100) for h in (1, 2, 3)}
        ahead = reach.by_start(edges.distinct())
        plan = edges.selectExpr("src as k").join(ahead, F.col("k") == F.col("_at"))._jdf.queryExecution().toString().split("Physical Plan")[1]
        assert "hashpartitioning(_at" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at)
