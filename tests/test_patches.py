"""Diffs applied, rejected, moved, reversed; updates and reverts."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.operators import patches as pt
from tidemill.plans import updates


def _texts(spark, **files):
    return spark.createDataFrame([(k.replace("__", "."), v) for k, v in files.items()], "path string, text string")


def _hunks(spark, *patches):
    return pt.hunks(spark.createDataFrame([(f"e{i}", p) for i, p in enumerate(patches)], "edit_id string, patch string"))


def _plain_apply(text, rows):
    """Hunks by a plain loop: the header's place first, else the nearest."""
    import re

    have, end, shift, out, bad = re.findall(pt._UNIT, text or ""), 0, 0, [], []
    for _, n, start, _, old, new, _, sound, *_ in rows:
        want = start - (1 if old else 0) + shift
        spots = [p for p in range(end, len(have) - len(old) + 1) if have[p : p + len(old)] == old] if old else [want] if end <= want <= len(have) else []
        if not sound or not spots:
            bad.append(n)
            continue
        at = min(spots, key=lambda p: (abs(p - want), p))
        out += have[end:at] + new
        end, shift = at + len(old), shift + at - want
    return "".join(out + have[end:]), bad


lines = st.lists(st.sampled_from(["a", "b", "-c", "+d", "-- x", "++ y", "", "@@ -1 +1 @@", "\\ z"]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(lines, lines, st.booleans(), st.booleans(), st.integers(0, 3))
def test_parser_reads_what_difflib_writes(a, b, end_a, end_b, context):
    before, after = ("\n".join(x) + "\n" * (e and bool(x)) for x, e in ((a, end_a), (b, end_b)))
    patch = pt.diff_of("f", before, after, context)
    rows = list(pt.parsed(patch))
    assert all(r[7] for r in rows)
    if context:
        assert _plain_apply(before, rows) == (after, [])


def test_apply_gives_the_other_text_and_back(spark):
    rng = random.Random(3)
    cases = []
    for i in range(120):
        a = [rng.choice(["x", "y", "z", "", "long line", "-", "+"]) for _ in range(rng.randint(0, 30))]
        b = [x for x in a if rng.random() > 0.15]
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randint(0, len(b)), rng.choice(["new", "x", ""]))
        cases.append((f"p{i}", "\n".join(a) + rng.choice(["", "\n"]), "\n".join(b) + rng.choice(["", "\n"])))
    df = spark.createDataFrame(cases, "path string, a string, b string")
    hunks = pt.hunks(df.select(F.col("path").alias("edit_id"), pt.unified_diff("path", "a", "b").alias("patch"))).cache()
    there = pt.applied(df.select("path", F.col("a").alias("text")), hunks)
    assert {r.path: r.text for r in there.collect()} == {p: b for p, _, b in cases}
    back = pt.applied(df.select("path", F.col("b").alias("text")), pt.reversed_hunks(hunks))
    assert {r.path: r.text for r in back.collect()} == {p: a for p, a, _ in cases}
    # over other texts: as the plain loop does
    rows = {}
    for r in hunks.collect():
        rows.setdefault(r.path, []).append(tuple(r)[1:])
    other = [(p, "\n".join(rng.choice(["x", "y", "z", ""]) for _ in range(3)) + "\n" + a) for p, a, _ in cases]
    got = pt.applied(spark.createDataFrame(other, "path string, text string"), hunks).collect()
    for r in got:
        text, bad = _plain_apply(dict(other)[r.path], sorted(rows.get(r.path, []), key=lambda h: h[1]))
        assert (r.text, sorted(h.hunk for h in r.rejected)) == (text, bad)


def test_moved_and_rejected(spark):
    patch = pt.diff_of("f.md", "1\n2\n3\n4\n5\n6\n7\n8\n9\n", "1\n2\nthree\n4\n5\n6\n7\n8\n9\nten\n", 1)
    texts = _texts(spark, f__md="0\n0\n1\n2\n3\n4\n5\n6\n7\n8\nnine\n", g__md="same\n")
    got = {r.path: r for r in pt.applied(texts, _hunks(spark, patch)).collect()}
    assert got["g.md"].state == "kept" and got["g.md"].text == "same\n" and not got["g.md"].rejected
    assert got["f.md"].text == "0\n0\n1\n2\nthree\n4\n5\n6\n7\n8\nnine\n"
    assert (got["f.md"].state, got["f.md"].placed, len(got["f.md"].rejected)) == ("partly", 1, 1)
    rej = pt.rejects(pt.applied(texts, _hunks(spark, patch))).collect()
    assert [(r.path, r.text) for r in rej] == [("f.md.rej", "--- a/f.md\n+++ b/f.md\n@@ -9,1 +9,2 @@\n 9\n+ten\n")]
    assert list(pt.parsed(rej[0].text))[0][4] == ["9\n"]


def test_created_deleted_missing_and_broken(spark):
    made, gone = pt.diff_of("new.md", None, "a\nb"), pt.diff_of("old.md", "x\n", None)
    lost = pt.diff_of("nowhere.md", "x\n", "y\n")
    broken = "--- a/b.md\n+++ b/b.md\n@@ -1,2 +1,2 @@\n q\n-r\n"
    texts = _texts(spark, old__md="x\n", b__md="q\nr\n", empty__md=None)
    got = {r.path: r for r in pt.applied(texts, _hunks(spark, made, gone, lost, broken, "no hunks here", None)).collect()}
    assert {p: r.state for p, r in got.items()} == {"new.md": "created", "old.md": "deleted", "nowhere.md": "missing", "b.md": "rejected", "empty.md": "kept"}
    assert got["new.md"].text == "a\nb" and got["old.md"].text is None and got["b.md"].text == "q\nr\n"
    assert pt.applied(texts.where("false"), _hunks(spark, gone).where("false")).count() == 0


def test_edits_in_order(spark):
    a, b, c = "1\n2\n3\n", "1\ntwo\n3\n", "0\n1\ntwo\n3\n"
    hunks = _hunks(spark, pt.diff_of("f", a, b), pt.diff_of("f", b, c), pt.diff_of("g", "x", "y"), pt.diff_of("f", "elsewhere\n", "!\n"))
    texts, lost = pt.applied_in_order(spark.createDataFrame([("f", a), ("g", "x"), ("h", "z")], "path string, text string"), hunks)
    assert {r.path: r.text for r in texts.collect()} == {"f": c, "g": "y", "h": "z"}
    assert [tuple(r) for r in lost.collect()] == [("e3", "f", 0)]


def test_update_commits_or_rolls_back(spark):
    texts = _texts(spark, a="1\n", b="2\n", c="3\n", d="4\n", keep="k")
    patches = [("good", pt.diff_of("a", "1\n", "one\n")), ("half", pt.diff_of("b", "2\n", "two\n") + pt.diff_of("c", "other\n", "three\n")), ("failing", pt.diff_of("d", "4\n", "bad\n")), ("new", pt.diff_of("n", None, "n\n")), ("nothing", "")]
    check = lambda t: t.select("file", F.when(F.col("text").contains("bad"), "FAIL").otherwise("PASS").alias("level"))
    done = updates.apply_update(texts, spark.createDataFrame(patches, "edit_id string, patch string"), check)
    assert {r.path: r.text for r in done.texts.collect()} == {"a": "one\n", "b": "2\n", "c": "3\n", "d": "4\n", "keep": "k", "n": "n\n"}
    assert {(r.edit_id, r.action, r.outcome, tuple(r.artifacts)) for r in done.ledger.collect()} == {("good", "apply", "commit", ()), ("half", "apply", "roll_back", ("c.rej",)), ("failing", "apply", "roll_back", ()), ("new", "apply", "commit", ()), ("nothing", "apply", "ok", ())}
    assert {(r.edit_id, r.path, r.text) for r in done.backups.collect()} == {("good", "a", "1\n"), ("half", "b", "2\n"), ("half", "c", "3\n"), ("failing", "d", "4\n"), ("new", "n", None)}


@pytest.mark.parametrize("damage", ["none", "text", "text and backup"])
def test_revert_and_its_fallback(spark, damage):
    texts = _texts(spark, a="1\n2\n", b="3\n", keep="k")
    patches = spark.createDataFrame([("e", pt.diff_of("a", "1\n2\n", "1\ntwo\n") + pt.diff_of("b", "3\n", None) + pt.diff_of("n", None, "new"))], "edit_id string, patch string")
    done = updates.apply_update(texts, patches)
    now, backups = done.texts, done.backups
    if damage != "none":
        now = now.withColumn("text", F.when(F.col("path") == "a", "1\nzwei\n").otherwise(F.col("text")))
    if damage == "text and backup":
        backups = backups.withColumn("text", F.when(F.col("path") == "b", "??").otherwise(F.col("text")))
    back = updates.revert(now, patches, backups)
    was = {"a": "1\n2\n", "b": "3\n", "keep": "k"}
    want = {"none": (was, "ok", "reverse_patch", []), "text": (was, "warn", "backup_restore", ["a.rej"]), "text and backup": ({"a": "1\nzwei\n", "keep": "k", "n": "new"}, "fail", None, ["a.rej"])}[damage]
    entry = back.ledger.first()
    assert ({r.path: r.text for r in back.texts.collect()}, entry.outcome, entry.revert_method, entry.artifacts) == want
    assert entry.action == "revert"


def test_batches_are_bounded_by_characters(spark, monkeypatch):
    from tidemill.operators import batches

    rows = [pa.record_batch({"n": list(range(i, i + 500))}) for i in (0, 500)]
    held, sent = [], []

    class Frame:
        def mapInArrow(self, run, kind):  # noqa: N802
            sent.extend(run(iter(rows)))

    monkeypatch.setattr(batches, "CHARS", 50_000)
    batches.flat_map(Frame(), lambda n: held.append(n) or [(n, ["x" * 1000])], "n long, t array<string>")
    assert [x for b in sent for x in b.column("n").to_pylist()] == list(range(1000)) and max(b.num_rows for b in sent) < 60
    assert [len(x) for x in batches.slices(pa.array(range(450)))] == [200, 200, 50]


def test_diffs_of_more_rows_than_a_slice(spark):
    df = spark.range(700).selectExpr("cast(id as string) as p", "if(id % 5 = 0, null, 'a\\nb\\n') as a", "if(id % 7 = 0, null, concat('a\\n', id)) as b").coalesce(1)
    got = {r.p: r.d for r in df.select("p", pt.unified_diff("p", "a", "b").alias("d")).collect()}
    assert got == {r.p: pt.diff_of(*r) for r in df.collect()} and len(got) == 700
