"""Windows of items in documents, against every window compared with every place."""

import hashlib
import random
import re

import pytest

from tidemill.llm import decontamination as dc

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, window, width, share):
    """{doc: (n_words, set of hit places, item names)} by trying every place."""
    out = []
    for doc_id, text in docs:
        ws, hit, names = words(text), set(), set()
        for item_id, item in items:
            iw = words(item)
            long = min(window, len(iw))
            if not long:
                continue
            w = min(width, long)
            grams = lambda x: {tuple(x[i : i + w]) for i in range(len(x) - w + 1)}
            for i in range(len(iw) - long + 1):
                rec = iw[i : i + long]
                for s in range(len(ws) - long + 1):
                    here = ws[s : s + long]
                    if here == rec if share >= 1 else len(grams(here) & grams(rec)) >= share * len(grams(rec)) - 1e-9:
                        hit |= set(range(s, s + long))
                        names.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(ws), hit, names))
    return out


def places(spans):
    return {p for s, n in spans for p in range(s, s + n)}


@pytest.fixture(scope="module")
def made():
    rng = random.Random(4)
    some = lambda n, v=6: " ".join(rng.choice("abcdefghijklmnop"[:v]) * 2 for _ in range(n))
    items = [(i, some(rng.randint(4, 9), 5)) for i in range(6)] + [(20, "Éa, bb!"), (21, "zz"), (22, "aa " * 12), (22, "other text of one id"), (23, None), (24, " .. "), (None, "null id item here")]
    docs = [(i, some(rng.randint(0, 60))) for i in range(30)]
    docs += [(30, "x " + items[0][1].upper().replace(" ", ", ") + " y " + items[1][1]), (31, "Éa-bb zz"), (32, None), (33, ""), (33, "aa " * 40), (33, "aa " * 40), (None, "NULL id item here"), (34, "éa bb")]
    return docs, items


@pytest.mark.parametrize(("window", "width", "share", "blocks"), [(5, 3, 1.0, 1 << 20), (5, 2, 0.6, 1 << 20), (4, 1, 0.75, 1 << 20), (10, 3, 1.0, 100), (5, 3, 0.5, 150)])
def test_every_place(spark, made, window, width, share, blocks, monkeypatch):
    docs, items = made
    monkeypatch.setattr(dc, "CHUNK", 100)
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n_words long, row_id string").repartition(3)
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = dc.contamination(d, b, window, width, share, blocks).collect()
    key = lambda r: (str(r[0]), r[1], sorted(r[2]), sorted(r[3]))
    assert len(got) == len(docs)
    assert sorted(map(key, ((r.doc_id, r.n_words, places(r.spans), set(r.item_ids)) for r in got))) == sorted(map(key, by_hand(docs, items, window, width, share)))
    for r in got:
        assert r.item_ids == sorted(r.item_ids)
        assert all(a.start + a.length < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_digests_and_removal(spark, made):
    docs, items = made
    d, b = spark.createDataFrame(docs, "DOC_ID long, text string").withColumnRenamed("DOC_ID", "doc_id"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in dc.digests(dc.contamination(d, b, 5)).collect()}
    for doc_id, n, hit, names in by_hand(docs, items, 5, 3, 1.0):
        r = got[doc_id, n]
        assert (r.n_hit, r.n_items, r.contaminated) == (len(hit), len(names), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    kept = dc.without_contaminated(d, b, window=5)
    assert kept.columns == d.columns
    bad = {doc_id for doc_id, _, hit, _ in by_hand(docs, items, 5, 3, 1.0) if hit}
    assert {r.doc_id for r in kept.collect()} == {x for x, _ in docs} - bad


def test_odd_and_empty(spark, odd_docs, empty_docs):
    items = spark.createDataFrame([(1, "The quick fox. The quick"), (1, "The quick fox. The quick")], "item_id long, text string")
    got = dc.contamination(odd_docs, items).collect()
    assert len(got) == odd_docs.count()
    assert {r.doc_id for r in got if r.spans} == {1}
    assert dc.contamination(empty_docs, items).count() == 0
    assert all(not r.spans and not r.item_ids for r in dc.contamination(odd_docs, items.where("false")).collect())
    twice = odd_docs.select("doc_id", "text", odd_docs.text.alias("Text"), odd_docs.doc_id.alias("DOC_ID"))
    assert dc.contamination(twice, items).count() == len(got)
    assert dc.without_contaminated(twice, items).count() == len(got) - 2
