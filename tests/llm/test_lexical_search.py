"""The threshold algorithm against every document scored for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import lexical_search as ls

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def terms(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k):
    have = [(d, Counter(terms(t))) for d, t in docs]
    have = [(d, c) for d, c in have if c]
    n_docs, n_terms, df = len(have), sum(sum(c.values()) for _, c in have), Counter(t for _, c in have for t in c)
    out = []
    for item_id, text in sorted(set(items), key=str):
        found = []
        for d, c in have:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((score, d))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item_id, i + 1, d, s) for i, (s, d) in enumerate(found[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(9)
    some = lambda n: " ".join("w" + str(min(int(rng.expovariate(0.12)), 60)) for _ in range(n))
    docs = [(i, some(rng.randint(1, 50))) for i in range(300)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [(5, "W1, É w2"), (5, "W1, É w2"), (2000, None), (2001, ""), (2002, "?!"), (None, docs[3][1]), (None, "w1 w60")]
    items = [(i, some(rng.randint(1, 12))) for i in range(12)] + [(3, "w1 É"), (20, "absent words"), (21, None), (22, ""), (23, docs[3][1]), (23, docs[3][1])]
    return docs, items


@pytest.mark.parametrize(("k", "waves", "blocks", "shard", "first"), [(5, 16, 1 << 20, 1 << 20, 64), (7, 2, 1 << 20, 100, 1), (50, 3, 60, 300, 4), (1000, 16, 1 << 20, 1 << 20, 64)])
def test_whole_ranking(spark, made, k, waves, blocks, shard, first, monkeypatch):
    docs, items = made
    monkeypatch.setattr(ls, "SHARD", shard)
    monkeypatch.setattr(ls.Shard.best, "__defaults__", (first,))
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, rank int").repartition(5)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = ls.lexical_search(d, b, k, waves, blocks).collect()
    assert sorted((tuple(r) for r in got), key=str) == by_hand(docs, items, k)


def test_stops_early_and_right():
    """A document far ahead ends the rounds before the lists do; an equal score with a smaller id is still found."""
    query = ls.Query([(1, b"a b")])
    query.weigh(2000, 4000, {0: 900, 1: 900})
    n = 1500
    counts = np.ones(2 * n, np.int32)
    counts[:2] = 50
    shard = ls.Shard(query, np.arange(n)[::-1].copy(), np.zeros(n, bool), np.full(n, 2), np.arange(0, 2 * n + 1, 2), np.tile(np.array([0, 1]), n), counts)
    scored = []
    plain = shard.scores
    shard.scores = lambda docs, weight: (scored.append(len(docs)), plain(docs, weight))[1]
    top = shard.best(np.array([0, 1]), query.weight, ls._NONE, 1, 0, first_round=1)
    assert top[2].tolist() == [n - 1]
    assert sum(scored) < 10
    top = shard.best(np.array([0, 1]), query.weight, ls._NONE, 2, 0, first_round=1)
    assert top[2].tolist() == [n - 1, 0]


def test_odd_and_empty(spark, odd_docs, empty_docs):
    items = spark.createDataFrame([("a", "the FOX one"), (None, "two")], "item_id string, text string")
    got = ls.lexical_search(odd_docs, items).collect()
    assert {r.doc_id for r in got if r.item_id == "a"} == {1, 7, 8}
    assert [r.doc_id for r in got if r.item_id is None] == [8]
    assert ls.lexical_search(empty_docs, items).count() == 0
    assert ls.lexical_search(odd_docs, items.where("false")).columns == ["item_id", "rank", "doc_id", "score"]
    assert ls.lexical_search(odd_docs, items.where("false")).count() == 0
    twice = odd_docs.select("doc_id", "text", odd_docs.text.alias("TEXT"))
    assert ls.lexical_search(twice, items).count() == len(got)
