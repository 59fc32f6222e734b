import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tidemill.llm import near_dups
from tidemill.llm.common import map_rows
from tidemill.llm.graph import components
from tidemill.llm.near_dups import near_duplicates, shingle_hashes, without_duplicates


def _brute(rows, words):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        least = min((x for x in low[find(i)] if x is not None), default=None)
        out.append((d, len(sets[i]), least, d == least))
    return sorted(out, key=str)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(rnd.randint(100, 400), rnd.randint(100, 400)) for _ in range(200)] + [(500, x) for x in range(501, 560)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(3000)]
    text = lambda k: [rnd.choice(vocabulary[:60] if rnd.random() < 0.4 else vocabulary) for _ in range(k)]
    rows, doc = [], 0
    passage = text(60)
    for _ in range(n):
        base = text(rnd.choice([1, 2, 3, 8, 30, 120, 300]))
        if rnd.random() < 0.3:
            base = passage + text(rnd.randint(5, 40))
        for _ in range(rnd.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 18))):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((doc, " ".join(w)))
            doc += 1
            base = w if rnd.random() < 0.5 else base  # chains of copies
    return rows


def test_against_all_pairs(spark):
    for words, seed in ((2, 1), (5, 2)):
        rows = _corpus(seed, 110)
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=words).collect()
        assert sorted((tuple(r) for r in got), key=str) == _brute(rows, words)


def _near_copies(seed, n):
    """A group of copies at distances around the threshold, most of them just under it to each other."""
    rnd = random.Random(seed)
    rows = []
    for size in (90, 260):
        base = [f"b{size}_{i}" for i in range(size)]
        for _ in range(n):
            w = list(base)
            for _ in range(rnd.randint(size // 50, size // 13)):
                w[rnd.randrange(size)] = f"m{rnd.randrange(40 * n)}"
            rows.append((len(rows), " ".join(w[: rnd.randint(size - 8, size)])))
    return rows


@pytest.mark.parametrize(("rounds", "chunk"), [(3, 2048), (0, 2048), (0, 16), (1, 40)])
def test_near_copies_around_the_threshold(spark, monkeypatch, rounds, chunk):
    """Stars, pairs inside tasks and chunks of long lists find the same links, none is lost."""
    monkeypatch.setattr(near_dups, "ROUNDS", rounds)
    monkeypatch.setattr(near_dups, "CHUNK", chunk)
    rows = _near_copies(7, 130)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    want = _brute(rows, 2)
    assert 3 < sum(k for *_, k in want) < len(rows) - 100
    assert sorted((tuple(r) for r in got), key=str) == want


def test_odd_rows(odd_docs, empty_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = near_duplicates(odd_docs, words=2).collect()
    want = [(d, n, c, k or d is None) for d, n, c, k in _brute(rows, 2)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    left = without_duplicates(odd_docs)
    assert left.columns == odd_docs.columns and left.where("doc_id = 1").count() == 1 and left.count() == odd_docs.count() - 1
    assert near_duplicates(empty_docs).count() == 0 and without_duplicates(empty_docs).count() == 0
    assert len(shingle_hashes("a b", 5)) == 1 and len(shingle_hashes(" ", 2)) == 0


def test_values_leave_a_block_once():
    """However many classes of a block hold a value; copies that stand for no class don't count. Answers come in the block's order."""
    docs = pa.table({"rid": [1, 2, 3, 4], "n_shingles": [2, 2, 1, 2], "sketch": pa.array([[5, 9], [5, 12], [5], [5, 9]], pa.list_(pa.int64()))})
    asked = near_dups._ask(160, 4)((pa.scalar(7),), docs, pa.table({"cid": [1, 2, 3]}))
    got = {r["part"]: (np.frombuffer(r["held"], np.int64).tolist(), np.frombuffer(r["counts"], np.uint32).tolist()) for r in asked.to_pylist()}
    assert got == {0: ([12], [1]), 1: ([5, 9], [3, 1])}
    other = pa.table({"part": [1], "block": [8], "held": [np.array([9, 13]).tobytes()], "counts": [np.array([1, 1], np.uint32).tobytes()]})
    told = near_dups._tell((pa.scalar(1),), pa.concat_tables([asked.filter(pc.equal(asked["part"], 1)), other.cast(asked.schema)]))
    assert {r["block"]: np.frombuffer(r["dfs"], np.uint32).tolist() for r in told.to_pylist()} == {7: [3, 2], 8: [2, 1]}


def test_lists_hold_the_rarest_shared_values(spark):
    """Of sets of up to K shingles each class lists its size - T + 1 rarest values, less those that it holds alone."""
    rows = _near_copies(3, 12)
    docs = spark.createDataFrame([(d, d, t) for d, t in rows] + [(1000 + d, d, t) for d, t in rows[:5]], "rid long, doc_id long, text string")
    sketched = map_rows(docs, near_dups._sketch, near_dups.SKETCHES, 2, 160, False).select("*", near_dups._block("rid", 3))
    classes = docs.where("rid < 1000").select(F.col("rid").alias("cid"))
    got = Counter((r.cid, r.side) for r in near_dups.listed(sketched, classes, 3, 80, 160).collect())
    sketches = {d: shingle_hashes(t, 2) for d, t in rows}
    df = Counter(v for s in sketches.values() for v in s[:160].tolist())
    want = Counter()
    for d, s in sketches.items():
        shared = sum(df[v] > 1 for v in s[:160].tolist())
        lone = min(len(s), 160) - shared
        for b, most in near_dups.partner_bands(len(s), 80, 160):
            mine = near_dups.band(len(s))
            want[d, 0 if b == mine else 1 if mine < b else 2] += min(shared, max(0, most - lone))
    assert got == +want and sum(got.values())


def test_pairs_of_an_earlier_list_are_left_out_at_once(monkeypatch):
    """A pair is only compared in the first list in which it meets, of the same kind of bands."""
    compared = []
    monkeypatch.setattr(near_dups._Part, "near", lambda self, i, j: compared.append((int(self.cid[i]), int(self.cid[j]))) or True)
    lists = [[2, 3, 8], [2, 8], [3, 8], [8]]  # 8 is this list; 2 is of its kind, 3 is for two bands
    n, one = len(lists), list(range(200))
    longs = pa.list_(pa.int64())
    rows = pa.table({
        "part": [1] * n, "value": [8] * n, "cid": list(range(n)), "root": list(range(n)), "side": [0] * n, "chunk": [0] * n, "n_shingles": [200] * n,
        "sketch": pa.array([one[:160]] * n, longs), "lists": pa.array(lists, longs),
    }).to_batches()[0]
    found = {(a, b) for _, a, b in near_dups._Part(rows, 80, 160).pairs()}
    assert found == set(compared) == {(0, 2), (0, 3), (1, 2), (1, 3), (2, 3)}
