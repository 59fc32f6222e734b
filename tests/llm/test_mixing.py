import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm.mixing import SEED, _draws, cut_words, mixed_counts, mixed_documents, odds, pass_key, permuted, targets


def test_permutations_and_odds():
    for n in (1, 2, 3, 5, 17, 256, 1000):
        assert sorted(permuted(np.arange(n), n, n * 7 + 1).tolist()) == list(range(n))
        assert permuted(permuted(np.arange(n), n, n + 5), n, n + 5, back=True).tolist() == list(range(n))
    assert permuted(np.arange(50), 50, 1).tolist() != permuted(np.arange(50), 50, 2).tolist()
    for size in (1, 5, 16, 17, 100, 1001):
        for target in (0, 0.5, 1, size * 0.7, size * 2):
            o = odds("0a", size, target, 16)
            assert (o.n_blocks - 1) * 16 + o.tail == size and 1 <= o.tail <= 16
            assert o.slots * size / o.n_blocks == pytest.approx(target)  # slots times the mean words of a block
    assert odds("0a", 0, 0.0, 16).slots == 0


def test_draws_by_shard():
    draw = lambda seed: list(_draws([700.2, 0.0, 37.0, 5.8], list("abcd"), 100, seed)(iter([(i,) for i in range(8)])))
    rows = draw(1)
    assert draw(1) == rows != draw(2)
    per, by = Counter(), Counter()
    for shard, key, n in rows:
        per[shard] += n
        by[key] += n
    assert sorted(per.values()) == [43] + [100] * 7 and not by["b"]
    assert len({n for _, key, n in rows if key == "a"}) > 1
    many = Counter()
    for seed in range(300):
        for _, key, n in draw(seed):
            many[key] += n / 300
    assert abs(many["c"] - 37) < 2 and abs(many["d"] - 5.8) < 0.8


def test_targets_stop_and_reshare():
    assert targets([100, 100, 100], [5, 2, 1]) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert targets([0, 10], [5, 2]) == [0.0, 15.0]
    assert sum(targets([7, 1000, 3, 50], [5, 2, 1, 5])) == pytest.approx(1.5 * 1060)
    assert targets([], []) == []


def test_mix_of_documents(spark, odd_docs, empty_docs):
    for docs, block in ((odd_docs, 16), (odd_docs, 4096)):
        rows = mixed_counts(docs, block=block).collect()
        assert rows == mixed_counts(docs, block=block).collect() or sorted(map(str, rows)) == sorted(map(str, mixed_counts(docs, block=block).collect()))
        want = defaultdict(int)
        base = docs.select("doc_id", "text", "source").collect()
        size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
        for r in base:
            want[r.source] += size(r.text)
        assert Counter((r.doc_id, r["size"], r.source_size) for r in rows) == Counter((r.doc_id, size(r.text), want[r.source]) for r in base)
        taken = defaultdict(int)
        for r in rows:
            assert 0 <= r.taken <= 2 * r["size"]
            taken[r.source_size, r.target] += r.taken
        for (size_, target), n in taken.items():
            assert n <= 2 * size_ and abs(n - target) <= 5 * (block * target) ** 0.5 + 2 * block
        out = mixed_documents(docs, block=block)
        assert out.columns == docs.columns
        drawn, by_id = Counter(), Counter()
        for r in out.collect():
            drawn[r.doc_id] += size(r.text)
        for r in rows:
            by_id[r.doc_id] += r.taken
        assert {k: v for k, v in drawn.items() if v} == {k: v for k, v in by_id.items() if v}
    assert mixed_counts(empty_docs).count() == 0 and mixed_documents(empty_docs).count() == 0


def _taken_by_hand(rows, block, seed, shard_slots):
    """(words, shards) of each place of row: every shard draws, and its slots walk the passes and blocks of each source's line of words one by one."""
    by_source = defaultdict(list)
    for i, (doc_id, size, source) in enumerate(rows):
        by_source["1" if source is None else "0" + source].append((doc_id, i, size))
    names = sorted(by_source)
    line = {s: [i for _, i, n in sorted(by_source[s]) for _ in range(n)] for s in names}
    goals = targets([len(line[s]) for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])
    blocks = [-(-len(line[s]) // block) for s in names]
    expected = [g * b / len(line[s]) if line[s] else 0 for s, g, b in zip(names, goals, blocks)]
    left, shard, used, taken, shards = round(sum(expected)), 0, Counter(), Counter(), defaultdict(set)
    while left > 0:
        drawn = np.random.default_rng([seed, shard]).multinomial(min(shard_slots, left), np.array(expected) / sum(expected))
        for s, n, count in zip(names, blocks, drawn):
            for _ in range(count):
                epoch, place = divmod(used[s], n)
                used[s] += 1
                if epoch < 2:
                    b = int(permuted(np.array([place]), n, pass_key(seed, s, epoch))[0])
                    for i in line[s][b * block : (b + 1) * block]:
                        taken[i] += 1
                        shards[i].add(shard)
        left, shard = left - shard_slots, shard + 1
    return taken, shards


def test_taken_against_slots_by_hand(spark):
    rnd = np.random.default_rng(3)
    rows = [(int(d), int(rnd.integers(0, 90)), [None, "a", "b", "c"][int(rnd.integers(0, 4))]) for d in rnd.permutation(120)]
    docs = spark.createDataFrame([(d, " ".join(["w"] * n), s) for d, n, s in rows], "doc_id long, text string, source string")
    seen = {}
    for block, shard_slots, seed in ((16, 4096, SEED), (7, 50, SEED), (7, 50, 5), (7, 9, 5)):
        got = {r.doc_id: (r.taken, r.first_shard, r.last_shard) for r in mixed_counts(docs, block=block, shard_slots=shard_slots, seed=seed).collect()}
        taken, shards = _taken_by_hand(rows, block, seed, shard_slots)
        assert got == {d: (taken[i], min(shards[i], default=None), max(shards[i], default=None)) for i, (d, _, _) in enumerate(rows)}
        seen[block, shard_slots, seed] = {d: n for d, (n, *_) in got.items()}
    assert seen[7, 50, SEED] != seen[7, 50, 5] != seen[7, 9, 5]  # the draw decides what is taken


def test_targets_are_met_within_the_draws_error(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(20 + id % 300 as int)) as text", "case when id % 20 = 0 then null else concat('s', id % 4) end as source")
    rows = mixed_counts(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("n"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    for r in rows:
        assert r.over <= 0 and abs(r.n - r.target) <= 4 * (32 * r.target) ** 0.5 + 64


def test_cut_words():
    t = " a  b\nc d "
    assert cut_words(t, [(0, 4)]) == t
    assert cut_words(t, [(1, 3)]) == "b\nc"
    assert cut_words(t, [(3, 4), (0, 1), (1, 2)]) == "a  b\nd"
