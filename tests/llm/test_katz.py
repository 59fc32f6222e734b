import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemill.llm.katz import CUTOFF, END, START, Stats, distinct, good_turing, joined, katz, katz_scores, pack, rounded, unpack, unpack_keys


def discounts_by_hand(of_counts, least=1):
    """Katz's ratios over the weighted line through log counts of counts (numpy's own fit), or half a count off."""
    known = [(r, n) for r, n in enumerate(of_counts, 1) if n]
    slope = np.polyfit(*np.log(np.array(known, float)).T, 1, w=np.sqrt([n for _, n in known]))[0] if len(known) > 1 else 0
    out = [0.0] * least
    for r in range(least, CUTOFF + 1):
        if slope < -1.02:
            size = lambda c: c**slope
            top = (CUTOFF + 1) * size(CUTOFF + 1) / size(1)
            out.append(((r + 1) * size(r + 1) / (r * size(r)) - top) / (1 - top))
        else:
            out.append((r - 0.5) / r)
    return [*out, 1.0]


def test_discounted_counts_rise_with_counts():
    odd = [[1000, 400, 100, 900, 30, 20], [50_000, 9000, 4000, 2000, 1500, 900], [3, 1, 0, 2, 0, 1], [10, 0, 0, 0, 0, 1], [0, 0, 7, 3, 1, 0]]  # copies of texts make many counts of 4
    for of_counts in odd:
        d = good_turing(of_counts)
        assert np.allclose(d, discounts_by_hand(of_counts))
        held = [r * d[r] for r in range(1, CUTOFF + 2)]
        assert all(a < b for a, b in zip(held, held[1:])) and all(0 < x < 1 for x in d[1 : CUTOFF + 1])
    with pytest.warns(UserWarning, match="half a count"):
        assert good_turing([1, 5, 9, 30, 60, 99])[1] == 0.5
    assert good_turing([9, 3, 1, 0, 0, 0], 2)[1] == 0


class Brute:
    """A dictionary version."""

    def __init__(self, texts, order, least):
        self.order, self.kept, self.d, self.context = order, {}, {}, {}
        grams = [Counter() for _ in range(order + 1)]
        for t in texts:
            w = ["<s>", *t, "</s>"]
            for n in range(1, order + 1):
                for i in range(max(1, n - 1), len(w)):
                    grams[n][tuple(w[i - n + 1 : i + 1])] += 1
            grams[1][("<s>",)] += 1
        starts = grams[1].pop(("<s>",), 0)
        self.n, self.vocabulary = sum(grams[1].values()), {k[0] for k in grams[1]}
        for n in range(1, order + 1):
            low = least[n - 1]
            self.d[n] = discounts_by_hand([sum(c == r for c in grams[n].values()) for r in range(1, CUTOFF + 2)], low)
            self.kept[n] = {k: c for k, c in grams[n].items() if c >= low}
        self.totals = {**grams[1], ("<s>",): starts}
        for n in range(2, order):
            self.totals |= self.kept[n]
        mass = sum(c * self.d[1][min(c, CUTOFF + 1)] for c in grams[1].values()) / self.n if self.n else 0.0
        self.scale1, self.unknown = (1.0, 1 - mass) if 1 - mass > 1e-9 else (self.n / (self.n + 1), 1 / (self.n + 1))
        self.counts = grams[1]
        self.after = {n: defaultdict(list) for n in range(2, order + 1)}
        for n in range(2, order + 1):
            for k in self.kept[n]:
                self.after[n][k[:-1]].append(k)
            for ctx, ks in self.after[n].items():
                total = self.totals[ctx]
                mass = sum(self.share(k) for k in ks) / total
                low = sum(self.p(k[1:]) for k in ks)
                scale, left = (total / (total + 1), 1 / (total + 1)) if mass > 1 - 1e-9 else (1.0, 1 - mass)
                if 1 - low <= 1e-12:
                    self.context[ctx] = 0.0, 1 / mass
                else:
                    self.context[ctx] = left / (1 - low), scale

    def share(self, k):
        c = self.kept[len(k)][k]
        return c * self.d[len(k)][min(c, CUTOFF + 1)]

    def p(self, k):
        if len(k) == 1:
            return self.share(k) / self.n * self.scale1 if k in self.kept[1] else self.unknown
        alpha, scale = self.context.get(k[:-1], (1.0, 1.0))
        return self.share(k) / self.totals[k[:-1]] * scale if k in self.kept[len(k)] else alpha * self.p(k[1:])

    def score(self, t):
        w = ["<s>", *t, "</s>"]
        return sum(math.log10(self.p(tuple(w[max(0, i - self.order + 1) : i + 1]))) for i in range(1, len(w)))


def _docs(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        size = int(rng.integers(0, 60))
        out.append((i, " ".join(words[min(399, int(x))] for x in rng.pareto(0.7, size) * 3)))
    return out


@pytest.mark.parametrize("order,least", ((3, (1, 1, 2)), (2, (1, 1)), (3, (1, 1, 1))))
def test_against_dictionaries(spark, order, least):
    docs = _docs(order, 120)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    split = {i: t.lower().split() for i, t in docs}
    brute = Brute([split[i] for i, _ in docs if not held[i]], order, least)
    rows = katz_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), order=order, min_counts=least, block=300, bucket=500).collect()
    assert len(rows) == len(docs)
    v = len(brute.vocabulary)
    for r in rows:
        t = [*split[r.doc_id], "</s>"]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(t), brute.n)
        assert r.n_known == sum(w in brute.vocabulary for w in t)
        assert abs(r.base_score - sum(math.log10((brute.counts.get((w,), 0) + 0.5) / (brute.n + 0.5 * (v + 1))) for w in t)) < 1e-6
        assert abs(r.score - brute.score(split[r.doc_id])) < 1e-6
    # normalised after any context
    for ctx in [*list(brute.after[order])[:40], ("w0",) * (order - 1), ("never",) * (order - 1)]:
        whole = sum(brute.p((*ctx, w)) for w in [*brute.vocabulary, "unknown"])
        assert abs(whole - 1) < 1e-9, ctx


def test_stored_model_against_dictionaries(spark):
    """Keys, counts, alphas and scales as stored, each n-gram once."""
    docs = _docs(7, 80)
    brute = Brute([t.lower().split() for _, t in docs], 3, (1, 1, 1))
    model = katz(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), F.lit(False), block=300, bucket=500)
    stored = {(r.step, r.bucket): r for t in model.tables for r in t.where("model").collect()}
    assert len({b for _, b in stored}) > 1
    word = lambda w: {"<s>": START, "</s>": END}.get(w) or np.uint64(xxhash.xxh3_64_intdigest(w.encode()))

    def key(gram):
        out = np.array([word(gram[0])])
        for w in gram[1:]:
            out = joined(out, np.array([word(w)]))
        return int(out[0])

    for n in (1, 2, 3):
        counts, weights = {}, {}
        for (step, bucket), r in stored.items():
            if step == 2 * n - 1:
                keys = unpack_keys(r.keys).tolist()
                assert not counts.keys() & set(keys) and keys == sorted(keys)
                counts |= dict(zip(keys, unpack(r.a, np.int64).tolist()))
                if n < 3:
                    w = stored[(2 * n, bucket)]
                    weights |= dict(zip(keys, zip(unpack(w.a, np.float64).tolist(), unpack(w.b, np.float64).tolist(), strict=True), strict=True))
        want = {**brute.kept[n], **({("<s>",): brute.totals[("<s>",)]} if n == 1 else {})}
        assert counts == {key(g): c for g, c in want.items()}
        for g in want if n < 3 else ():
            assert np.allclose(weights[key(g)], brute.context.get(g, (1.0, 1.0)), rtol=1e-9, atol=0), g


def test_small_parts():
    x = np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64)
    values, at, which = distinct(x)
    assert (values == np.unique(x)).all() and (x[at] == values).all() and (values[which] == x).all()
    assert [len(a) for a in distinct(x[:0])] == [0, 0, 0]
    y = np.random.default_rng(2).lognormal(0, 5, 1000)
    assert np.allclose(rounded(y), y, rtol=2**-36, atol=0) and rounded(np.array([1.0, 0.0])).tolist() == [1.0, 0.0]


def test_contexts_must_be_kept(spark):
    with pytest.raises(ValueError, match="min_counts"):
        katz_scores(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), min_counts=(1, 2, 1))


def test_blocks_are_not_shuffled(spark):
    docs = spark.createDataFrame(_docs(3, 30), "doc_id long, text string")
    plan = katz(docs, F.lit(False), order=2).scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # only the answers move


def test_contexts_stay_where_they_were_counted(spark):
    """Weights meet the places of contexts without moving them, blocks get none; the highest order is counted in ranges of buckets; own n-grams are told in bits."""
    docs = spark.createDataFrame(_docs(9, 80), "doc_id long, text string").repartition(3)
    tables = katz(docs, F.lit(False), block=300, bucket=500).tables
    step = lambda t: {r.step for r in t.select("step").distinct().collect()}
    below = next(t for t in tables if step(t) == {3})
    assert "Exchange" not in below.groupBy("bucket").count()._jdf.queryExecution().executedPlan().toString()
    for r in below.where("not model").collect():
        assert len(r.b) <= 4 + -(-len(unpack(r.a, np.int64)) // 8) and len(unpack_keys(r["keys"])) == len(unpack(r.a, np.int64))
    ranges = [{r.bucket for r in t.select("bucket").distinct().collect()} for t in tables if step(t) == {5}]
    assert len(ranges) == 2 and max(ranges[0]) < min(ranges[1])


def test_masses_are_sums_of_shares():
    rng = np.random.default_rng(5)
    stats, which, counts = Stats(2, [9, 3, 1, 1, 1, 1], discounts=good_turing([900, 300, 100, 50, 30, 20])), rng.integers(0, 40, 3000), rng.integers(1, 12, 3000)
    got = stats.mass(which, counts, 50)
    assert np.allclose(got, np.bincount(which, stats.share(counts), 50)) and (got[40:] == 0).all()
    order = rng.permutation(3000)
    assert (stats.mass(which[order], counts[order], 50) == got).all()
    bits = rng.integers(0, 2, 77).astype(bool)
    assert (unpack(pack(bits), np.bool_) == bits).all() and len(unpack(pack(bits[:0]), np.bool_)) == 0


def test_better_than_unigrams_on_held_out_texts(spark):
    rows = [r for r in katz_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.9 * sum(r.base_score for r in rows) and len(rows) > 100


def test_odd_rows(odd_docs, empty_docs):
    rows = katz_scores(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.score <= 0 and math.isfinite(r.score) for r in rows)
    assert katz_scores(empty_docs).count() == 0
    assert {r.score for r in katz_scores(odd_docs.where("doc_id is not null"), folds=1, fold=0).collect()} == {0.0}


def test_registered_query_keeps_trigrams_seen_once(spark):
    from tidemill.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    brute = Brute([(t or "").encode().lower().split() for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1], 3, (1, 1, 1))
    assert any(c == 1 for c in brute.kept[3].values())
    want = {i: brute.score((t or "").encode().lower().split()) for i, t in docs}
    got = {r.doc_id: r.score for r in QUERIES["op1_katz_scores"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 * max(1, -want[i]) for i in want)
