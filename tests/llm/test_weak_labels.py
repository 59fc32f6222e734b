import math

import numpy as np

from tidemill.llm.weak_labels import EPOCHS, KEEP, LABELLERS, LabelModel, facts_of, features, fit_labels, votes_of, weak_quality


def test_em_recovers_accuracies():
    rng = np.random.default_rng(3)
    k = len(LABELLERS)
    right, speaks, n = np.linspace(0.75, 0.97, k), np.linspace(0.9, 0.5, k), 40_000
    truth = rng.random(n) < 0.7
    votes = np.where(rng.random((n, k)) < speaks, np.where(rng.random((n, k)) < right, truth[:, None], ~truth[:, None]).astype(int), 2)
    names, counts = np.unique(["".join(map(str, v)) for v in votes], return_counts=True)
    model = fit_labels(dict(zip(names.tolist(), counts.tolist())))
    assert abs(model.prior - 0.7) < 0.03 and np.abs(model.accuracy() - right).max() < 0.03
    one = "1" * k
    logs = [np.log(p) + sum(np.log(model.shares[j, y, 1]) for j in range(k)) for y, p in ((0, 1 - model.prior), (1, model.prior))]
    assert abs(model.posterior(one) - 1 / (1 + np.exp(logs[0] - logs[1]))) < 1e-9
    assert isinstance(fit_labels({}), LabelModel)


def test_held_out_accuracy(spark):
    """Labels of the table were never used."""
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in weak_quality(spark.read.parquet(f"{sf}/documents.parquet"), sample=3000).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good, bad = [x for x in labels if x.quality], [x for x in labels if not x.quality]
    assert sum(rows[x.doc_id].kept for x in good) / len(good) > 0.995
    assert sum(not rows[x.doc_id].kept for x in bad) / len(bad) > 0.97
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in rows.values())


def test_odd_rows(odd_docs, empty_docs):
    rows = weak_quality(odd_docs).collect()
    assert len(rows) == odd_docs.count() and weak_quality(empty_docs).count() == 0
    assert not any(r.kept for r in rows if r.doc_id in (2, 3, 4))
    assert votes_of(facts_of("")[0])[-1] == "2"


def _em_by_hand(votes):
    """Posterior of the good class for each document, by EM in plain loops over documents."""
    k, n = len(votes[0]), len(votes)
    q = []
    for v in votes:
        good, bad = v.count("1"), v.count("0")
        start = (good + 0.5) / (good + bad + 1) if good + bad else 0.5
        q.append(min(start, 0.3) if bad else max(start, 0.7))
    for _ in range(100):
        prior = (sum(q) + 1) / (n + 2)
        share = {}
        for j in range(k):
            for y in "01":
                weigh = [(p if y == "1" else 1 - p) for p in q]
                times = {c: 1 + sum(w for w, v in zip(weigh, votes) if v[j] == c) for c in "01"}
                for c in "01":
                    share[j, y, c] = times[c] / (times["0"] + times["1"])
        now = []
        for v in votes:
            odds = {y: (prior if y == "1" else 1 - prior) * math.prod(share[j, y, c] for j, c in enumerate(v) if c != "2") for y in "01"}
            now.append(odds["1"] / (odds["0"] + odds["1"]))
        change = max(abs(a - b) for a, b in zip(now, q))
        q = now
        if change < 1e-9:
            break
    return q


def _scores_by_hand(rows, targets):
    """Scores of a logistic regression by mini-batch AdaGrad, weight by weight in dictionaries; the bias is weight None."""
    n, good = len(rows), min(max(sum(targets), 1.0), max(len(targets) - 1.0, 1.0))
    w, squares, order = {}, {}, np.random.default_rng(7)
    raw = lambda x: sum(v * w.get(i, 0.0) for i, v in x.items()) + w.get(None, 0.0)
    share = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    for _ in range(EPOCHS):
        for batch in np.array_split(order.permutation(n), max(1, n // 64)):
            grad = {i: 1e-6 * v for i, v in w.items()}
            for i in batch.tolist():
                y = targets[i]
                heavy = y * n / (2 * good) + (1 - y) * n / (2 * max(1.0, n - good))
                slip = (share(raw(rows[i])) - y) * heavy / len(batch)
                for key, v in [*rows[i].items(), (None, 1.0)]:
                    grad[key] = grad.get(key, 0.0) + slip * v
            for key, g in grad.items():
                squares[key] = squares.get(key, 1e-6) + g * g
                w[key] = w.get(key, 0.0) - 0.4 * g / math.sqrt(squares[key])
    return [share(raw(x)) for x in rows]


def test_against_em_and_scorer_by_hand(spark):
    """Production parameters over a whole small table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    found = [facts_of(r.text or "") for r in docs.collect()]
    votes = [votes_of(f) for f, _ in found]
    want = _em_by_hand(votes)
    rows = [dict(zip(at.tolist(), x.tolist())) for at, x in (features(f, c) for f, c in found)]
    scores = _scores_by_hand(rows, want)
    got = weak_quality(docs).collect()
    assert [r.votes for r in got] == votes
    for r, p, s, (f, _) in zip(got, want, scores, found):
        assert abs(r.posterior - (p if f.words else 0)) < 1e-6 and abs(r.score - (s if f.words else 0)) < 1e-5
        assert r.kept == (bool(f.words) and r.score >= KEEP)
