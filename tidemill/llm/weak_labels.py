"""Quality by weak labels: heuristic labellers, expectation-maximisation, a hashed linear scorer.

Each labeller votes good (1), bad (0) or not at all on a text. Texts with equal votes are
alike to the label model, so it is fitted on counts of vote patterns (3 to
the power of the labellers, however many documents there are): EM over a
two-class model in which labellers vote independently given the class gives
each labeller's accuracies and each pattern's posterior. Posteriors label a bounded
sample of documents, on which a logistic scorer over hashed features is trained;
it scores every document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import map_rows, texts_of

#: Documents that the scorer is trained on, about (chosen by a hash of doc_id), and hashed features.
SAMPLE, DIMENSIONS, EPOCHS, KEEP = 20_000, 1 << 14, 6, 0.5
BAD, GOOD, NONE = 0, 1, 2
#: Marks that prose uses seldom, and ends of sentences.
MARKS, ENDS = "#*$%&|<>{}[]=~^_\\", ".!?:;\"'”’…)"
_PLAIN = re.compile(r"[(\"'“‘«]*[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?…)\"'”’»]?")
_DOUBLED = re.compile(r"[^\w\s]{2}")
_RUN = re.compile(r"(.)\1+")
_SHAPE = {**{i: "A" for i in range(65, 91)}, **{i: "a" for i in range(97, 123)}, **{i: "A" for i in range(0xC0, 0xDF)}, **{i: "a" for i in range(0xDF, 0x100)}, **{i: "0" for i in range(48, 58)}}


@dataclass
class Facts:
    """What the labellers look at: shares of words, but for words (their number), ended (a share of lines) and fresh."""

    words: int
    marks: float
    plain: float
    doubled: float
    capitals: float
    lower: float  # lower case, or its first letter alone isn't
    repeats: float
    pairs: float
    fresh: float
    ended: float


def facts_of(text: str) -> tuple[Facts, Counter]:
    words = text.split()
    n = len(words)
    counts = Counter(words)
    plain = doubled = capitals = lower = 0
    for w, c in counts.items():
        if w.isalpha():
            plain += c
            if w.islower() or w[1:].islower():
                lower += c
            elif len(w) > 1 and w.isupper():
                capitals += c
            continue
        plain += c * (_PLAIN.fullmatch(w) is not None)
        doubled += c * (_DOUBLED.search(w) is not None)
        lower += c * (w.islower() or w[1:].islower())
        capitals += c * (len(w) > 1 and w.isupper())
    lines = [x.rstrip() for x in text.split("\n") if x.strip()]
    some, two = max(1, n), max(1, n - 1)
    pairs = len(set(zip(words, words[1:])))
    found = Facts(
        n, sum(map(text.count, MARKS)) / some, plain / some, doubled / some, capitals / some, lower / some, sum(map(str.__eq__, words, words[1:])) / two,
        1 - pairs / two if n > 1 else 0.0, len(counts) / max(1.0, n / (1 + math.log1p(n) / 4)), sum(x[-1] in ENDS for x in lines) / max(1, len(lines)),
    )
    return found, counts


def _between(x: float, good: float, bad: float) -> int:
    """Good up to good, bad from bad on (or the other way round), no vote between."""
    if good < bad:
        return GOOD if x <= good else BAD if x >= bad else NONE
    return GOOD if x >= good else BAD if x <= bad else NONE


#: Fewer words tell most labellers nothing.
FEW = 12
#: Name and vote of each labeller. They overlap: each fault that one sees, another one sees as well.
LABELLERS = (
    ("marks", lambda f: _between(f.marks, 0.05, 0.2)),
    ("plain_words", lambda f: NONE if f.words < FEW else _between(f.plain, 0.85, 0.65)),
    ("doubled_marks", lambda f: NONE if f.words < FEW else _between(f.doubled, 0.05, 0.25)),
    ("capitals", lambda f: _between(f.capitals, 0.08, 0.4)),
    ("lower_case", lambda f: NONE if f.words < FEW else _between(f.lower, 0.6, 0.4)),
    ("repeats", lambda f: _between(f.repeats, 0.03, 0.15)),
    ("pairs", lambda f: NONE if f.words < 20 else _between(f.pairs, 0.35, 0.6)),
    ("vocabulary", lambda f: NONE if f.words < 60 else _between(f.fresh, 0.5, 0.25)),
    ("line_ends", lambda f: NONE if f.words < FEW else _between(f.ended, 0.7, 0.2)),
)


def votes_of(f: Facts) -> str:
    """One character a labeller: 0, 1, or 2 for no vote."""
    return "".join(str(vote(f)) for _, vote in LABELLERS)


@dataclass
class LabelModel:
    """prior: of the good class. shares[j, y, v]: how often labeller j, where it votes, votes v (bad, good) on class y. No vote tells nothing."""

    prior: float
    shares: np.ndarray

    def posterior(self, votes: str) -> float:
        v = np.array([int(c) for c in votes])
        said = np.flatnonzero(v != NONE)
        logs = np.log(self.shares[said, :, v[said]]).sum(0) + np.log([1 - self.prior, self.prior])
        return float(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500))))

    def accuracy(self) -> np.ndarray:
        """Of each labeller, where it votes."""
        right = (1 - self.prior) * self.shares[:, 0, 0] + self.prior * self.shares[:, 1, 1]
        return right / (right + (1 - self.prior) * self.shares[:, 0, 1] + self.prior * self.shares[:, 1, 0])


def fit_labels(patterns: dict[str, int], rounds: int = 100) -> LabelModel:
    """EM from the share of good votes in each pattern; counts are smoothed by one vote of each kind."""
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    v = np.array([[int(c) for c in p] for p in names]).reshape(len(names), len(LABELLERS))
    good, bad = (v == GOOD).sum(1), (v == BAD).sum(1)
    q = np.where(good + bad > 0, (good + 0.5) / (good + bad + 1), 0.5)
    # one bad vote outweighs good ones at the start: faults differ, and each labeller sees one kind
    q = np.where(bad > 0, np.minimum(q, 0.3), np.maximum(q, 0.7))
    model = LabelModel(0.5, np.full((len(LABELLERS), 2, 2), 0.5))
    for _ in range(rounds):
        weight = np.stack([(1 - q) * n, q * n])
        prior = (weight[1].sum() + 1) / (n.sum() + 2)
        shares = np.ones((len(LABELLERS), 2, 2))
        for y in range(2):
            for k in range(2):
                shares[:, y, k] += (weight[y][:, None] * (v == k)).sum(0)
        shares /= shares.sum(2, keepdims=True)
        model = LabelModel(float(prior), shares)
        now = np.array([model.posterior(p) for p in names])
        if len(now) == 0 or np.abs(now - q).max() < 1e-9:
            break
        q = now
    return model


def features(f: Facts, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of unit length: words, their shapes, and steps of the facts."""
    out: dict[int, float] = {}
    shapes: Counter = Counter()
    for w, c in counts.items():
        h = zlib.crc32(w.lower().encode("utf-8", "replace")) % DIMENSIONS
        out[h] = out.get(h, 0.0) + 0.2 * math.log1p(c)
        shapes["a" if w.isalpha() and w.islower() else _RUN.sub(r"\1", w.translate(_SHAPE))] += c
    for w, c in shapes.items():
        h = zlib.crc32(b"shape " + w.encode("utf-8", "replace")) % DIMENSIONS
        out[h] = out.get(h, 0.0) + 2 * c / f.words * math.log1p(f.words)
    for name in ("marks", "plain", "doubled", "capitals", "lower", "repeats", "pairs", "fresh", "ended"):
        h = zlib.crc32(f"{name} {min(10, int(getattr(f, name) * 20))}".encode()) % DIMENSIONS
        out[h] = out.get(h, 0.0) + 2.0
    at, x = np.fromiter(out.keys(), np.int64, len(out)), np.fromiter(out.values(), np.float64, len(out))
    return at, x / max(1e-9, math.sqrt((x * x).sum()))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS, rate: float = 4.0, decay: float = 1e-6) -> np.ndarray:
    """Weights (the bias last) of logistic regression on soft labels, by mini-batches in a fixed order. Classes weigh alike."""
    w, total = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-6)
    labels = np.array([r[2] for r in rows])
    good = min(max(labels.sum(), 1.0), max(len(rows) - 1.0, 1.0))
    heavy = lambda y: y * len(rows) / (2 * good) + (1 - y) * len(rows) / (2 * max(1.0, len(rows) - good))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for batch in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 64)):
            grad = decay * w
            for i in batch:
                at, x, y = rows[i]
                slip = (1 / (1 + math.exp(-max(-30, min(30, float(x @ w[at]) + w[-1])))) - y) * heavy(y) / len(batch)
                grad[at] += slip * x
                grad[-1] += slip
            total += grad * grad
            w -= rate * 0.1 * grad / np.sqrt(total)
    return w


def _votes():
    def rows(docs: Iterable[tuple]) -> Iterator[tuple]:
        found: Counter = Counter()
        for (text,) in docs:
            found[votes_of(facts_of(text or "")[0])] += 1
        yield from found.items()

    return rows


def _sampled(posteriors: dict[str, float]):
    def rows(docs: Iterable[tuple]) -> Iterator[tuple]:
        for (text,) in docs:
            f, counts = facts_of(text or "")
            at, x = features(f, counts)
            yield at.tolist(), x.tolist(), posteriors[votes_of(f)]

    return rows


def _score(model):
    def rows(docs: Iterable[tuple]) -> Iterator[tuple]:
        posteriors, w, keep = model.value
        for doc_id, text in docs:
            f, counts = facts_of(text or "")
            at, x = features(f, counts)
            votes = votes_of(f)
            score = 1 / (1 + math.exp(-max(-30, min(30, float(x @ w[at]) + w[-1]))))
            if not f.words:
                yield doc_id, votes, 0.0, 0.0, False
                continue
            yield doc_id, votes, posteriors[votes], score, score >= keep

    return rows


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, dict[str, float], np.ndarray]:
    """The label model over all documents' votes, each pattern's posterior, and the scorer's weights from about `sample` documents."""
    texts = texts_of(docs)
    found = map_rows(texts.select("text"), _votes, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    patterns = {r["votes"]: int(r["n"]) for r in found}
    model = fit_labels(patterns)
    posteriors = {p: model.posterior(p) for p in patterns}
    total = max(1, sum(patterns.values()))
    chosen = texts if total <= sample else texts.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 32)) < int((1 << 32) * sample / total))
    rows = map_rows(chosen.select("text"), _sampled, "at array<int>, x array<double>, y double", posteriors).toLocalIterator()
    return model, posteriors, train([(np.array(r["at"], np.int64), np.array(r["x"]), r["y"]) for r in rows])


def weak_quality(docs: DataFrame, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """doc_id, votes, posterior (of the label model), score (of the linear scorer, 0 to 1) and kept (score at least `keep`).

    Null and empty texts have no words: their scores are 0. Repeated rows
    are scored alike; a null doc_id stays. An empty table gives no rows. A very long text is read whole. Other columns are left behind. No shuffle but of counts.
    """
    _, posteriors, w = fit(docs, sample)
    model = docs.sparkSession.sparkContext.broadcast((posteriors, w, keep))  # patterns and weights: fixed bounds
    return map_rows(texts_of(docs), _score, "doc_id long, votes string, posterior double, score double, kept boolean", model)
