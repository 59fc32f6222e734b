"""Whitening of embeddings.

Every task keeps count, mean and scatter of its vectors by Welford's rank-one updates; the states, one a
task, are merged by the parallel update formula in a tree of tasks, and at most FAN_IN of them on the driver. The covariance there,
whose size is that of a vector squared, is reduced to three diagonals by Householder reflections and solved by the symmetric QR iteration with Wilkinson's shifts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemill.llm.common import exact, map_rows

STEPS, COMPONENTS, FAN_IN = 64, 32, 32

STATE = "task int, dim int, n long, mean binary, scatter binary, sums array<string>"
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Moments:
    """Count, mean, scatter about the mean, and exact whole-number sums (where vectors are whole numbers)."""

    def __init__(self, dim: int):
        self.n, self.mean, self.scatter, self.sums = 0, np.zeros(dim), np.zeros((dim, dim)), [0] * dim

    def add(self, x: np.ndarray) -> None:
        """Welford's update: the scatter grows by one matrix of rank one."""
        self.n += 1
        before = x - self.mean
        self.mean += before / self.n
        self.scatter += np.multiply.outer(before, x - self.mean)

    def merge(self, other: Moments) -> None:
        """The parallel update formula."""
        n = self.n + other.n
        apart = other.mean - self.mean
        self.scatter += other.scatter + np.multiply.outer(apart, apart) * (self.n * other.n / n)
        self.mean += apart * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums)]

    def row(self, task: int) -> tuple:
        return task, len(self.mean), self.n, self.mean.tobytes(), self.scatter.tobytes(), [str(x) for x in self.sums]

    @classmethod
    def of(cls, dim: int, n: int, mean: bytes, scatter: bytes, sums: list[str]) -> Moments:
        out = cls(dim)
        out.n, out.mean, out.scatter, out.sums = n, np.frombuffer(mean).copy(), np.frombuffer(scatter).reshape(dim, dim).copy(), [int(x) for x in sums]
        return out


def _merged(rows: Iterable[tuple]) -> dict[int, Moments]:
    """States by dimension."""
    by: dict[int, Moments] = {}
    for _, dim, *rest in rows:
        state = Moments.of(dim, *rest)
        if dim in by:
            by[dim].merge(state)
        else:
            by[dim] = state
    return by


def _collected(states: DataFrame, tasks: int) -> dict[int, Moments]:
    """States merged in rounds of FAN_IN, in an order that doesn't depend on which task ends first."""
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        states = states.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).repartition(tasks, "task").sortWithinPartitions("task", "dim", "n", "mean")
        states = map_rows(states, lambda: _by_task, STATE)
    return _merged(sorted((tuple(r) for r in states.collect()), key=lambda r: (r[0], r[1], bytes(r[3]))))


def _by_task(rows):
    """Merges the states of each task number."""
    now, held = None, []
    for r in rows:
        if r[0] != now and held:
            yield from (m.row(now) for m in _merged(held).values())
            held = []
        now = r[0]
        held.append(r)
    if held:
        yield from (m.row(now) for m in _merged(held).values())


def whole(x: np.ndarray) -> np.ndarray:
    """floor(STEPS x) as doubles, held within a long. Moving all x by 1,000,000 changes no result, so it is left out."""
    return np.clip(np.floor(STEPS * x), -(2.0**63), 2.0**63 - 1024)


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, vector) of a batch."""
    lists = batch.column("embedding")
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    for i in range(len(lists)):
        yield i, values[ends[i] : ends[i + 1]]


def moments(vectors: DataFrame, project=None) -> dict[int, Moments]:
    """Moments by dimension of floor(STEPS x), or of project(that) if given."""
    arrow = to_arrow_schema(StructType.fromDDL(STATE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        by: dict[int, Moments] = {}
        for batch in batches:
            sums: dict[int, list[int]] = {}
            for _, c in _vectors(batch):
                x = whole(c)
                if project is not None and (x := project(x)) is None:
                    continue
                state = by.get(len(x)) or by.setdefault(len(x), Moments(len(x)))
                state.add(x)
                if project is None:
                    sums.setdefault(len(x), []).append(x)
            for dim, xs in sums.items():
                held = np.array(xs)
                total = held.astype(np.int64).sum(0).tolist() if np.abs(held).max() * len(held) < 2.0**62 else [sum(map(int, col)) for col in held.T]
                by[dim].sums = [a + b for a, b in zip(by[dim].sums, total)]
        for state in by.values():
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(state.row(TaskContext.get().partitionId()), arrow)], schema=arrow)

    return _collected(vectors.select("embedding").mapInArrow(run, STATE), vectors.rdd.getNumPartitions())


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows of a symmetric matrix."""
    a, n = np.array(a, float), len(a)
    q, eps = np.eye(n), np.finfo(float).eps  # rows turn with each reflection and rotation
    none = eps * eps * np.abs(a).max(initial=0)  # far below rounding: counts as 0, so that nothing underflows
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        if np.abs(v[1:]).max() <= none:
            continue
        v /= np.abs(v).max()
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.multiply.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.multiply.outer(a[k:, k + 1 :] @ v, v)
        q[k + 1 :] -= 2 * np.multiply.outer(v, v @ q[k + 1 :])
    d, e = np.diag(a).tolist(), np.diag(a, -1).tolist()
    hi = n - 1
    while hi > 0:
        lo = hi
        while lo > 0 and abs(e[lo - 1]) > max(none, eps * (abs(d[lo - 1]) + abs(d[lo]))):
            lo -= 1
        if lo > 0:
            e[lo - 1] = 0.0
        if lo == hi:
            hi -= 1
            continue
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + math.copysign(math.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            if r == 0:
                break
            c, s = x / r, z / r
            if k > lo:
                e[k - 1] = r
            p, u, f = d[k], d[k + 1], e[k]
            d[k], d[k + 1], e[k] = c * c * p + 2 * c * s * f + s * s * u, s * s * p - 2 * c * s * f + c * c * u, c * s * (u - p) + (c * c - s * s) * f
            x = e[k]
            if k + 1 < hi:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-np.array(d), kind="stable")
    return np.array(d)[order], q[order]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """n x - S of each row, as doubles, and its squared length as an exact whole number (None beyond a long)."""
    if n * np.abs(x).max(initial=0) + max(map(abs, sums)) < 2.0**62:
        d = n * x.astype(np.int64) - np.array(sums, np.int64)
        if float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2.0**62:
            return d.astype(float), (d * d).sum(1).tolist()
        d = d.astype(object)
    else:
        d = np.array([[n * int(v) - s for v, s in zip(row, sums)] for row in x], object).reshape(x.shape)
    square = (d * d).sum(1).tolist()
    return d.astype(float), [s if s < 1 << 63 else None for s in square]


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles): rows whose vector is there, has entries, and only finite ones."""
    e = exact(embeddings)
    rows = e.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & good)


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Rows of WHITENED: each usable vector's values on the `components` strongest principal components, at unit variance.

    A vector c counts as x = floor(64 c) + 1,000,000, in whole numbers. n: vectors; deviation: squared length of n x - S,
    S being the sums (null if it exceeds a long); whitened: x - S/n on the component, over the root of its eigenvalue; explained: the eigenvalue's share
    of the trace; identity_error: how far the covariance of all whitened values, measured in a pass of its own, is from one.

    Null vectors and those with null, infinite or no entries go. If lengths differ, the most frequent one counts (of equally
    frequent ones the longer) and other vectors go. Components whose eigenvalue can't be told from 0 (equal vectors, fewer
    vectors than entries) are left out, so vectors all equal, one vector or an empty table give no rows. Repeated rows, null and repeated vec_ids stay.
    Entries beyond a long once multiplied count as the largest long. Other columns are left behind; of names that differ only in case the lower-case one counts.
    Three passes over the table; only states are shuffled.
    """
    rows = usable(embeddings)
    by = moments(rows)
    empty = rows.sparkSession.createDataFrame([], WHITENED)
    if not by:
        return empty
    m = max(by.values(), key=lambda m: (m.n, len(m.mean)))
    dim, n, sums = len(m.mean), m.n, m.sums
    cov = (m.scatter + m.scatter.T) / (2 * n)
    values, axes = symmetric_qr(cov)
    keep = int((values[:components] > max(dim * np.finfo(float).eps * abs(values[0]), 0)).sum())
    if not keep:
        return empty
    share, scale = values[:keep] / np.trace(cov), (axes[:keep] / np.sqrt(values[:keep])[:, None]).T

    def project(x: np.ndarray) -> np.ndarray | None:
        return (_deviations(x[None], n, sums)[0] / n @ scale)[0] if len(x) == dim else None

    second = moments(rows, project)[keep]
    error = float(np.abs(second.scatter / n - np.eye(keep)).max())
    arrow = to_arrow_schema(StructType.fromDDL(WHITENED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(i, c) for i, c in _vectors(batch) if len(c) == dim]
            if not own:
                continue
            d, square = _deviations(np.array([whole(c) for _, c in own]), n, sums)
            many, ids = len(own), batch.column("vec_id").take(pa.array([i for i, _ in own]))
            row = np.repeat(np.arange(many), keep)
            cols = [ids.take(pa.array(row)), np.tile(np.arange(1, keep + 1, dtype=np.int32), many), np.full(many * keep, n), pa.array(square, pa.int64()).take(pa.array(row)),
                    (d / n @ scale).ravel(), np.tile(share, many), np.full(many * keep, error)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(cols, arrow)], schema=arrow)

    return rows.mapInArrow(run, WHITENED)
