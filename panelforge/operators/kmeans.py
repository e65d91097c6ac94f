"""k-means over all rows for several numbers of clusters: a pass over the rows serves all of them.

Tasks add up what they have for each cluster and Spark adds up the tasks' sums, so a pass brings a row a cluster to the
driver. Nothing is drawn: the starts are the means of a tree of splits, each of the part with the most inertia, at its mean,
across its principal direction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most steps of a fit and the move of a center below which it ends: those of Spark's KMeans.
STEPS, TOLERANCE = 20, 1e-4
#: Rows that a task of a pass reads, where there are as many: each pass is a job, and a task's start costs as much as they do.
TASK_ROWS = 500_000


def _standard(batch: pa.RecordBatch, scale: list[tuple]) -> list[np.ndarray]:
    """The columns of a batch less their mean, by their deviation; constant columns become 0."""
    return [(batch.column(i).to_numpy(zero_copy_only=False) - m) / s if s else np.zeros(batch.num_rows) for i, (m, s) in enumerate(scale)]


def _squares(x: list[np.ndarray], center: np.ndarray) -> np.ndarray:
    return sum((c - v) ** 2 for c, v in zip(x, center, strict=True))


def _nearest(x: list[np.ndarray], centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest center, of equally near ones the first, and its squared distance."""
    best, at = _squares(x, centers[0]), np.zeros(len(x[0]), dtype=np.int64)
    for j in range(1, len(centers)):
        d = _squares(x, centers[j])
        at[d < best] = j
        best = np.minimum(best, d)
    return at, best


def _leaves(x: list[np.ndarray], splits: list[tuple]) -> np.ndarray:
    """The part of each row: a split (part, mean, direction) moves rows beyond the mean to a new part."""
    leaf = np.zeros(len(x[0]), dtype=np.int64)
    for new, (part, mean, direction) in enumerate(splits, 1):
        beyond = sum((c - m) * v for c, m, v in zip(x, mean, direction, strict=True)) > 0
        leaf[(leaf == part) & beyond] = new
    return leaf


def _by(groups: np.ndarray, n: int, values: Iterable[np.ndarray | None]) -> np.ndarray:
    """A row a group: the sums of values (None: the count)."""
    return np.stack([np.bincount(groups, v, n).astype(float) for v in values], 1)


def _cluster_sums(x: list[np.ndarray], centers: np.ndarray) -> np.ndarray:
    """For each center its rows, their summed squared distance and their sum."""
    at, best = _nearest(x, centers)
    return _by(at, len(centers), [None, best, *x])


def _scatter(x: list[np.ndarray], splits: list[tuple], means: np.ndarray) -> np.ndarray:
    """For each part the summed products of its rows' distances to its mean."""
    leaf = _leaves(x, splits)
    off = [c - means[leaf, i] for i, c in enumerate(x)]
    return _by(leaf, len(means), (a * b for a in off for b in off))


def _silhouettes(x: list[np.ndarray], centers: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The summed silhouette of rows by squared distance, from the sums of their clusters.

    The mean squared distance to a cluster's rows is that to their mean and their variance.
    """
    at, _ = _nearest(x, centers)
    own, other = np.zeros(len(at)), np.full(len(at), np.inf)
    for j, (n, cost, *total) in enumerate(found):
        if n:
            mean = np.array(total) / n
            d = _squares(x, mean) + max(0.0, cost / n - ((mean - centers[j]) ** 2).sum())
            mine = at == j
            own = np.where(mine, d * n / max(1.0, n - 1), own)
            other = np.where(mine, other, np.minimum(other, d))
    alone = found[at, 0] <= 1
    most = np.maximum(own, other)
    return np.array([[np.where(alone | (most == 0), 0.0, (other - own) / np.where(most == 0, 1.0, most)).sum()]])


def _sums(rows: DataFrame, scale: list[tuple], width: int, work: Callable) -> dict[int, dict[int, np.ndarray]]:
    """What work makes of the batches, added up: work gives a matrix (a row a member) for each of several groups."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, found in work(_standard(batch, scale)).items():
                total[g] = total[g] + found if g in total else found
        if total:
            group = np.repeat(list(total), [len(t) for t in total.values()]).astype(np.int32)
            member = np.concatenate([np.arange(len(t), dtype=np.int32) for t in total.values()])
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(member), *map(pa.array, np.concatenate(list(total.values())).T)], names=["g", "i", *names])

    names = [f"v{i}" for i in range(width)]
    parts = rows.mapInArrow(partial, ", ".join(["g int", "i int", *[f"{v} double" for v in names]]))
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in parts.groupBy("g", "i").agg(*[F.sum(v).alias(v) for v in names]).collect():
        out.setdefault(r["g"], {})[r["i"]] = np.array([r[v] for v in names])
    return {g: np.stack([members[i] for i in sorted(members)]) for g, members in out.items()}


def starts(rows: DataFrame, scale: list[tuple], k_max: int) -> dict[int, np.ndarray]:
    """Centers for each number of clusters up to k_max; fewer where the rows have fewer different values."""
    d = len(scale)
    splits: list[tuple] = []
    out = {}
    for k in range(1, k_max + 1):
        found = _sums(rows, scale, d + 1, lambda x: {0: _by(_leaves(x, splits), len(splits) + 1, [None, *x])})[0]
        means = found[:, 1:] / np.maximum(found[:, :1], 1.0)
        out[k] = means[found[:, 0] > 0]
        if k == k_max:
            break
        scatter = _sums(rows, scale, d * d, lambda x: {0: _scatter(x, splits, means)})[0].reshape(-1, d, d)
        part = int(np.argmax(np.trace(scatter, axis1=1, axis2=2)))
        if not np.trace(scatter[part]) > 0:
            return out | {more: out[k] for more in range(k + 1, k_max + 1)}
        direction = np.linalg.eigh(scatter[part])[1][:, -1]
        splits.append((part, means[part], direction * np.sign(direction[np.argmax(np.abs(direction))])))
    return out


def sweep(rows: DataFrame, n: int, scale: list[tuple], ks: list[int]) -> list[tuple]:
    """(k, silhouette, inertia, centers) for each k, of n rows of known numbers standardised by scale (mean, deviation)."""
    rows = rows.coalesce(-(-n // TASK_ROWS))
    begun = starts(rows, scale, max(ks))
    centers = {k: begun[k] for k in ks}
    width, moving = len(scale) + 2, list(ks)

    def clusters(of: list[int]) -> dict[int, np.ndarray]:
        now = {k: centers[k] for k in of}
        return _sums(rows, scale, width, lambda x: {k: _cluster_sums(x, c) for k, c in now.items()})

    for _ in range(STEPS):
        if not moving:
            break
        still = []
        for k, found in clusters(moving).items():
            held = found[:, :1]
            new = np.where(held > 0, found[:, 2:] / np.maximum(held, 1.0), centers[k])
            if ((new - centers[k]) ** 2).sum(1).max() > TOLERANCE**2:
                still.append(k)
            centers[k] = new
        moving = sorted(still)
    last = clusters(ks)
    several = [k for k in ks if (last[k][:, 0] > 0).sum() > 1]
    scores = _sums(rows, scale, 1, lambda x: {k: _silhouettes(x, centers[k], last[k]) for k in several}) if several else {}
    return [(k, float(scores[k][0, 0] / n) if k in scores else -1.0, float(last[k][:, 1].sum()), centers[k]) for k in ks]
