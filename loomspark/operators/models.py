"""Small models on bounded tables: principal axes, matching of centres, linkage order.

Their inputs are clusters, axes or stated samples. Sums over all rows stay in plans; what is left for Python is a
matrix with a row for each axis or cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def covariance(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population covariance, in one pass: each task adds up its rows' products as matrices and hands on a row for
    each axis, and an aggregate adds these; the driver gets a row for each axis. Rows with a null vector are left out."""
    known = df.where(F.col(vector).isNotNull()).select(V.doubles(F.col(vector)).alias("v"))
    width = known.select(F.max(F.size("v"))).first()[0] or 0

    def sums(batches):
        n, total, cross = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            n, total, cross = n + len(x), total + x.sum(axis=0), cross + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(total), pa.array(list(cross), pa.list_(pa.float64()))], names=["i", "n", "s", "c"])

    if not width:
        return np.zeros(0), np.zeros((0, 0))
    rows = known.mapInArrow(sums, "i int, n long, s double, c array<double>").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.array(*[F.sum(F.col("c")[j]) for j in range(width)]).alias("c")).orderBy("i").collect()
    mean = np.array([r["s"] / r["n"] for r in rows])
    return mean, np.array([r["c"] for r in rows]) / rows[0]["n"] - np.outer(mean, mean)


def principal_axes(df: DataFrame, key: str, vector: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """key, scores on the k axes of largest variance (each axis' largest weight positive), and the explained shares."""
    mean, cov = covariance(df, vector)
    values, axes = np.linalg.eigh(cov)
    top = np.argsort(values)[::-1][:k]
    axes = axes[:, top] * np.sign(axes[np.abs(axes[:, top]).argmax(axis=0), top])
    v = V.doubles(F.col(vector))
    score = lambda a: V.dot(v, F.array(*map(F.lit, map(float, a)))) - float(mean @ a)
    return df.select(key, F.array(*[score(axes[:, j]) for j in range(len(top))]).alias("scores")), [float(x / values.sum()) for x in values[top]]


def matched_centers(a: np.ndarray, b: np.ndarray) -> tuple[list[int], float]:
    """For each row of a the row of b in the assignment of least total distance (b has as many rows or more).

    Rows of a are added one at a time along a shortest path of reduced costs, so the work is cubic.
    """
    cost = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    n, m = cost.shape
    row_price, column_price, taken_by = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        reach, came_from, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        at, here, far = row, -1, 0.0
        while True:
            through = far + cost[at] - row_price[at] - column_price
            closer = ~done & (through < reach)
            reach[closer], came_from[closer] = through[closer], here
            here = int(np.where(done, np.inf, reach).argmin())
            far = reach[here]
            done[here] = True
            if taken_by[here] < 0:
                break
            at = int(taken_by[here])
        row_price[row] += far
        for j in np.flatnonzero(done):
            if taken_by[j] >= 0:
                row_price[taken_by[j]] += far - reach[j]
            column_price[j] -= far - reach[j]
        while here >= 0:  # shift the path by one
            before = int(came_from[here])
            taken_by[here] = taken_by[before] if before >= 0 else row
            here = before
    match = [int(np.flatnonzero(taken_by == k)[0]) for k in range(n)]
    return match, float(sum(cost[k, j] for k, j in enumerate(match)))


def leaf_order(x: np.ndarray) -> list[int]:
    """Rows in the order of an average-linkage tree; ties take the earlier pair.

    Sums of distances between groups are kept, and of each group the nearest later one: a merge adds two rows of sums, and
    looks anew only where the nearest one was of the merged pair, so that the work is quadratic.
    """
    n = len(x)
    if n < 2:
        return list(range(n))
    sums = np.stack([np.sqrt(((x - row) ** 2).sum(axis=1)) for row in x])
    size, groups, alive = np.ones(n), [[k] for k in range(n)], np.ones(n, dtype=bool)
    near, far = np.full(n, -1), np.full(n, np.inf)

    def look(i: int) -> None:
        later = np.flatnonzero(alive[i + 1 :]) + i + 1
        if len(later):
            d = sums[i, later] / (size[i] * size[later])
            k = int(d.argmin())
            near[i], far[i] = later[k], d[k]
        else:
            near[i], far[i] = -1, np.inf

    for i in range(n):
        look(i)
    for _ in range(n - 1):
        i = int(far.argmin())
        j = int(near[i])
        groups[i] += groups[j]
        alive[j], far[j] = False, np.inf
        sums[i] += sums[j]
        sums[:, i] = sums[i]
        size[i] += size[j]
        before = np.flatnonzero(alive[:i])
        d = sums[before, i] / (size[before] * size[i])
        closer = (d < far[before]) | ((d == far[before]) & (i < near[before]))
        stale = np.flatnonzero(alive & ((near == i) | (near == j)))
        near[before[closer]], far[before[closer]] = i, d[closer]
        for k in {i, *stale.tolist()} - set(before[closer].tolist()):
            look(k)
    return groups[int(np.flatnonzero(alive)[0])]
