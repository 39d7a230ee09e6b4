"""Centres, distances, k-means, silhouette, stability: exact, as plans over arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import vectors as V
from ..sources.tables import workspace
from . import tiles


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """label, center, n: means by place."""
    parts = df.select(label, F.posexplode(V.doubles(F.col(vector))).alias("i", "v")).groupBy(label, "i").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    return parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("center"), F.max("n").alias("n"))  # a row for each place


def nearest(df: DataFrame, key: str, vector: str, centers: DataFrame, label: str) -> DataFrame:
    """key, cluster, distance to the nearest of a few centres (ties: the smaller label). One row of all centres meets
    every point; nothing is shuffled."""
    every = centers.agg(F.collect_list(F.struct(F.col(label).alias("l"), F.col("center").alias("c"))).alias("__c"))  # k centres in one row
    points = df.select(key, V.doubles(F.col(vector)).alias("__v")).crossJoin(F.broadcast(every))
    best = F.array_min(F.transform("__c", lambda x: F.struct(V.euclidean(F.col("__v"), x["c"]).alias("d"), x["l"].alias("l"))))
    return points.select(key, best.alias("m")).select(key, F.col("m.l").alias("cluster"), F.col("m.d").alias("distance"))


def kmeans(df: DataFrame, key: str, vector: str, k: int, seed: int = 0, starts: int = 10, rounds: int = 300, masked: bool = False) -> tuple[DataFrame, dict]:
    """key, cluster, distance by the best of several starts, and its centers and inertia. Rows without a vector are left out.

    A start is the k rows with the smallest hashes under its seed. All starts advance in one pass: each row finds its
    nearest centre of every start in an Arrow worker, which hands on a row of sums for each start and cluster; the driver
    holds the centres alone. An empty cluster takes another row by hash. Rounds end when no start changes.

    masked: nulls in a vector are left out of distances (mean squares) and means; a start's nulls count as zero, an axis
    that no member has and an empty cluster keep their centre.
    """
    where = workspace(df.sparkSession)  # every round reads the points again
    df.where(F.col(vector).isNotNull()).select(key, V.doubles(F.col(vector)).alias("v")).write.parquet(where)
    points = df.sparkSession.read.parquet(where)
    first = points.select(F.size("v").alias("n")).first()
    if first is None:
        return points.select(key, F.lit(0).alias("cluster"), F.lit(0.0).alias("distance")), {"centers": [], "inertia": 0.0}
    width = first[0]

    def drawn(n: int, salt: str) -> list[list[float]]:
        rows = points.orderBy(F.xxhash64(F.lit(f"{seed}:{salt}"), key), key).limit(n).collect()
        return [[0.0 if x is None else x for x in r["v"]] for r in rows]

    centers = [drawn(k, str(s)) for s in range(starts)]

    def nearest_of(batch: pa.RecordBatch, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors (NaN for null), nearest centre of each (ties: the first), squared or mean squared distance to it."""
        v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
        d = np.empty((len(v), len(start)))
        for c, center in enumerate(start):
            apart = v - center
            if masked:
                there = ~np.isnan(apart)
                n = there.sum(axis=1)
                d[:, c] = np.where(n > 0, np.where(there, apart * apart, 0).sum(axis=1) / np.maximum(n, 1), np.inf)
            else:
                d[:, c] = (apart * apart).sum(axis=1)
        at = d.argmin(axis=1)
        return v, at, d[np.arange(len(v)), at]

    def slices(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield batch.slice(at, 1024)

    def sums_of(options: list[list[list[float]]]) -> DataFrame:
        """s, cluster, mean, d: of each start and cluster the members' mean by place, null where none has the place, and the
        sum of their distances. A row for each start and cluster comes from a task."""
        every = np.array(options, dtype=np.float64)

        def run(batches):
            shape = every.shape[:2]
            total, count, away, rows = np.zeros(every.shape), np.zeros(every.shape), np.zeros(shape), np.zeros(shape, dtype=np.int64)
            for piece in slices(batches):
                for s, start in enumerate(every):
                    v, at, d = nearest_of(piece, start)
                    hot = (at[:, None] == np.arange(shape[1])).astype(np.float64)
                    there = ~np.isnan(v)
                    total[s] += hot.T @ np.where(there, v, 0)
                    count[s] += hot.T @ there
                    away[s] += np.bincount(at, np.nan_to_num(d, nan=0.0, posinf=np.inf), shape[1])
                    rows[s] += np.bincount(at, minlength=shape[1])
            s, c = np.nonzero(rows)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(c, pa.int32()), pa.array(list(total[s, c]), pa.list_(pa.float64())), pa.array(list(count[s, c]), pa.list_(pa.float64())), pa.array(away[s, c])], names=["s", "cluster", "t", "n", "d"])

        part = points.mapInArrow(run, "s int, cluster int, t array<double>, n array<double>, d double")
        mean = [F.try_divide(F.sum(F.col("t")[i]), F.sum(F.col("n")[i])) for i in range(width)]
        return part.groupBy("s", "cluster").agg(F.array(*mean).alias("mean"), F.sum("d").alias("d"))

    def assigned(start: list[list[float]]) -> DataFrame:
        """key, cluster, distance of each point."""
        centers = np.array(start, dtype=np.float64)

        def run(batches):
            for piece in slices(batches):
                _, at, d = nearest_of(piece, centers)
                yield pa.RecordBatch.from_arrays([piece.column(key), pa.array(at, pa.int32()), pa.array(np.sqrt(d), from_pandas=True)], names=[key, "cluster", "distance"])

        return points.mapInArrow(run, T.StructType([points.schema[key], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.DoubleType())]))

    live, inertia = set(range(starts)), {}
    for turn in range(rounds):
        some = sorted(live)
        sums = sums_of([centers[s] for s in some]).collect()  # starts x k rows
        inertia |= {s: 0.0 for s in some}
        moved = {(some[r["s"]], r["cluster"]): r["mean"] for r in sums}
        for r in sums:
            inertia[some[r["s"]]] += r["d"]
        for s in some:
            new = []
            for c, old in enumerate(centers[s]):
                mean = moved.get((s, c))
                if mean is None:
                    new.append(old if masked else drawn(1, f"{s}:{turn}:{c}")[0])
                else:
                    new.append([o if m is None else m for m, o in zip(mean, old, strict=True)])
            if all(abs(x - y) <= 1e-8 + 1e-5 * abs(y) for a, b in zip(new, centers[s], strict=True) for x, y in zip(a, b, strict=True)):
                live.discard(s)
            centers[s] = new
        if not live:
            break
    best = min(range(starts), key=lambda s: (round(inertia[s], 9), s))
    return assigned(centers[best]), {"centers": centers[best], "inertia": inertia[best]}


def pair_agreement(df: DataFrame, own: str, other: str) -> DataFrame:
    """strength: the least share, over clusters of two or more, of a cluster's pairs that the other labels keep together.
    From counts: no pair is ever made."""
    n = df.groupBy(own, other).agg(F.count("*").alias("n"))
    per = n.groupBy(own).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"), F.sum("n").alias("all")).where("all > 1")
    return per.agg(F.min(F.try_divide("same", F.col("all") * (F.col("all") - 1) / 2)).alias("strength"))


def prediction_strength(train: DataFrame, test: DataFrame, key: str, vector: str, k: int, seed: int = 0, starts: int = 10, rounds: int = 300) -> DataFrame:
    """strength of k clusters: how far the pairs of each cluster of the test rows stay together under the train rows' centres."""
    _, learned = kmeans(train, key, vector, k, seed, starts, rounds)
    own, _ = kmeans(test, key, vector, k, seed + 1, starts, rounds)
    centers = test.sparkSession.createDataFrame(list(enumerate(learned["centers"])), "label int, center array<double>")
    via = nearest(test, key, vector, centers, "label").select(key, F.col("cluster").alias("via"))
    return pair_agreement(own.join(via, key), "cluster", "via")


def distances(df: DataFrame, key: str, vector: str, label: str, anchors: DataFrame | None = None, masked: bool = False) -> DataFrame:
    """a, la, b, lb, d: of every anchor (rows of df, all by default) the distance to all other rows, by tiles; keys are
    distinct. masked: root mean square over the places that both have, null without any. The rows are anchors times rows, as
    asked: where a sum or a rank will do, take silhouette, discriminability or ranked, which give no pairs out."""
    return tiles.all_distances(df, key, vector, label, anchors, tiles.masked_rms if masked else tiles.euclidean)


def silhouette(df: DataFrame, key: str, vector: str, label: str, anchors: DataFrame | None = None, masked: bool = False) -> DataFrame:
    """key, silhouette of every anchor (all rows by default) by exact distances to all rows; tiles give sums out, pairs
    never exist. A row alone in its cluster has 0. masked: root mean square over the places that both rows have, pairs
    without any left out; a row without a distance on either side is left out."""
    return silhouettes(df, key, vector, [label], anchors, masked).select(key, "silhouette")


def silhouettes(df: DataFrame, key: str, vector: str, labels: list[str], anchors: DataFrame | None = None, masked: bool = False) -> DataFrame:
    """key, by, silhouette: silhouette under each of several columns of labels, by the column's place; distances are taken once
    for all of them."""
    sums = tiles.label_sums(df, key, vector, labels, anchors, tiles.masked_rms if masked else tiles.euclidean)
    means = sums.groupBy("a", "by", "la", "lb").agg((F.sum("s") / F.sum("n")).alias("d"))
    per = means.groupBy("a", "by").agg(F.max(F.when(F.col("la") == F.col("lb"), F.col("d"))).alias("own"), F.min(F.when(F.col("la") != F.col("lb"), F.col("d"))).alias("other"))
    if masked:
        per = per.where("own is not null and other is not null")
    return per.select(F.col("a").alias(key), "by", F.coalesce(F.try_divide(F.col("other") - F.col("own"), F.greatest("other", "own")), F.lit(0.0)).alias("silhouette"))


def standardised(df: DataFrame, entity: str, axis: str, value: str, ddof: int = 0) -> DataFrame:
    """Long form; by axis to mean 0 and deviation 1. A constant axis becomes 0."""
    w = W.partitionBy(axis)
    sd = F.stddev_pop(value).over(w) if ddof == 0 else F.stddev_samp(value).over(w)
    return df.select(entity, axis, F.coalesce(F.try_divide(F.col(value) - F.avg(value).over(w), sd), F.lit(0.0)).alias(value))


def row_centered(df: DataFrame, entity: str, axis: str, value: str) -> DataFrame:
    """Long form; each entity's values less their mean."""
    return df.select(entity, axis, (F.col(value) - F.avg(value).over(W.partitionBy(entity))).alias(value))


def row_scaled(df: DataFrame, entity: str, axis: str, value: str) -> DataFrame:
    """Long form; each entity's values to mean 0 and sample deviation 1. Entities whose values are all alike are left out."""
    w = W.partitionBy(entity)
    sd = F.stddev_samp(value).over(w)
    return df.select(entity, axis, F.try_divide(F.col(value) - F.avg(value).over(w), sd).alias(value), sd.alias("__sd")).where("__sd > 0").drop("__sd")
