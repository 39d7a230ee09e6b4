"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


#: Pairs that one task writes.
ROWS = 200_000


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """One step. pairs: (a, b) with a > b. A node's smallest neighbour comes from a partially aggregated minimum, so
    no neighbourhood is ever collected."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    out = both.join(low, "a")
    if large:  # larger neighbours move to the smallest
        moved = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # smaller neighbours, and the node, move to the smallest
        moved = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of links (a, b), those that a task needs to join what it has seen joined: none that closes a circle. ROWS links are
    looked at together."""

    def kept(held):
        a, b = (np.concatenate([x.column(n).to_numpy(zero_copy_only=False) for x in held]) for n in ("a", "b"))
        names, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent, out = list(range(len(names))), []
        for k, (x, y) in enumerate(zip(places[: len(a)].tolist(), places[len(a) :].tolist(), strict=True)):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append(k)
        return C.batch_of(["a", "b"], [a[out], b[out]], [pa.int64()] * 2)

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            yield kept(held)
            held, rows = [], 0
    if rows:
        yield kept(held)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; root is the component's smallest node. Without links it is empty.

    Links that close a circle within a task are dropped first, so that a group of n nodes brings some n links from each task
    and not the many that it may have. Each round is written to the shared folder, and the one before it deleted; the driver sees a count and a sum only.
    Rounds go on until nothing changes, which takes about the logarithm of the longest path.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    pairs = C.materialise(ordered.mapInArrow(C.tidied(forest), "a long, b long").distinct(), "pairs")
    before = None
    while True:
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state[0] == 0 or state == before:
            break
        before, last = state, pairs
        # As many tasks write as there are rows for: a round leaves about as many pairs as it found.
        tasks = min(C.parts(pairs.sparkSession), -(-state[0] // ROWS))
        pairs = C.materialise(_stars(_stars(pairs, True), False).coalesce(tasks), "pairs")
        C.discard(last)
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
