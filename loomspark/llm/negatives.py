"""Hard-negative mining by blocked dense products.

Vectors are packed once into blocks of integer matrices. The anchors, dealt into blocks of bounded size, are broadcast a
block at a time against all candidate blocks; products are taken in float64, where they are exact below 2 ** 53 (larger
ones in integers). The first pass keeps each anchor's best positives, task by task, which merge; the second looks, for
each anchor and positive, for the best rows of other labels within a window of scores under the positive's.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

#: Bytes of vectors of the anchors that are broadcast together, about (they are dealt by hash).
ANCHOR_BYTES = 16 << 20
#: Cells of one product matrix.
CELLS = 1 << 19
#: Rows of a packed block.
ROWS = 4096
#: Below this a product of float64 integers is exact; below WIDE one of 64-bit integers.
EXACT, WIDE = 1 << 53, (1 << 63) - 1
#: Lower than any score.
NONE = -WIDE

PACKED = "block long, dim int, n_anchors int, kind string, ids binary, labels binary, anchors binary, matrix binary"
NAMES = ["block", "dim", "n_anchors", "kind", "ids", "labels", "anchors", "matrix"]
TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 4]


def _scaled(flat: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as the smallest type that holds all."""
    x = np.floor(flat * scale)
    most = np.abs(x).max(initial=0)
    if most >= WIDE:
        raise ValueError("a component leaves 64 bits")
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def _pack(rows: DataFrame, scale: float) -> DataFrame:
    """rows: id, label, anchor, vector, none of them null, to blocks of one dimension each."""

    def run(batches):
        uid = itertools.count(C.task_key() << 20)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                vector = part.column("vector")
                flat = vector.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                ends = np.cumsum(vector.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
                size = np.diff(np.append(0, ends))
                ids, labels, anchors = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "anchor"))
                finite = np.append(0, np.cumsum(~np.isfinite(flat)))
                good = finite[ends] == finite[ends - size]
                out = []
                for dim in np.unique(size[good]):
                    own = np.flatnonzero(good & (size == dim))
                    at = ends[own] - dim
                    matrix = _scaled(flat[C.ranges(at, np.full(len(own), dim))], scale)
                    out.append((next(uid), int(dim), int(anchors[own].sum()), matrix.dtype.str, ids[own].astype("<i8").tobytes(), labels[own].astype("<i8").tobytes(), anchors[own].astype(np.uint8).tobytes(), matrix.tobytes()))
                if out:
                    yield C.batch_of(NAMES, [list(x) for x in zip(*out, strict=True)], TYPES)

    return rows.mapInArrow(C.tidied(run), PACKED)


def _unpacked(batches):
    """(row keys, ids, labels, anchor flags, matrix) of each packed block."""
    for batch in batches:
        for block, dim, _, kind, ids, labels, anchors, matrix in zip(*(batch.column(c).to_pylist() for c in NAMES), strict=True):
            ids = np.frombuffer(ids, "<i8")
            yield block * ROWS + np.arange(len(ids)), ids, np.frombuffer(labels, "<i8"), np.frombuffer(anchors, np.uint8), np.frombuffer(matrix, kind).reshape(len(ids), dim)


ANCHORS = "deal int, key long, id long, label long, dim int, vector binary"


def _anchors(packed: DataFrame, deals: int) -> DataFrame:
    def run(batches):
        for key, ids, labels, flags, matrix in _unpacked(batches):
            own = np.flatnonzero(flags)
            if len(own):
                deal = (C.mixed(key[own].view(np.uint64)) % np.uint64(deals)).astype(np.int32)
                yield C.batch_of(["deal", "key", "id", "label", "dim", "vector"], [deal, key[own], ids[own], labels[own], np.full(len(own), matrix.shape[1], dtype=np.int32), [r.astype("<i8").tobytes() for r in matrix[own]]], [pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.binary()])

    return packed.where("n_anchors > 0").mapInArrow(C.tidied(run), ANCHORS)


class Block:
    """Anchors of one dimension: their keys, ids, labels and vectors, in the order of their keys."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r.key)
        self.key, self.id, self.label = (np.array([getattr(r, c) for r in rows], dtype=np.int64) for c in ("key", "id", "label"))
        self.matrix = np.array([np.frombuffer(r.vector, "<i8") for r in rows], dtype=np.int64).reshape(len(rows), rows[0].dim)
        self.most = int(np.abs(self.matrix).max(initial=0))
        self.floats = self.matrix.astype(np.float64)

    def scores(self, some: slice, other: np.ndarray) -> np.ndarray:
        """Inner products as 64-bit integers."""
        bound = self.most * int(np.abs(other.astype(np.int64)).max(initial=0)) * max(1, other.shape[1])
        if bound < EXACT:
            return (self.floats[some] @ other.astype(np.float64).T).astype(np.int64)
        if bound < WIDE:
            return self.matrix[some] @ other.astype(np.int64).T
        exact = self.matrix[some].astype(object) @ other.astype(object).T
        if max(map(abs, exact.reshape(-1).tolist()), default=0) >= WIDE:
            raise ValueError("a score leaves 64 bits")
        return exact.astype(np.int64)


class Best:
    """For each of n lists the first k entries by score (higher first), then id, then key; entries come in any order."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id, self.key = np.full((n, k), NONE), np.zeros((n, k), dtype=np.int64), np.zeros((n, k), dtype=np.int64)

    def add(self, lists: np.ndarray, cells: np.ndarray, allowed: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        """cells: a row of scores for each of lists, allowed: which count. Columns ascend by id, then key, so that the first of
        equal maxima comes first in order."""
        cells = np.where(allowed, cells, NONE)
        most = cells.max(axis=1, initial=NONE)
        # Only what beats the last entry can change a list; an equal score may, by its id.
        hopeful = np.flatnonzero((most >= self.score[lists, -1]) & (most > NONE))
        if not len(hopeful):
            return
        cells, lists = cells[hopeful], lists[hopeful]
        row = np.arange(len(lists))
        found = [(self.score[lists], self.id[lists], self.key[lists])]
        for _ in range(min(self.k, cells.shape[1])):
            at = cells.argmax(axis=1)
            found.append(tuple(x[:, None] for x in (cells[row, at], ids[at], keys[at])))
            cells[row, at] = NONE
        score, id_, key = (np.concatenate([f[j] for f in found], axis=1) for j in range(3))
        order = np.lexsort((key, id_, -score), axis=1)[:, : self.k]
        self.score[lists], self.id[lists], self.key[lists] = (np.take_along_axis(x, order, axis=1) for x in (score, id_, key))


def _chunks(block: Block, keys, ids, labels, matrix):
    """(anchor slice, scores, and the candidates' keys, ids, labels) in matrices of about CELLS cells; candidates by id, key."""
    order = np.lexsort((keys, ids))
    keys, ids, labels, matrix = keys[order], ids[order], labels[order], matrix[order]
    wide = min(1024, len(ids)) or 1
    tall = max(1, CELLS // wide)
    for c in range(0, len(ids), wide):
        for a in range(0, len(block.key), tall):
            some, cand = slice(a, a + tall), slice(c, c + wide)
            yield some, block.scores(some, matrix[cand]), keys[cand], ids[cand], labels[cand]


def _positives(packed: DataFrame, blocks, k: int) -> DataFrame:
    """anchor (key), id, score, key: a task's best k rows of each anchor's label."""

    def run(batches):
        best: dict = {}
        for keys, ids, labels, _, matrix in _unpacked(batches):
            block = blocks.value.get(matrix.shape[1])
            if block is None:
                continue
            top = best.setdefault(matrix.shape[1], Best(len(block.key), k))
            for some, cells, key, id_, label in _chunks(block, keys, ids, labels, matrix):
                lists = np.arange(len(block.key))[some]
                top.add(lists, cells, (block.label[some][:, None] == label) & (block.key[some][:, None] != key), id_, key)
        for dim, top in best.items():
            r, c = np.nonzero(top.score > NONE)
            yield C.batch_of(["anchor", "id", "score", "key"], [blocks.value[dim].key[r], top.id[r, c], top.score[r, c], top.key[r, c]], [pa.int64()] * 4)

    return packed.mapInArrow(C.tidied(run), "anchor long, id long, score long, key long")


def _negatives(packed: DataFrame, blocks, wanted, k: int) -> DataFrame:
    """anchor (key), place of the positive, id, score, key: a task's best k rows in the window of each anchor and positive."""

    def run(batches):
        best: dict = {}
        for keys, ids, labels, _, matrix in _unpacked(batches):
            dim = matrix.shape[1]
            block = blocks.value.get(dim)
            if block is None:
                continue
            floor, ceiling = wanted.value[dim]
            tops = best.setdefault(dim, [Best(len(block.key), k) for _ in range(floor.shape[1])])
            for some, cells, key, id_, label in _chunks(block, keys, ids, labels, matrix):
                lists, other = np.arange(len(block.key))[some], block.label[some][:, None] != label
                for j, top in enumerate(tops):
                    top.add(lists, cells, other & (cells >= floor[some, j : j + 1]) & (cells <= ceiling[some, j : j + 1]), id_, key)
        for dim, tops in best.items():
            for j, top in enumerate(tops):
                r, c = np.nonzero(top.score > NONE)
                yield C.batch_of(["anchor", "place", "id", "score", "key"], [blocks.value[dim].key[r], np.full(len(r), j + 1), top.id[r, c], top.score[r, c], top.key[r, c]], [pa.int64()] * 5)

    return packed.mapInArrow(C.tidied(run), "anchor long, place long, id long, score long, key long")


def _first(rows: DataFrame, lists: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*lists).orderBy(F.col("score").desc(), "id", "key")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _mine(packed: DataFrame, dealt: DataFrame, k: int, n: int, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """The result's rows for one block of anchors; the driver holds that block and k entries for each of its anchors."""
    context, found = packed.sparkSession.sparkContext, dealt.collect()
    blocks = {dim: Block([r for r in found if r.dim == dim]) for dim in sorted({r.dim for r in found})}
    shared = context.broadcast(blocks)
    best = C.materialise(_first(_positives(packed, shared, k), ["anchor"], k), "positives")
    wanted = {dim: (np.ones((len(b.key), k), dtype=np.int64), np.zeros((len(b.key), k), dtype=np.int64)) for dim, b in blocks.items()}  # from 1 to 0: no score
    place = {key: (dim, j) for dim, b in blocks.items() for j, key in enumerate(b.key.tolist())}
    for r in best.select("anchor", "rank", "score").collect():
        dim, j = place[r.anchor]
        for bounds, bound in zip(wanted[dim], (-(-low[0] * r.score // low[1]), high[0] * r.score // high[1]), strict=True):
            bounds[j, r.rank - 1] = min(max(bound, NONE + 1), WIDE - 1)
    last = _first(_negatives(packed, shared, context.broadcast(wanted), n), ["anchor", "place"], n)
    # A row for each anchor of the block, and k for each: bounded like the block itself.
    named = F.broadcast(dealt.select(F.col("key").alias("anchor"), F.col("id").alias("anchor_id")))
    sides = F.broadcast(best.select("anchor", F.col("rank").cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    out = last.select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(sides, ["anchor", "place"]).join(named, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 5,
    low: tuple[int, int] = (80, 100),
    high: tuple[int, int] = (100, 100),
    scale: float = 256.0,
    where: str | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Each component x becomes floor(scale * x). Anchors are the rows for which `anchor` is true. An anchor's positives are its
    first `positives` other rows of its label, by integer inner product, ties by smaller id; for each of them come the first
    `negatives` rows of other labels whose score s, with p the positive's, has low * p <= s <= high * p (ratios of integers).

    Rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors of another length
    than an anchor's are not compared with it, and empty ones have products of 0. Rows that repeat an id are rows of their
    own: each is an "other row" of the next. All rows of an anchor's label may share one label or one vector: a task hands on
    `positives` entries for each anchor. A null `anchor` counts as false; an empty table, or one without anchors, gives no
    rows. A product that leaves 64 bits is refused. Other columns, under any names, are not read. Results of each block of
    anchors are added to the table `where`, by default one that goes with the session.
    """
    spark = rows.sparkSession
    C.small_batches(spark)
    kept = rows[vector] if rows.schema[vector].dataType.simpleString() in ("array<float>", "array<double>") else rows[vector].cast("array<double>")
    own = rows.select(rows[id].cast("long").alias("id"), rows[label].cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), kept.alias("vector"))
    own = own.where("id is not null and label is not null and vector is not null and not exists(vector, x -> x is null)")
    packed = C.materialise(_pack(own, scale), "vectors")
    n_bytes = packed.agg(F.sum(F.col("n_anchors").cast("long") * (F.col("dim") + 4) * 8)).first()[0] or 0
    deals = -(-n_bytes // ANCHOR_BYTES)
    base = f"{C.shared_dir(spark)}/loomspark/negatives-{uuid.uuid4().hex}"
    C.delete_on_exit(spark, base)
    where = where or f"{base}/result"
    if not deals:
        spark.createDataFrame([], RESULT).write.mode("append").parquet(where)
    else:
        _anchors(packed, deals).write.partitionBy("deal").parquet(f"{base}/anchors")
    for deal in range(deals):
        dealt = spark.read.schema(ANCHORS).parquet(f"{base}/anchors").where(F.col("deal") == deal)
        _mine(packed, dealt, positives, negatives, low, high).write.mode("append").parquet(where)
    return spark.read.schema(RESULT).parquet(where)
