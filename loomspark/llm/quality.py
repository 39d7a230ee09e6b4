"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_KIND = np.zeros((256, 10), dtype=np.float64)
for _b in range(256):
    _KIND[_b, 0] = 65 <= _b <= 90
    _KIND[_b, 1] = 97 <= _b <= 122
    _KIND[_b, 2] = 48 <= _b <= 57
    _KIND[_b, 3] = _b in b".,;:?'\"-()"
    _KIND[_b, 4] = _b in b"!"
    _KIND[_b, 5] = _b in b"#$%&*+=<>@^_`~\\/"
    _KIND[_b, 6] = _b in b"|[]{}"
    _KIND[_b, 7] = _b in b" \t"
    _KIND[_b, 8] = _b in b"\n\r"
    _KIND[_b, 9] = _b >= 128
del _b
FEATURES = 28


def statistics(text: bytes) -> list[float]:
    """Statistics of a text; an empty one has zeros. No label, language, source or id enters."""
    n = len(text)
    if not n:
        return [0.0] * FEATURES
    hist = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    kinds = hist @ _KIND / n
    p = hist[hist > 0] / n
    marks = hist[33:48].tolist() + hist[58:65].tolist() + hist[91:97].tolist() + hist[123:127].tolist()
    words = text.split()
    m = len(words) or 1
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    distinct = set(words)
    lines = text.split(b"\n")
    filled = [x for x in lines if x.strip()]
    sentences = hist[46] + hist[33] + hist[63]
    upper = sum(map(bytes.isupper, words)) / m
    title = sum(map(bytes.istitle, words)) / m
    ends = sum(1 for x in filled if x[-1:] in b".!?:\"'" and x) / (len(filled) or 1)
    twice = len(set(zip(words, words[1:]))) / max(1, len(words) - 1)
    thrice = len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2)
    return [
        np.log1p(n), np.log1p(len(words)), *kinds, -float((p * np.log2(p)).sum()), max(marks) / n,
        float(sizes.mean()), float(sizes.std()), float(sizes.max()), len(distinct) / m, upper, title,
        len(filled), len(set(filled)) / (len(filled) or 1), n / (len(filled) or 1), sentences / m, ends, twice, thrice, hist[10] / m,
    ]


class Forest:
    """Boosted trees as flat arrays; rows walk through all trees at once."""

    def __init__(self, base: float, feature, threshold, left, right, value, roots, depth: int):
        self.base, self.depth = base, depth
        self.feature, self.left, self.right, self.roots = (np.asarray(x, dtype=np.int32) for x in (feature, left, right, roots))
        self.threshold, self.value = np.asarray(threshold, dtype=np.float64), np.asarray(value, dtype=np.float64)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):  # leaves point to themselves
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 8, ridge: float = 1.0) -> Forest:
    """Second-order boosting of the log loss on per-feature histograms."""
    if not len(y):
        return Forest(0.0, [], [], [], [], [], [], 0)
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    raw, out = np.full(len(y), base), [[] for _ in range(5)]
    feature, threshold, left, right, value = out
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        roots.append(len(feature))
        level = {len(feature): np.arange(len(y))}
        for a in out:
            a.append(0)
        for d in range(depth + 1):
            following: dict[int, np.ndarray] = {}
            for node, rows in level.items():
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-6, None)
                for f in range(x.shape[1]) if d < depth and len(rows) >= 2 * least else ():
                    if not len(cuts[f]):
                        continue
                    b = binned[rows, f]
                    gl = np.cumsum(np.bincount(b, g[rows], len(cuts[f]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(cuts[f]) + 1))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=len(cuts[f]) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), (f, k))
                feature[node], threshold[node], left[node], right[node] = 0, 0.0, node, node
                if best[1] is None:
                    value[node] = -rate * gs / (hs + ridge)
                    raw[rows] += value[node]
                    continue
                f, k = best[1]
                feature[node], threshold[node] = f, float(cuts[f][k])
                low = binned[rows, f] <= k
                for side, own in ((left, rows[low]), (right, rows[~low])):
                    side[node] = len(feature)
                    following[len(feature)] = own
                    for a in out:
                        a.append(0)
            level = following
    return Forest(base, *out, roots, depth)


def _features(pieces):
    for piece in pieces:
        x = [statistics(t) for t in C.raw(piece)]
        yield piece, np.array(x, dtype=np.float64).reshape(len(x), FEATURES)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Forest:
    """Learns from labelled documents whose crc32(doc_id) mod 3 is not 1: sample_rows at most, chosen by a hash of the id.

    A document with several labels has their rounded mean; null labels and ids are left out. Of rows that repeat an id
    that with the smallest hash of its text counts.
    """
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("double").alias("y")).where("doc_id is not null and y is not null").where(C.crc_fold(F.col("doc_id"), 3) != 1)
    chosen = marks.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("__y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def run(batches):
        for batch in batches:
            for piece, x in _features(C.slices(batch)):
                marks = [xxhash.xxh3_64_intdigest(t) >> 1 for t in C.raw(piece)]
                yield C.batch_of(["doc_id", "y", "mark", "x"], [C.ids(piece), piece.column("__y").to_pylist(), marks, list(x)], [pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64())])

    rows = C.texts(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(C.tidied(run), "doc_id long, y double, mark long, x array<double>")
    # Of rows that repeat an id one, so that no more than sample_rows rows reach the driver.
    got = rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("x", "mark").alias("x")).toArrow()
    if not got.num_rows:
        return boost(np.zeros((0, FEATURES)), np.zeros(0))
    order = np.argsort(got.column("doc_id").to_numpy())
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    return boost(x[order], got.column("y").to_numpy()[order])


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted, one row for each row of docs, repeated rows too; an empty table gives none.

    Null text counts as empty and is scored like any other; texts are read whole. held_out: crc32(doc_id as text) mod 3
    is 1 (false for a null doc_id). Without labels every score is 0.5. Of docs only doc_id and text are read, of labels
    only doc_id and quality, whatever other columns there are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample_rows))  # a fixed number of nodes

    def run(batches):
        for batch in batches:
            for piece, x in _features(C.slices(batch)):
                yield C.batch_of(["doc_id", "score"], [C.ids(piece), shared.value.predict(x)], [pa.int64(), pa.float64()])

    out = C.texts(docs).mapInArrow(C.tidied(run), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(C.crc_fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
