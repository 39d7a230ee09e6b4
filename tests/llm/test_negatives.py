"""Hard negatives against all pairs, scored in Python's integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, key long, id string, score double, anchor int"


def brute(rows, k=5, n=5, low=(80, 100), high=(100, 100)):
    good = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (a, v, lab) in enumerate(good):
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, lab == other) for j, (i, w, other) in enumerate(good) if j != at and len(v) == len(w)]
        for p, pos, same in sorted(s for s in scored if s[2])[:k]:
            window = sorted(s for s in scored if not s[2] and low[0] * -p <= low[1] * -s[0] and high[1] * -s[0] <= high[0] * -p)[:n]
            out += [(a, pos, rank + 1, i, -p, -s) for rank, (s, i, _) in enumerate(window)]
    return sorted(out)


def mined(spark, rows, parts=3, **kw):
    df = spark.createDataFrame([(*r, 1, "x", 0.5, 7) for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, negatives.hard_negatives(df, anchor=F.col("vec_id") % 100 == 0, **kw).collect()))


def vectors(seed, n, dims=(4,), labels=3, wide=1.0):
    r = random.Random(seed)
    pool = [[r.uniform(-0.2, wide) for _ in range(r.choice(dims))] for _ in range(n)]
    return [(k, r.choice(pool[: n // 3]) if k % 3 else pool[k], r.randrange(labels)) for k in range(n)]


@pytest.mark.parametrize("block", [negatives.ANCHOR_BYTES, 200])
def test_against_all_pairs(spark, monkeypatch, block):
    """Ties, several lengths of vectors, repeated rows, nulls and infinities; anchors in one block and in several."""
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", block)
    rows = vectors(1, 620, dims=(4, 7))
    rows += [rows[100], rows[100], rows[300], (None, [0.5] * 4, 1), (700, None, 1), (800, [0.5] * 4, None), (900, [0.5, None, 0.1, 0.2], 1), (1000, [float("nan")] * 4, 1), (1100, [float("inf"), 0.0, 0.0, 0.0], 1), (1200, [], 1), (1201, [], 1), (1202, [], 0), (-100, [0.5] * 4, 1)]
    want = brute(rows)
    assert mined(spark, rows) == want and len(want) > 30


def test_one_vector_and_one_label(spark):
    """A vector that most rows share, all of one label: ties go by id, whole, and other labels are found among few."""
    rows = [(k, [0.5, 0.25], 1) for k in range(900)] + [(900 + k, [0.5, 0.25 - k / 300], 2) for k in range(30)]
    assert mined(spark, rows, parts=5) == brute(rows)
    assert mined(spark, [(k, [1.0], 3) for k in range(201)]) == []


def test_large_components_stay_exact(spark):
    for wide in (2.0**21, 2.0**22, 2.0**23):
        rows = vectors(3, 120, dims=(3,), wide=wide)
        assert mined(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(0, [2.0**40], 1), (1, [2.0**40], 1), (2, [1.0], 2)])


def test_other_windows(spark):
    rows = vectors(4, 250)
    kw = {"low": (1, 2), "high": (3, 2)}
    assert mined(spark, rows, positives=2, negatives=3, **kw) == brute(rows, 2, 3, **kw)


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(5, [1.0], 1)]) == []


def test_best_merges_in_any_order():
    r = np.random.default_rng(0)
    cells, ids = r.integers(-3, 4, size=(6, 90)), np.sort(r.integers(0, 40, size=90))
    keys = np.arange(90)
    whole = negatives.Best(6, 4)
    whole.add(np.arange(6), cells, cells != 2, ids, keys)
    parts = negatives.Best(6, 4)
    for c in (slice(60, 90), slice(0, 7), slice(7, 60)):
        parts.add(np.arange(6), cells[:, c], cells[:, c] != 2, ids[c], keys[c])
    for x in ("score", "id", "key"):
        assert (getattr(whole, x) == getattr(parts, x)).all()
    assert whole.score.tolist() == [sorted(x for x in row if x != 2)[:-5:-1] for row in cells.tolist()]
