"""Explaining trees against one grown by trying every split."""

import math
import random

import pytest

from loomspark.operators import sequences as Q
from loomspark.operators import trees as TR


def gini(ys):
    return 1 - sum((ys.count(y) / len(ys)) ** 2 for y in set(ys)) if ys else 0.0


def grown(rows, axes, depth, least, node=1, level=0):
    ys = [r[-1] for r in rows]
    most = max(map(ys.count, set(ys)))
    out = [(node, level, None, None, None, min(y for y in set(ys) if ys.count(y) == most), len(ys))]
    best = None
    if level < depth and len(set(ys)) > 1 and len(ys) >= 2 * least:
        for a in range(len(axes)):
            known = sorted({r[a] for r in rows if r[a] is not None and math.isfinite(r[a])})
            for low, high in zip(known, known[1:]):
                t = low + (high - low) / 2
                for missing in ("left", "right"):
                    sides = ([], [])
                    for r in rows:
                        v = r[a]
                        left = missing == "left" if v is None or not math.isfinite(v) else v <= t
                        sides[not left].append(r)
                    if min(map(len, sides)) < least:
                        continue
                    gain = round(gini(ys) - sum(len(s) * gini([r[-1] for r in s]) for s in sides) / len(ys), 10)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, axes[a], t, missing, sides)
    if best:
        out[0] = (node, level, best[1], best[2], best[3], *out[0][5:])
        for k, side in enumerate(best[4]):
            out += grown(side, axes, depth, least, 2 * node + k, level + 1)
    return out


def tree_of(spark, rows, axes, depth, least, schema="double"):
    df = spark.createDataFrame(rows, ", ".join(f"{a} {schema}" for a in axes) + ", l string")
    return [(r["node"], r["depth"], r["axis"], r["threshold"], r["missing_goes"], r["label"], r["n"]) for r in TR.explain_labels(df, "l", axes, depth, least)]


@pytest.mark.parametrize("seed", range(4))
def test_equal_to_a_tree_of_all_splits(spark, seed):
    r = random.Random(seed)
    value = lambda k: r.choice([None, float("nan"), float("inf"), *[float(r.randint(0, 9))] * 5, r.random() * 10])
    rows = [(value(0), r.choice([None, 1.0, 2.0]), r.random(), "abc"[(k % 5 > 1) + (r.random() > 0.8)]) for k in range(160)]
    axes = ["x", "y", "z"]
    for least in (1, 6):
        assert sorted(tree_of(spark, rows, axes, 3, least)) == sorted(grown(rows, axes, 3, least))


def test_no_small_children_and_no_split_without_gain(spark):
    rows = [(float(k), "a") for k in range(20)] + [(99.0, "b")]
    assert [r[3:7:3] for r in tree_of(spark, rows, ["x"], 3, 5)] == [(15.5, 21), (None, 16), (None, 5)]
    assert len(tree_of(spark, rows, ["x"], 3, 11)) == 1
    assert len(tree_of(spark, [(float(k % 2), "ab"[k // 2 % 2]) for k in range(40)], ["x"], 3, 5)) == 1
    assert len(tree_of(spark, [(None, "ab"[k % 2]) for k in range(40)], ["x"], 3, 5)) == 1
    assert tree_of(spark, [], ["x"], 3, 5) == []


def test_missing_values_go_where_they_fit(spark):
    rows = [(1.0, "a")] * 6 + [(2.0, "b")] * 6 + [(None, "b")] * 4
    tree = tree_of(spark, rows, ["x"], 2, 5)
    assert tree[0][2:5] == ("x", 1.5, "right") and sorted(r[5:] for r in tree[1:]) == [("a", 6), ("b", 10)]


def test_many_distinct_values_stay_exact(spark):
    """More values than any sketch keeps, in one node: the threshold is the very gap between the labels."""
    df = spark.range(60_000).selectExpr("(id * 7919 % 60000) / 7 as x", "cast(id % 3 as double) as y", "cast(id * 7919 % 60000 >= 23457 as int) as l")
    tree = TR.explain_labels(df, "l", ["y", "x"], 1)
    assert tree[0]["axis"] == "x" and tree[0]["threshold"] == pytest.approx(23456.5 / 7, abs=1e-9) and [r["n"] for r in tree[1:]] == [23457, 36543]


def test_neighbouring_doubles(spark):
    a = 1.0
    b = math.nextafter(a, 2)
    tree = tree_of(spark, [(a, "p")] * 5 + [(b, "q")] * 5, ["x"], 1, 5)
    assert tree[0][3] == a and [r[6] for r in tree[1:]] == [5, 5]


def test_predictions_and_text(spark):
    rows = [(1.0, "a")] * 6 + [(2.0, "b")] * 6 + [(None, "b")] * 4
    df = spark.createDataFrame(rows, "x double, l string")
    tree = TR.explain_labels(df, "l", ["x"], 2)
    assert TR.predicted(df, tree).where("l <> tree_prediction").count() == 0
    assert TR.tree_lines(tree) == ["x <= 1.5, missing goes right", "    yes: label a (6 rows, [6, 0])", "    no: label b (10 rows, [0, 10])"]


def test_running_sums_of_one_key(spark):
    df = spark.range(5000).selectExpr("cast('k' as string) as k", "cast(id * 37 % 5000 as int) as o", "id % 7 as v")
    rows = sorted((r.o, r.v) for r in df.collect())
    got = {r.o: (r.upto_s, r.all_s, r.following) for r in Q.running_sums(df, ["k"], "o", {"s": df["v"]}).collect()}
    total, all_ = 0, sum(v for _, v in rows)
    for o, v in rows:
        total += v
        assert got[o] == (total, all_, o + 1 if o < 4999 else None)


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0, 1.0, 1.0, 9.0, None, 2.5], [float(k % 11) for k in range(100)]])
def test_exact_percentile(spark, values):
    known = sorted(v for v in values if v is not None)
    for at in (0.5, 0.9, 0.0, 1.0):
        spot = at * (len(known) - 1)
        low = known[math.floor(spot)]
        want = low + (known[math.ceil(spot)] - low) * (spot - math.floor(spot))
        assert Q.exact_percentile(spark.createDataFrame([(v,) for v in values], "v double"), "v", at).first()[0] == pytest.approx(want)
