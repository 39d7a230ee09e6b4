"""Returns to earlier profiles, by hand and by enumeration; pairwise measures by tiles against plain loops."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import geometry as G
from loomspark.operators import personas as PE
from loomspark.operators import tiles


def profiles(spark, rows):
    return spark.createDataFrame([(u, 2, 1, r, q) for u, r, q in rows], "u string, n_reference long, n_query long, reference array<double>, query array<double>")


def test_split_profiles(spark):
    rows = [("a", k, 0, [float(k), None]) for k in range(5)] + [("b", 0, 0, [1.0, 2.0])] + [("c", 0, 0, [1.0, 2.0]), ("c", 0, 1, [3.0, 4.0]), ("c", None, 2, [9.0, 9.0])]
    got = {r.u: tuple(r)[1:] for r in PE.split_profiles(spark.createDataFrame(rows, "u string, at int, s int, v array<double>"), "u", ["at", "s"], "v", 2).collect()}
    assert got == {"a": (3, 2, [1.0, 0.0], [3.5, 0.0]), "c": (1, 1, [1.0, 2.0], [3.0, 4.0])}


def test_identifiability_by_hand(spark, monkeypatch):
    r = random.Random(4)
    rows = [(f"u{k:02}", [float(r.randint(0, 3)), 5.0, r.random()], [float(r.randint(0, 3)), 5.0, r.random()]) for k in range(40)]
    rows[7] = ("u07", rows[6][1], rows[6][1])  # a tie at distance zero: the smaller one comes first
    sd = [np.std([x[1][i] for x in rows], ddof=1) or 1.0 for i in range(3)]
    away = lambda q, ref: round(math.sqrt(sum(((a - b) / s) ** 2 for a, b, s in zip(q, ref, sd)) / 3), 9)
    for size in (1024, 6):
        monkeypatch.setattr(tiles, "TILE", size)
        got = {x.u: x for x in PE.identifiability(profiles(spark, rows), "u", 3).collect()}
        for u, _, q in rows:
            order = sorted((away(q, ref), v) for v, ref, _ in rows)
            own = next(d for d, v in order if v == u)
            other, who = next((d, v) for d, v in order if v != u)
            x = got[u]
            assert (x["rank"], x.nearest_other, x.top1_match) == (order.index((own, u)) + 1, who, order[0][1] == u)
            assert (x.own_distance, x.nearest_other_distance) == (pytest.approx(own), pytest.approx(other))
        assert (got["u06"].nearest_other, got["u07"]["rank"], got["u07"].nearest_other, got["u07"].distance_ratio) != (None, 1, None, None)
        assert got["u07"]["rank"] == 2 and got["u07"].nearest_other == "u06" and got["u07"].distance_ratio is None


def test_summary_by_hand(spark):
    rows = [("a", [0.0], [0.1]), ("b", [10.0], [0.2]), ("c", [20.0], [21.0]), ("d", [30.0], [31.0])]
    table = PE.identifiability(profiles(spark, rows), "u", 1)
    got = PE.identifiability_summary(table, 4).first()
    assert (got.n_queries, got.top1_matches, got.top5_matches, got.top5_chance_p_value) == (4, 3, 4, 1.0)
    assert got.top1_chance_p_value == pytest.approx(sum(math.comb(4, k) * 0.25**k * 0.75 ** (4 - k) for k in (3, 4)))
    assert (got.mean_reciprocal_rank, got.median_rank) == (pytest.approx((3 + 0.5) / 4), 1.0)


def test_return_uses_the_scale_of_history_alone(spark):
    rows = [("a", [0.0, 1.0], [100.0, 1.0]), ("b", [2.0, 1.0], [0.0, 1.0]), ("c", [4.0, 1.0], [4.0, 1.0])]
    got = {r.u: r for r in PE.persona_return(profiles(spark, rows), "u", 2, [[-1.0, 0.0], [1.0, 0.0]]).collect()}
    sd = math.sqrt(8 / 3)
    assert [(got[u].historical_cluster, got[u].future_nearest_cluster, got[u].same_cluster) for u in "abc"] == [(0, 1, False), (0, 0, True), (1, 1, True)]
    assert got["a"].own_centroid_distance == pytest.approx(98 / sd + 1) and got["a"].centroid_margin == pytest.approx(-2.0)
    s = PE.persona_summary(PE.persona_return(profiles(spark, rows), "u", 2, [[-1.0, 0.0], [1.0, 0.0]]), 2).first()
    assert (s.n_users, s.same_cluster_users, s.chance_agreement) == (3, 2, pytest.approx((2 * 1 + 1 * 2) / 9))
    given = spark.createDataFrame([("a", 1), ("b", 1), ("c", 0)], "u string, c int")
    assert {r.u: r.historical_cluster for r in PE.persona_return(profiles(spark, rows), "u", 2, [[-1.0, 0.0], [1.0, 0.0]], given).collect()} == {"a": 1, "b": 1, "c": 0}


@pytest.mark.parametrize("pairs", [[("x", "x")] * 3 + [("y", "y")] * 2 + [("x", "y"), ("z", "x")], [("x", "y")] * 3 + [("y", "x")] * 3])
def test_agreement_p_against_all_permutations(spark, pairs):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    seen = sum(x == y for x, y in pairs)
    every = [sum(x == y for x, y in zip(p, b)) >= seen for p in itertools.permutations(a)]
    want = sum(every) / len(every)
    table = spark.createDataFrame(pairs, "a string, b string")
    got = PE.agreement_p(table, "a", "b", 20_000, seed=1).first()
    assert got.p == pytest.approx(want, abs=4 * math.sqrt(want * (1 - want) / 20_000) + 1e-3)
    assert tuple(PE.agreement_p(table.repartition(7), "a", "b", 500, seed=1).first()) == tuple(PE.agreement_p(table, "a", "b", 500, seed=1).first())


def vectors(seed, n, gaps=False):
    r = random.Random(seed)
    pool = [[r.choice([0.0, 0.5, 1.0, 3.0, r.random()]) for _ in range(3)] for _ in range(n // 2)]
    cut = lambda v: [None if gaps and r.random() < 0.4 else x for x in v]
    return [(f"k{k}", cut(r.choice(pool)), r.choice(["p", "q", "r", None][: 3 if gaps else 4])) for k in range(n)]


def plain(x, y, gaps):
    d = [(a - b) ** 2 for a, b in zip(x, y) if a is not None and b is not None]
    return math.sqrt(sum(d) / (len(d) if gaps else 1)) if d or not gaps else None


@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("size", [1024, 11])
def test_measures_by_tiles(spark, monkeypatch, gaps, size):
    monkeypatch.setattr(tiles, "TILE", size)
    rows = [r for r in vectors(1, 70, gaps) if r[2]]
    df = spark.createDataFrame(rows, "k string, v array<double>, l string")
    d = {(a, b): plain(v, w, gaps) for a, v, _ in rows for b, w, _ in rows if a != b}
    got = {(r.a, r.b): r.d for r in G.distances(df, "k", "v", "l", masked=gaps).collect()}
    assert got.keys() == d.keys() and all(got[k] == (None if v is None else pytest.approx(v, abs=1e-9)) for k, v in d.items())
    label, want = {k: l for k, _, l in rows}, {}
    for k in label:
        by = {}
        for other in label:
            if other != k and d[k, other] is not None:
                by.setdefault(label[other], []).append(d[k, other])
        means = {l: sum(x) / len(x) for l, x in by.items()}
        own, out = means.get(label[k]), min((m for l, m in means.items() if l != label[k]), default=None)
        if own is not None and out is not None:
            want[k] = (out - own) / max(out, own) if max(out, own) else 0.0
        elif not gaps:
            want[k] = 0.0
    assert {r.k: r.silhouette for r in G.silhouette(df, "k", "v", "l", masked=gaps).collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    if not gaps:
        per = {}
        for k in label:
            same, other = ([round(d[k, o], 9) for o in label if o != k and (label[o] == label[k]) == alike] for alike in (True, False))
            if same and other:
                per.setdefault(label[k], []).append(sum((s < o) + (s == o) / 2 for s in same for o in other) / len(same) / len(other))
        score = sum(sum(x) / len(x) for x in per.values()) / len(per)
        assert tiles.discriminability(df, "k", "v", "l").first().score == pytest.approx(score)


def test_the_plan_does_not_grow_with_the_rows(spark, monkeypatch):
    df = spark.createDataFrame(vectors(2, 60), "k string, v array<double>, l string")
    plans = []
    for size in (1024, 3):
        monkeypatch.setattr(tiles, "TILE", size)
        plans.append(G.silhouette(df, "k", "v", "l")._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert plans[0] == plans[1]
