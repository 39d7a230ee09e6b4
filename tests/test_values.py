"""Values of registered queries that have no SQL, on tables whose answers are known."""

import random
from types import SimpleNamespace

import pytest

from loomspark.operators import statistics as S
from loomspark.plans import models, studies


@pytest.fixture(scope="module")
def blobs(spark):
    """Three tight groups of vectors, far from each other."""
    r = random.Random(4)
    rows = [(k, [10.0 * (k % 3 == j) + r.gauss(0, 0.1) for j in range(3)], k % 3) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").cache()
    return SimpleNamespace(spark=spark, embeddings=df)


def test_sweep_finds_the_three_groups(blobs):
    got = {r.k: r for r in studies.c6_k_sweep(blobs).collect()}
    assert [k for k, r in got.items() if r.best] == [3] and got[3].silhouette > 0.95 > 0.9 > got[2].silhouette


def test_projection_keeps_the_groups_apart(blobs):
    at = {r.vec_id: (r.x, r.y) for r in models.c8_projection(blobs).collect()}
    away = lambda a, b: sum((p - q) ** 2 for p, q in zip(at[a], at[b])) ** 0.5
    assert all((away(a, b) < 2) == (a % 3 == b % 3) for a in at for b in at)


def test_trust_intervals_hold_the_mean(spark):
    """Users who all gain alike leave no width; others' interval holds their mean."""
    alike = spark.createDataFrame([(u, 1, 0.5, 0.9, 9, 9) for u in range(20)] , "user_id int, y int, population_p double, user_p double, pos int, n int")
    mixed = spark.createDataFrame([(u, u % 2, 0.5, 0.8, 9, 9) for u in range(40)], "user_id int, y int, population_p double, user_p double, pos int, n int")
    for df, wide in ((alike, False), (mixed, True)):
        r = S.trust_gates(df, "user_id", [5], [], [], replicates=200, seed=1).where("method = 'always'").first()
        assert r.ci_low <= r.mean_user_gain + 1e-12 and r.mean_user_gain <= r.ci_high + 1e-12 and (r.ci_high - r.ci_low > 1e-6) == wide
