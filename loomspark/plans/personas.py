"""Queries on whether users return to their own earlier profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import personas as PE
from .catalogue import query

AXES = ["click", "error", "purchase", "signup", "view"]
_VALUES = ", ".join(f"coalesce(avg(value) FILTER (WHERE event_type = '{a}'), 0) AS v{k}" for k, a in enumerate(AXES))
_EACH = lambda form: ", ".join(form.format(k=k) for k in range(len(AXES)))
_P = f"""WITH s AS (SELECT user_id, date_trunc('day', ts) AS day, {_VALUES} FROM events GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM s),
c AS (SELECT *, greatest(1, least(CAST(floor(n * 0.7::DOUBLE) AS BIGINT), n - 1)) AS cut FROM o WHERE n > 1),
p AS (SELECT user_id, count(*) FILTER (WHERE i <= cut) AS nr, count(*) FILTER (WHERE i > cut) AS nq, {_EACH("avg(v{k}) FILTER (WHERE i <= cut) AS r{k}, avg(v{k}) FILTER (WHERE i > cut) AS q{k}")} FROM c GROUP BY 1)"""
_SD = f"m AS (SELECT {_EACH('CASE WHEN coalesce(stddev_samp(r{k}), 0) = 0 THEN 1 ELSE stddev_samp(r{k}) END AS s{k}')} FROM p)"
_SQUARES = " + ".join(f"((a.q{k} - b.r{k}) / s{k}) ** 2" for k in range(len(AXES)))
_TABLE = f"""{_P}, {_SD}, d AS (SELECT a.user_id AS a, a.nr, a.nq, b.user_id AS b, round(sqrt(({_SQUARES}) / {len(AXES)}), 9) AS d FROM p a, p b, m),
own AS (SELECT a, nr, nq, d AS own FROM d WHERE a = b), tb AS (SELECT a, any_value(nr) AS nr, any_value(nq) AS nq, any_value(own) AS own, min(d) FILTER (WHERE a <> b) AS other, arg_min(b, (d, b)) FILTER (WHERE a <> b) AS who,
count(*) FILTER (WHERE d < own OR (d = own AND b < a)) + 1 AS rank, count(*) AS n FROM d JOIN own USING (a, nr, nq) GROUP BY a)"""


def _profiles(t):
    sessions = t.events.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.array(*[F.avg(F.when(F.col("event_type") == a, F.col("value"))) for a in AXES]).alias("v"))
    return PE.split_profiles(sessions, "user_id", ["day"], "v", len(AXES))


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


@query(f"""{_TABLE} SELECT a AS user_id, CAST(nr AS BIGINT) AS n_reference_sessions, CAST(nq AS BIGINT) AS n_query_sessions, round(own, 6) AS own_distance, round(other, 6) AS nearest_other_distance, round(other - own, 6) AS distance_margin, round(own / nullif(other, 0), 6) AS distance_ratio,
CAST(rank AS BIGINT) AS rank, rank = 1 AS top1_match, rank <= 5 AS top5_match, round(1.0::DOUBLE / rank, 6) AS reciprocal_rank, round(1 - CAST(rank - 1 AS DOUBLE) / greatest(n - 1, 1), 6) AS rank_percentile, who AS nearest_other FROM tb""")
def t20_identifiability(t):
    """Every user's later days against all users' earlier days, by tiles."""
    return _rounded(PE.identifiability(_profiles(t), "user_id", len(AXES)), "own_distance", "nearest_other_distance", "distance_margin", "distance_ratio", "reciprocal_rank", "rank_percentile")


_TAIL = "(SELECT least(1.0, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p})))) FROM (SELECT unnest(range({k}, n + 1)) AS j))"


@query(f"""{_TABLE}, g AS (SELECT count(*) AS n, count(*) FILTER (WHERE rank = 1) AS k1, count(*) FILTER (WHERE rank <= 5) AS k5, avg(1.0::DOUBLE / rank) AS mrr, median(rank) AS mr, median(own) AS mo, median(other) AS mx, 1.0::DOUBLE / any_value(tb.n) AS p1, 5.0::DOUBLE / any_value(tb.n) AS p5 FROM tb)
SELECT CAST(n AS BIGINT) AS n_queries, CAST(k1 AS BIGINT) AS top1_matches, CAST(k5 AS BIGINT) AS top5_matches, round(mrr, 6) AS mean_reciprocal_rank, round(mr, 6) AS median_rank, round(mo, 6) AS median_own_distance, round(mx, 6) AS median_nearest_other_distance, round(p1, 6) AS chance_top1, round(CAST(k1 AS DOUBLE) / n, 6) AS top1_accuracy,
round(greatest(0, (CAST(k1 AS DOUBLE) / n + 1.9208 / n - 1.96 * sqrt(CAST(k1 AS DOUBLE) / n * (1 - CAST(k1 AS DOUBLE) / n) / n + 0.9604 / n / n)) / (1 + 3.8416 / n)), 6) AS top1_ci95_low, round(least(1, (CAST(k1 AS DOUBLE) / n + 1.9208 / n + 1.96 * sqrt(CAST(k1 AS DOUBLE) / n * (1 - CAST(k1 AS DOUBLE) / n) / n + 0.9604 / n / n)) / (1 + 3.8416 / n)), 6) AS top1_ci95_high,
round(CASE WHEN k1 = 0 THEN 1.0 ELSE {_TAIL.format(p='p1', k='k1')} END, 6) AS top1_chance_p_value, round(p5, 6) AS chance_top5, round(CAST(k5 AS DOUBLE) / n, 6) AS top5_accuracy, round(CASE WHEN k5 = 0 THEN 1.0 ELSE {_TAIL.format(p='p5', k='k5')} END, 6) AS top5_chance_p_value FROM g""")
def t20_summary(t):
    profiles = _profiles(t)
    got = PE.identifiability_summary(PE.identifiability(profiles, "user_id", len(AXES)), profiles.count())
    return _rounded(got, *[c for c, kind in got.dtypes if kind == "double"])


_Z = ", ".join(f"(r{k} - rm{k}) / rs{k} AS x{k}, (q{k} - rm{k}) / rs{k} AS y{k}" for k in range(len(AXES)))
_MOMENTS = f"m AS (SELECT {_EACH('avg(r{k}) AS rm{k}, CASE WHEN stddev_pop(r{k}) = 0 THEN 1 ELSE stddev_pop(r{k}) END AS rs{k}')} FROM p)"
_AWAY = lambda side: "sqrt(" + " + ".join(f"(z.{side}{k} - ce.x{k}) ** 2" for k in range(len(AXES))) + ")"
_RETURN = f"""{_P}, {_MOMENTS}, z AS MATERIALIZED (SELECT user_id, nr, nq, {_Z} FROM p, m), ce AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS cluster, {_EACH('x{k}')} FROM z ORDER BY user_id LIMIT 3),
w AS (SELECT z.user_id, nr, nq, cluster, {_AWAY('x')} AS dr, {_AWAY('y')} AS dq FROM z, ce), h AS (SELECT user_id, any_value(nr) AS nr, any_value(nq) AS nq, arg_min(cluster, (dr, cluster)) AS hc, arg_min(cluster, (dq, cluster)) AS fc FROM w GROUP BY 1),
rt AS (SELECT h.*, min(dq) FILTER (WHERE cluster = hc) AS own, min(dq) FILTER (WHERE cluster <> hc) AS other FROM h JOIN w USING (user_id) GROUP BY ALL)"""


def _returned(t):
    """Clusters round the earlier profiles of the three users of smallest id."""
    profiles, width = _profiles(t), len(AXES)
    mean, sd = PE.axis_moments(profiles, "reference", width, 0)
    centers = [r["z"] for r in profiles.orderBy("user_id").limit(3).select(PE.scaled(F.col("reference"), mean, sd).alias("z")).collect()]
    return PE.persona_return(profiles, "user_id", width, centers)


@query(f"""{_RETURN} SELECT user_id, CAST(nr AS BIGINT) AS n_reference_sessions, CAST(nq AS BIGINT) AS n_future_sessions, CAST(hc AS INTEGER) AS historical_cluster, CAST(fc AS INTEGER) AS future_nearest_cluster, hc = fc AS same_cluster, round(own, 6) AS own_centroid_distance, round(other, 6) AS nearest_other_centroid_distance, round(other - own, 6) AS centroid_margin FROM rt""")
def t21_persona_return(t):
    return _rounded(_returned(t), "own_centroid_distance", "nearest_other_centroid_distance", "centroid_margin")


@query(f"""{_RETURN}, g AS (SELECT count(*) AS n, count(*) FILTER (WHERE hc = fc) AS s, median(other - own) AS mm FROM rt), ch AS (SELECT sum(CAST(a.n AS DOUBLE) * b.n) AS x FROM (SELECT hc AS c, count(*) AS n FROM rt GROUP BY 1) a JOIN (SELECT fc AS c, count(*) AS n FROM rt GROUP BY 1) b USING (c))
SELECT CAST(n AS BIGINT) AS n_users, 3 AS k, CAST(s AS BIGINT) AS same_cluster_users, round(CAST(s AS DOUBLE) / n, 6) AS same_cluster_accuracy, round(greatest(0, (CAST(s AS DOUBLE) / n + 1.9208 / n - 1.96 * sqrt(CAST(s AS DOUBLE) / n * (1 - CAST(s AS DOUBLE) / n) / n + 0.9604 / n / n)) / (1 + 3.8416 / n)), 6) AS same_cluster_ci95_low,
round(least(1, (CAST(s AS DOUBLE) / n + 1.9208 / n + 1.96 * sqrt(CAST(s AS DOUBLE) / n * (1 - CAST(s AS DOUBLE) / n) / n + 0.9604 / n / n)) / (1 + 3.8416 / n)), 6) AS same_cluster_ci95_high, round(coalesce(x, 0) / n / n, 6) AS chance_agreement, round(mm, 6) AS median_centroid_margin FROM g, ch""")
def t21_persona_summary(t):
    got = PE.persona_summary(_returned(t), 3)
    return _rounded(got, *[c for c, kind in got.dtypes if kind == "double"])


@query()
def t21_agreement_p(t):
    """Draws of the table of clusters: our own stream, held against enumeration in the tests."""
    return PE.agreement_p(_returned(t), "historical_cluster", "future_nearest_cluster", 2000, seed=3)
