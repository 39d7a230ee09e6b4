"""Queries over ternary preference vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as ST
from ..operators import preferences as P
from .catalogue import query

TURNS = """t AS (SELECT user_id, CAST(user_id AS VARCHAR) || ':' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS session, event_id AS turn_number, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) % 14 AS axis,
CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS score, value, event_type FROM events)"""
SESSIONS = f"""{TURNS}, s AS (SELECT user_id, session, axis, CAST(count(*) FILTER (WHERE score > 0) AS BIGINT) AS high, CAST(count(*) FILTER (WHERE score < 0) AS BIGINT) AS low, CAST(count(*) FILTER (WHERE score <> 0) AS BIGINT) AS support,
count(*) FILTER (WHERE score > 0) > 0 AND count(*) FILTER (WHERE score < 0) > 0 AS revised, coalesce(arg_max(score, turn_number) FILTER (WHERE score <> 0), 0) AS recent FROM t GROUP BY 1, 2, 3),
v AS (SELECT *, CASE WHEN high > low THEN 1 WHEN low > high THEN -1 ELSE recent END AS majority, round(CASE WHEN support = 0 THEN 0.0 ELSE (high - low)::DOUBLE / support END, 4) AS mean FROM s)"""


def session_vectors(t):
    return P.vectors(P.turn_scores(t.events), ["user_id", "session"])


@query(f"WITH {SESSIONS} SELECT user_id, session, axis, high, low, support, revised, recent, majority, mean FROM v")
def v4_session_vectors(t):
    """V1 recent, V2 majority with ties to recent, V3 mean, V4 the session vector."""
    return session_vectors(t)


@query(f"WITH {TURNS} SELECT session, axis, CASE WHEN count(*) FILTER (WHERE score <> 0 AND value >= 30) > 0 THEN arg_max(score, turn_number) FILTER (WHERE score <> 0 AND value >= 30) ELSE coalesce(arg_max(score, turn_number) FILTER (WHERE score <> 0), 0) END AS score FROM t GROUP BY 1, 2")
def v5_preferred_latest(t):
    return P.preferred_latest(P.turn_scores(t.events), ["session"], F.col("value") >= 30)


@query(f"WITH {SESSIONS} SELECT user_id, axis, CAST(count(*) FILTER (WHERE support > 0) AS BIGINT) AS supported, round(coalesce(avg(majority) FILTER (WHERE support > 0), 0.0), 6) AS mean, CAST(coalesce(sign(sum(majority) FILTER (WHERE support > 0)), 0) AS INTEGER) AS majority FROM v GROUP BY 1, 2")
def v67_user_vectors(t):
    return P.user_vectors(session_vectors(t))


@query(f"WITH {SESSIONS} SELECT user_id, axis, round((greatest(sum(high), sum(low)) + 1.0) / (sum(high) + sum(low) + 2.0), 6) AS confidence FROM v GROUP BY 1, 2")
def v8_laplace_confidence(t):
    per = session_vectors(t).groupBy("user_id", "axis").agg(F.sum("high").alias("h"), F.sum("low").alias("l"))
    return per.select("user_id", "axis", F.round(ST.laplace_confidence(F.col("h"), F.col("l")), 6).alias("confidence"))


@query(f"WITH {TURNS}, p AS (SELECT user_id, axis, count(DISTINCT session) FILTER (WHERE score > 0) AS h, count(DISTINCT session) FILTER (WHERE score < 0) AS l, count(DISTINCT session) AS n FROM t WHERE score <> 0 GROUP BY 1, 2) SELECT user_id, axis, CASE WHEN h > l THEN 'high' ELSE 'low' END AS direction, round((greatest(h, l) + 1.0) / (h + l + 2.0), 6) AS confidence, CAST(n AS BIGINT) AS sessions FROM p WHERE h <> l AND (greatest(h, l) + 1.0) / (h + l + 2.0) >= 0.6 AND n >= 2")
def v910_profiles(t):
    return P.profiles(P.turn_scores(t.events), 0.6, 2)


@query(f"WITH {SESSIONS}, c AS (SELECT user_id, axis, sum(high) AS h, sum(low) AS l FROM v GROUP BY 1, 2) SELECT user_id, axis, round(CASE WHEN h <> l AND (greatest(h, l) + 1.0::DOUBLE) / (h + l + 2) > 0.6 THEN sign(h - l) * (greatest(h, l) + 1.0::DOUBLE) / (h + l + 2) ELSE 0 END, 6) AS value FROM c")
def c10_retained_values(t):
    counts = session_vectors(t).groupBy("user_id", "axis").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return P.retained_values(counts, 0.6).withColumn("value", F.round("value", 6))


@query(f"WITH {SESSIONS} SELECT user_id, axis, round(avg(mean), 6) AS mean FROM v WHERE user_id IN (SELECT user_id FROM v GROUP BY 1 HAVING count(DISTINCT session) = 5) GROUP BY 1, 2")
def c10_balanced_profiles(t):
    """Profiles of the users with exactly five sessions."""
    return P.of_exactly(session_vectors(t), "user_id", "session", 5).groupBy("user_id", "axis").agg(F.round(F.avg("mean"), 6).alias("mean"))


@query()
def c10_confident_clusters(t):
    """Clusters of users by their retained values, axes without one at zero."""
    from ..operators import geometry as G
    from ..operators.statistics import packed

    counts = session_vectors(t).groupBy("user_id", "axis").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    rows = packed(P.retained_values(counts, 0.6), "user_id", "axis", F.col("value"), list(range(P.AXES)))
    filled = rows.select("user_id", F.transform("v", lambda x: F.coalesce(x, F.lit(0.0))).alias("v"))
    return G.kmeans(filled, "user_id", "v", 3, seed=3, starts=5, rounds=10)[0]


def _records(t):
    label = F.when(F.col("score") > 0, "high").when(F.col("score") < 0, "low").otherwise("na")
    return P.turn_scores(t.events).select("user_id", "axis", "session", "turn_number", label.alias("label"), "value")


@query(f"WITH {TURNS}, p AS (SELECT user_id, axis, count(*) FILTER (WHERE score > 0) AS h, count(*) FILTER (WHERE score < 0) AS l, count(DISTINCT session) FILTER (WHERE score > 0) AS hs, count(DISTINCT session) FILTER (WHERE score < 0) AS ls FROM t GROUP BY 1, 2), q AS (SELECT *, CASE WHEN h > l THEN 'high' WHEN l > h THEN 'low' END AS direction, CASE WHEN h = l THEN 0.0::DOUBLE ELSE (greatest(h, l) + 1.0::DOUBLE) / (h + l + 2) END AS c FROM p) SELECT user_id, axis, direction, round(c, 4) AS confidence, h <> l AND c >= 0.6 AND CASE WHEN h > l THEN hs ELSE ls END >= 2 AS high_confidence, CAST(h AS BIGINT) AS high_turns, CAST(l AS BIGINT) AS low_turns, CAST(CASE WHEN h > l THEN hs WHEN l > h THEN ls ELSE 0 END AS BIGINT) AS supporting, CAST(CASE WHEN h > l THEN ls WHEN l > h THEN hs ELSE 0 END AS BIGINT) AS contradicting FROM q")
def v10_evidence_profiles(t):
    return P.evidence_profiles(_records(t), 0.6, 2)


@query(f"WITH {TURNS} SELECT user_id, axis, CAST(row_number() OVER (PARTITION BY user_id, axis ORDER BY session, turn_number) AS INTEGER) AS place, CASE WHEN score > 0 THEN 'high' ELSE 'low' END AS label, session, turn_number, 'turn ' || turn_number AS message FROM t WHERE score <> 0 AND turn_number % 3 <> 0")
def v10_ordered_evidence(t):
    said = F.when(F.col("turn_number") % 3 != 0, F.concat(F.lit(" turn  "), F.col("turn_number").cast("string"))).otherwise(F.lit("  "))
    return P.ordered_evidence(_records(t), said)


@query(f"WITH {SESSIONS}, u AS (SELECT user_id, axis, sum(high) AS h, sum(low) AS l FROM v GROUP BY 1, 2), c AS (SELECT user_id, axis, CASE WHEN axis < 4 THEN CASE WHEN h > 0 THEN (h + 1.0) / (h + 2.0) END ELSE (greatest(h, l) + 1.0) / (h + l + 2.0) END AS c FROM u) SELECT user_id, axis, round(c, 6) AS confidence, CASE WHEN c >= 0.85 THEN 'consistent' WHEN c >= 0.7 THEN 'default' WHEN c >= 0.5 THEN 'tentative' END AS band FROM c")
def v1112_bands(t):
    """The first four axes have one side only."""
    per = session_vectors(t).groupBy("user_id", "axis").agg(F.sum("high").alias("h"), F.sum("low").alias("l"))
    c = F.when(F.col("axis") < 4, P.one_sided_confidence(F.col("h"))).otherwise(ST.laplace_confidence(F.col("h"), F.col("l")))
    return per.select("user_id", "axis", F.round(c, 6).alias("confidence"), P.confidence_band(c).alias("band"))


@query(f"WITH {TURNS}, f AS (SELECT user_id, axis, score, turn_number, CASE WHEN row_number() OVER (PARTITION BY user_id, axis, score ORDER BY turn_number) = 1 THEN 0 ELSE 1 END AS first FROM t WHERE score <> 0) SELECT user_id, axis, score, turn_number FROM (SELECT *, row_number() OVER (PARTITION BY user_id, axis ORDER BY first, turn_number) AS n FROM f) WHERE n <= 3")
def v13_representatives(t):
    fired = P.turn_scores(t.events).where("score <> 0").select("user_id", "axis", "score", "turn_number")
    return P.representatives(fired, ["user_id", "axis"], "score", [F.col("turn_number")])


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey, lower(c_mktsegment) ORDER BY c_custkey) AS one FROM customer) WHERE one = 1) WHERE n <= 4")
def v14_folded_distinct(t):
    said = t.customer.withColumn("said", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("  "), "c_mktsegment")).otherwise(F.lower("c_mktsegment")))
    return P.distinct_folded(said, ["c_nationkey"], "said", [F.col("c_custkey")], 4).select("c_nationkey", "c_custkey")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations) WHERE s <= 4000")
def v15_bounded_lines(t):
    return P.until_full(t.conversations, ["conv_id"], "text", [F.col("turn")], 4000).select("conv_id", "turn")


@query(f"WITH {SESSIONS} SELECT axis, round(count(*) FILTER (WHERE recent = majority AND (recent <> 0 OR majority <> 0)) / nullif(count(*) FILTER (WHERE recent <> 0 OR majority <> 0), 0), 6) AS agreement FROM v GROUP BY 1")
def v16_method_agreement(t):
    either = (F.col("recent") != 0) | (F.col("majority") != 0)
    return session_vectors(t).groupBy("axis").agg(F.round(ST.ratio(F.count_if(either & (F.col("recent") == F.col("majority"))), F.count_if(either)), 6).alias("agreement"))


@query(f"WITH {TURNS} SELECT user_id, axis, round(greatest(count(*) FILTER (WHERE score > 0), count(*) FILTER (WHERE score < 0)) / nullif(count(*) FILTER (WHERE score <> 0), 0), 6) AS consistency FROM t GROUP BY 1, 2")
def v17_sign_consistency(t):
    high, low = F.count_if(F.col("score") > 0), F.count_if(F.col("score") < 0)
    return P.turn_scores(t.events).groupBy("user_id", "axis").agg(F.round(ST.ratio(F.greatest(high, low), high + low), 6).alias("consistency"))


@query(f"WITH {TURNS} SELECT user_id, axis, CAST(count(*) AS BIGINT) AS n, bool_or(score > 0) AND bool_or(score < 0) AS conflict FROM t WHERE score <> 0 GROUP BY 1, 2 HAVING count(*) >= 2 OR bool_or(score < 0)")
def v18_retained_stances(t):
    s = F.col("score")
    per = P.turn_scores(t.events).where("score <> 0").groupBy("user_id", "axis").agg(F.count("*").alias("n"), F.bool_or(s > 0).alias("pro"), F.bool_or(s < 0).alias("con"))
    return per.where("n >= 2 or con").select("user_id", "axis", "n", (F.col("pro") & F.col("con")).alias("conflict"))


@query(f"WITH {TURNS} SELECT axis, user_id, round(avg(score), 6) AS profile FROM t GROUP BY 1, 2")
def a18_profiles(t):
    return P.turn_scores(t.events).groupBy("axis", "user_id").agg(F.round(F.avg("score"), 6).alias("profile"))


@query(f"WITH {SESSIONS} SELECT axis, round(count(*) FILTER (WHERE a.majority = b.majority) / count(*), 6) AS agreement, CAST(count(*) AS BIGINT) AS cells FROM (SELECT user_id, axis, majority, row_number() OVER (PARTITION BY user_id, axis ORDER BY session) AS n FROM v) a JOIN (SELECT user_id, axis, majority, row_number() OVER (PARTITION BY user_id, axis ORDER BY session) AS n FROM v) b USING (user_id, axis) WHERE b.n = a.n + 1 AND (a.majority <> 0 OR b.majority <> 0) GROUP BY axis")
def a42_neighbour_agreement(t):
    from pyspark.sql import Window as W

    after = F.lead("majority").over(W.partitionBy("user_id", "axis").orderBy("session"))
    v = session_vectors(t).withColumn("after", after).where("after is not null and (majority <> 0 or after <> 0)")
    return v.groupBy("axis").agg(F.round(ST.ratio(F.count_if(F.col("majority") == F.col("after")), F.count("*")), 6).alias("agreement"), F.count("*").alias("cells"))
