"""Queries over ordered rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import preferences as P
from ..operators import sequences as Q
from .catalogue import query
from .preferences import SESSIONS


@query("SELECT o_orderkey, coalesce(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate - INTERVAL 1 DAY) AS since FROM orders")
def w1_lag(t):
    before = F.lag("o_orderdate").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t.orders.select("o_orderkey", F.coalesce(before, F.expr("o_orderdate - INTERVAL 1 DAY")).alias("since"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 3")
def w234_last_of_each(t):
    return Q.last_k(t.orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN n > 1 THEN CASE WHEN i <= greatest(1, least(floor(n * 0.7), n - 1)) THEN 'past' ELSE 'future' END END AS part FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)")
def w5_split_by_count(t):
    return Q.chronological_split(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], 0.7).select("o_orderkey", "part")


@query("SELECT event_id, CASE WHEN epoch_us(ts) <= lo + (hi - lo) * 0.7::DOUBLE THEN 'past' ELSE 'future' END AS part FROM (SELECT event_id, ts, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS lo, max(epoch_us(ts)) OVER (PARTITION BY user_id) AS hi FROM events)")
def w6_split_by_time(t):
    return Q.elapsed_split(t.events, ["user_id"], "ts", 0.7).select("event_id", "part")


@query("SELECT o_orderkey, CASE WHEN n > 1 THEN CASE WHEN i <= greatest(3, least(n - ceil(n * 0.25::DOUBLE), n - 1)) THEN 'past' ELSE 'future' END END AS part FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)")
def w7_split_upwards(t):
    return Q.chronological_split(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], 0.75, upwards=True, least=3).select("o_orderkey", "part")


@query("SELECT conv_id, turn, array_to_string(list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), chr(10)) AS context FROM conversations")
def w8_sliding_context(t):
    line = F.concat("role", F.lit(": "), "text")
    return Q.sliding_text(t.conversations, ["conv_id"], "turn", line, 5).select("conv_id", "turn", "context")


@query("WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) SELECT b.conv_id, b.turn, CAST(b.i - a.i AS INTEGER) AS \"offset\" FROM c a JOIN c b ON a.conv_id = b.conv_id AND abs(a.i - b.i) <= 2 WHERE contains(a.text, 'the')")
def w9_around_anchor(t):
    return Q.around(t.conversations, ["conv_id"], "turn", F.contains("text", F.lit("the")), 2).select("conv_id", "turn", "offset")


@query("SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS prompt_no, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS BIGINT) AS prompts FROM conversations")
def w10_prompt_ordinals(t):
    w, user = W.partitionBy("conv_id"), F.when(F.col("role") == "user", 1).otherwise(0)
    return t.conversations.select("conv_id", "turn", F.sum(user).over(w.orderBy("turn")).alias("prompt_no"), F.sum(user).over(w).alias("prompts"))


@query("WITH p AS (SELECT conv_id, turn, lag(turn) OVER w AS before, lead(turn) OVER w AS after FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT p.conv_id, p.turn, before, after, CAST(count(c.turn) AS BIGINT) AS answers FROM p LEFT JOIN conversations c ON c.conv_id = p.conv_id AND c.turn > p.turn AND c.turn < coalesce(after, 1000000) GROUP BY 1, 2, 3, 4")
def w11_prompts_and_spans(t):
    """Rows between a prompt and the next are those of its running ordinal, less itself: no range join."""
    w = W.partitionBy("conv_id").orderBy("turn")
    numbered = t.conversations.withColumn("p", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)).where("p > 0")
    per = numbered.groupBy("conv_id", "p").agg(F.min("turn").alias("turn"), (F.count("*") - 1).alias("answers"))
    by = W.partitionBy("conv_id").orderBy("turn")
    return per.select("conv_id", "turn", F.lag("turn").over(by).alias("before"), F.lead("turn").over(by).alias("after"), "answers")


@query(f"WITH {SESSIONS} SELECT user_id, axis, session, row_number() OVER w AS k, round(avg(mean) OVER w, 6) AS running FROM v WINDOW w AS (PARTITION BY user_id, axis ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def w12_running_mean(t):
    v = P.vectors(P.turn_scores(t.events), ["user_id", "session"])
    got = Q.running_mean(v, ["user_id", "axis"], ["session"], "mean")
    return got.select("user_id", "axis", "session", F.col("k").cast("long").alias("k"), F.round("running", 6).alias("running"))


@query("WITH r AS (SELECT user_id, row_number() OVER w AS k, avg(value) OVER w AS m, avg(value) OVER (PARTITION BY user_id) AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), b AS (SELECT user_id, max(k) FILTER (WHERE abs(m - f) > 3) AS bad, max(k) AS n FROM r GROUP BY 1) SELECT user_id, CASE WHEN bad IS NULL THEN 1 WHEN bad < n THEN bad + 1 END AS stable_from FROM b")
def w13_stable_from(t):
    r = Q.running_mean(t.events, ["user_id"], ["event_id"], "value").withColumn("f", F.avg("value").over(W.partitionBy("user_id")))
    got = Q.first_stable(r, ["user_id"], "k", F.abs(F.col("running") - F.col("f")) <= 3)
    return got.select("user_id", F.col("stable_from").cast("long").alias("stable_from"))


@query("SELECT user_id, k, round(avg(value) FILTER (WHERE i <= k), 6) AS early, round(avg(value) FILTER (WHERE i > k AND i <= k + 5), 6) AS late FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), (SELECT unnest([5, 10, 20]) AS k) GROUP BY 1, 2")
def w14_early_and_late(t):
    i = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    rows = t.events.select("user_id", "value", i.alias("i")).withColumn("k", F.explode(F.array(*map(F.lit, (5, 10, 20)))))
    v = F.col("value")
    return rows.groupBy("user_id", "k").agg(F.round(F.avg(F.when(F.col("i") <= F.col("k"), v)), 6).alias("early"), F.round(F.avg(F.when((F.col("i") > F.col("k")) & (F.col("i") <= F.col("k") + 5), v)), 6).alias("late"))


@query("SELECT user_id, day, lag(day) OVER w AS before, lag(day) OVER w IS NOT NULL AS has_before FROM (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY day)")
def w17_previous_segment(t):
    before = F.lag("day").over(W.partitionBy("user_id").orderBy("day"))
    days = t.events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    return days.select("user_id", "day", before.alias("before"), before.isNotNull().alias("has_before"))


@query("SELECT event_id, coalesce(a, -1) > coalesce(m, -1) AS anchored FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'view' THEN event_id END) OVER w AS a, max(CASE WHEN event_type = 'error' THEN event_id END) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = 'purchase'")
def w1819_anchor_after_change(t):
    w = W.partitionBy("user_id").orderBy("event_id")
    last = lambda kind: F.coalesce(F.max(F.when(F.col("event_type") == kind, F.col("event_id"))).over(w), F.lit(-1))
    return t.events.withColumn("anchored", last("view") > last("error")).where("event_type = 'purchase'").select("event_id", "anchored")


@query("SELECT user_id, start, n_events FROM (SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n_events FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > ts - INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s)")
def x_sessions_by_gap(t):
    from ..streaming.counts import sessions

    got = sessions(t.events, "user_id", "ts", "6 hours", "1 hour")
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n_events")


@query("WITH p AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') / count(*) AS p FROM events GROUP BY 1), r AS (SELECT user_id, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, user_id) AS q0, row_number() OVER (ORDER BY p, user_id) AS r FROM p) SELECT user_id, round(least(1.0, min(q0) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r")
def w20_step_up(t):
    p = t.events.groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("p"))
    return Q.step_up(p, "p").select("user_id", F.round("q", 6).alias("q"))
