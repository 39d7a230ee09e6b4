"""Queries over aggregates, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import aggregates as A
from .catalogue import query


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc FROM lineitem GROUP BY 1, 2")
def a13_group_sums(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))


@query("SELECT user_id, CAST(count(DISTINCT event_type) AS BIGINT) AS kinds, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS days FROM events GROUP BY 1")
def a2_distinct_counts(t):
    return t.events.groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"), F.countDistinct(F.to_date("ts")).alias("days"))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, median(o_totalprice) AS mid, min(o_totalprice) AS low, max(o_totalprice) AS high, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY 1")
def a3_named_aggregates(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.percentile("o_totalprice", 0.5).alias("mid"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors, CAST(count(*) FILTER (WHERE value IS NOT NULL) AS BIGINT) AS valued, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM events GROUP BY 1")
def a45_conditional(t):
    error = F.col("event_type") == "error"
    return t.events.groupBy("user_id").agg(F.count_if(error).alias("errors"), F.count("value").alias("valued"), F.round(F.avg(error.cast("double")), 6).alias("error_rate"))


@query("SELECT coalesce(source, '<null>') AS source, CAST(count(*) AS BIGINT) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def a67_top_values(t):
    return A.top_values(t.documents, "source", 5).withColumn("share", F.round("share", 6))


@query("SELECT user_id, event_type AS modal FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS n FROM events GROUP BY 1, 2) WHERE n = 1")
def a8_mode(t):
    return A.mode(t.events, ["user_id"], "event_type", "modal")


@query("SELECT event_type, CAST(count(value) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.25), 6) AS p25, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90, max(value) AS largest FROM events GROUP BY 1")
def a9_10_distribution(t):
    d = A.distribution(t.events, ["event_type"], "value")
    return d.withColumns({c: F.round(c, 6) for c in ("mean", "p25", "median", "p75", "p90")})


@query("SELECT user_id, bool_or(event_type = 'purchase') AS bought, bool_and(value < 60) AS small FROM events GROUP BY 1")
def a11_any_all(t):
    return t.events.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("bought"), F.bool_and(F.col("value") < 60).alias("small"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def a12_joined_set(t):
    return t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ";").alias("kinds"))


@query("SELECT CASE WHEN user_id % 5 <> 0 THEN user_id % 5 END AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def a13_null_group(t):
    return t.events.groupBy(F.when(F.col("user_id") % 5 != 0, F.col("user_id") % 5).alias("k")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def a14_keep_first(t):
    return A.keep_first(t.orders, ["o_custkey", "o_orderpriority"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT DISTINCT user_id, event_type FROM events")
def a15_distinct(t):
    return t.events.select("user_id", "event_type").distinct()


@query("SELECT CAST(count(*) AS BIGINT) AS repeated, CAST(count(*) FILTER (WHERE sources > 1) AS BIGINT) AS in_several FROM (SELECT md5(text) AS k, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1)")
def a16_duplicate_audit(t):
    per = t.documents.groupBy(F.md5("text").alias("k")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources")).where("n > 1")
    return per.agg(F.count("*").alias("repeated"), F.count_if(F.col("sources") > 1).alias("in_several"))


@query("SELECT event_type, round(avg(v), 6) AS value FROM (SELECT event_type, user_id, avg(v) AS v FROM (SELECT event_type, user_id, CAST(ts AS DATE) AS d, avg(value) AS v FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1")
def a17_33_nested_mean(t):
    df = t.events.withColumn("d", F.to_date("ts"))
    return A.nested_mean(df, [["event_type", "user_id", "d"], ["event_type", "user_id"], ["event_type"]], "value").withColumn("value", F.round("value", 6))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS d FROM lineitem GROUP BY 1")
def a19_weighted_mean(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(A.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 8).alias("d"))


@query("SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS click, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS view, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS error FROM events GROUP BY 1")
def a20_pivot_counts(t):
    return t.events.groupBy("user_id").pivot("event_type", ["click", "view", "error"]).count().na.fill(0)


@query("SELECT o_orderpriority, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'valid' ELSE 'not_run' END AS status FROM orders GROUP BY 1")
def a21_pivot_values(t):
    p = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_totalprice"))
    return p.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.when(F.col("P").isNotNull(), "valid").otherwise("not_run").alias("status"))


@query("SELECT lang, CAST(count(*) FILTER (WHERE q = '0') AS BIGINT) AS \"0\", CAST(count(*) FILTER (WHERE q = '1') AS BIGINT) AS \"1\", round(count(*) FILTER (WHERE q = '0') / count(*), 6) AS \"0_share\", round(count(*) FILTER (WHERE q = '1') / count(*), 6) AS \"1_share\" FROM (SELECT lang, CAST(quality AS VARCHAR) AS q FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def a22_crosstab(t):
    df = t.documents.select("doc_id", "lang").join(t.labels, "doc_id").withColumn("q", F.col("quality").cast("string"))
    return A.crosstab(df, "lang", "q", ["0", "1"])


@query("SELECT bin, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN n_chars > 0 AND n_chars <= 500 THEN 'short' WHEN n_chars > 500 AND n_chars <= 3000 THEN 'middle' WHEN n_chars > 3000 AND n_chars <= 1000000 THEN 'long' END AS bin FROM documents) GROUP BY 1")
def a23_cut(t):
    return t.documents.groupBy(A.cut(F.col("n_chars"), [0, 500, 3000, 1000000], ["short", "middle", "long"]).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, CAST(count(v) AS BIGINT) AS n FROM (VALUES (0, 10), (10, 20), (20, 50), (50, 100)) b(lo, hi) LEFT JOIN (SELECT value AS v FROM events) ON v >= lo AND (v < hi OR (hi = 100 AND v <= hi)) GROUP BY 1, 2")
def a24_histogram(t):
    return A.histogram(t.events, "value", [0, 10, 20, 50, 100])


@query("SELECT round(top, 2) AS top, round(total, 2) AS total, round(top / total, 8) AS share FROM (SELECT sum(s) FILTER (WHERE n <= 5) AS top, sum(s) AS total FROM (SELECT s, row_number() OVER (ORDER BY s DESC) AS n FROM (SELECT sum(o_totalprice) AS s FROM orders GROUP BY o_custkey)))")
def a25_top_share(t):
    per = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    got = A.top_share(per, "s", 5)
    return got.select(F.round("top", 2).alias("top"), F.round("total", 2).alias("total"), F.round("share", 8).alias("share"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n, CAST(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS BIGINT) AS span FROM orders GROUP BY 1")
def a26_months(t):
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("long").alias("span"))


@query("SELECT axis, CAST(count(DISTINCT session) FILTER (WHERE score <> 0) AS BIGINT) AS sessions, CAST(count(DISTINCT user_id) FILTER (WHERE score <> 0) AS BIGINT) AS users, round(count(*) FILTER (WHERE score <> 0) / count(*), 6) AS share, count(*) FILTER (WHERE score <> 0) / count(*) < 0.4 AS sparse FROM (SELECT user_id, CAST(user_id AS VARCHAR) || ':' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS session, CAST(json_extract_string(props, '$.k') AS INTEGER) % 14 AS axis, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS score FROM events) GROUP BY 1")
def a27_axis_coverage(t):
    from ..operators.preferences import turn_scores

    s = turn_scores(t.events)
    fired = F.col("score") != 0
    share = F.avg(fired.cast("double"))
    return s.groupBy("axis").agg(F.countDistinct(F.when(fired, F.col("session"))).alias("sessions"), F.countDistinct(F.when(fired, F.col("user_id"))).alias("users"), F.round(share, 6).alias("share"), (share < 0.4).alias("sparse"))


@query("SELECT round(avg(r), 6) AS mean, round(median(r), 6) AS median, round(quantile_cont(r, 0.9), 6) AS p90, round(max(r), 6) AS largest FROM (SELECT avg(CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN 1.0 ELSE 0.0 END) AS r FROM events GROUP BY user_id, date_trunc('week', ts))")
def a28_firing_rates(t):
    from ..operators.preferences import turn_scores

    per = turn_scores(t.events).groupBy("session").agg(F.avg((F.col("score") != 0).cast("double")).alias("r"))
    d = A.distribution(per, [], "r")
    return d.select(*[F.round(c, 6).alias(c) for c in ("mean", "median", "p90", "largest")])


@query("SELECT user_id, event_id FROM events JOIN (SELECT user_id AS u, date_trunc('week', ts) AS w FROM events GROUP BY 1, 2 HAVING avg(CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN 1.0 ELSE 0.0 END) >= 0.75) ON user_id = u AND date_trunc('week', ts) = w")
def a29_dense_sessions(t):
    from ..operators.preferences import turn_scores

    s = turn_scores(t.events)
    dense = s.groupBy("session").agg(F.avg((F.col("score") != 0).cast("double")).alias("r")).where("r >= 0.75")
    return s.join(dense, "session", "left_semi").select("user_id", F.col("turn_number").alias("event_id"))


@query("SELECT lang, CAST(count(*) FILTER (WHERE q IS NULL) AS BIGINT) AS none, CAST(count(*) FILTER (WHERE q = 1 AND x = 0) AS BIGINT) AS good, CAST(count(*) FILTER (WHERE q = 0 AND x = 0) AS BIGINT) AS bad, CAST(count(*) FILTER (WHERE x = 1) AS BIGINT) AS toxic, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM (SELECT lang, source, quality AS q, toxic AS x FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1")
def a30_bucket_census(t):
    df = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")
    q, x = F.col("quality"), F.col("toxic")
    return df.groupBy("lang").agg(F.count_if(q.isNull()).alias("none"), F.count_if((q == 1) & (x == 0)).alias("good"), F.count_if((q == 0) & (x == 0)).alias("bad"), F.count_if(x == 1).alias("toxic"), F.countDistinct("source").alias("sources"))


@query("SELECT user_id, CASE max(CASE WHEN value >= 99.9 THEN 3 WHEN value >= 70 THEN 2 WHEN value >= 30 THEN 1 ELSE 0 END) WHEN 3 THEN 'exact' WHEN 2 THEN 'strong' WHEN 1 THEN 'moderate' ELSE 'weak' END AS best FROM events GROUP BY 1")
def a31_best_label(t):
    v = F.col("value")
    rank = F.when(v >= 99.9, 3).when(v >= 70, 2).when(v >= 30, 1).otherwise(0)
    names = F.array(*[F.lit(x) for x in ("weak", "moderate", "strong", "exact")])
    return t.events.groupBy("user_id").agg(F.max(rank).alias("r")).select("user_id", F.get(names, F.col("r")).alias("best"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT user_id) AS BIGINT) AS users, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(value), 6) AS mean FROM events")
def a32_global(t):
    return t.events.agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT user_id, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS used, round(sum(CASE WHEN event_type = 'view' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE 0 END) / sum(CAST(json_extract_string(props, '$.k') AS BIGINT)), 6) AS cached, bool_or(event_type = 'error' AND value > 50) AS failed FROM events GROUP BY 1")
def a34_usage_audit(t):
    k = F.from_json("props", "k long")["k"]
    view = F.when(F.col("event_type") == "view", k).otherwise(0)
    return t.events.groupBy("user_id").agg(F.sum(k).alias("used"), F.round(F.try_divide(F.sum(view), F.sum(k)), 6).alias("cached"), F.bool_or((F.col("event_type") == "error") & (F.col("value") > 50)).alias("failed"))


@query("SELECT conv_id, string_agg(role || '=' || CAST(n AS VARCHAR), ', ' ORDER BY n DESC, role) AS calls, CAST(sum(marks) AS BIGINT) AS marks FROM (SELECT conv_id, role, count(*) AS n, sum(len(regexp_extract_all(text, '[.!?]'))) AS marks FROM conversations GROUP BY 1, 2) GROUP BY 1")
def a35_call_summary(t):
    per = t.conversations.groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.sum(F.regexp_count("text", F.lit("[.!?]"))).alias("marks"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "role", "n"))), lambda s: F.concat(s["role"], F.lit("="), s["n"].cast("string")))
    return per.groupBy("conv_id").agg(F.array_join(lines, ", ").alias("calls"), F.sum("marks").alias("marks"))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(replace(replace(replace('[\"' || lang || '\",\"x\"]', '[', ''), ']', ''), '\"', ''), ',')) AS lang FROM documents) GROUP BY 1")
def a36_json_statuses(t):
    items = F.from_json(F.concat(F.lit('["'), "lang", F.lit('","x"]')), "array<string>")
    return t.documents.select(F.explode(items).alias("lang")).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT bought, round(median(n), 6) AS n, round(median(v), 6) AS v FROM (SELECT user_id, bool_or(event_type = 'purchase' AND value > 55) AS bought, count(*) AS n, avg(value) AS v FROM events GROUP BY 1) GROUP BY 1")
def a37_cohort_medians(t):
    per = t.events.groupBy("user_id").agg(F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 55)).alias("bought"), F.count("*").alias("n"), F.avg("value").alias("v"))
    return per.groupBy("bought").agg(F.round(F.percentile("n", 0.5), 6).alias("n"), F.round(F.percentile("v", 0.5), 6).alias("v"))


@query("SELECT k, CAST(least(count(*) FILTER (WHERE n >= k), 40) AS BIGINT) AS users, CAST(least(count(*) FILTER (WHERE n >= k), 40) * k AS BIGINT) AS units, CAST(sum(least(n, 20)) FILTER (WHERE n >= 3) AS BIGINT) AS capped FROM (SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) FROM events) GROUP BY 1), (SELECT unnest([5, 15, 25]) AS k) GROUP BY k")
def a38_feasibility(t):
    per = t.events.groupBy("user_id").agg(F.countDistinct(F.to_date("ts")).alias("n"))
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.least(F.count_if(F.col("n") >= k), F.lit(40)).alias("users")) for k in (5, 15, 25)])
    one = per.agg(rows.alias("s"), F.sum(F.when(F.col("n") >= 3, F.least("n", F.lit(20)))).alias("capped"))
    return one.select(F.explode("s").alias("r"), "capped").select("r.k", "r.users", (F.col("r.users") * F.col("r.k")).cast("long").alias("units"), F.col("capped").cast("long"))


@query("SELECT CAST(sum(n) * 2 AS BIGINT) AS calls, '{\"users\":' || CAST(count(*) AS VARCHAR) || ',\"turns\":' || CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) || '}' AS summary FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def a40_work_estimate(t):
    per = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    return per.agg((F.sum("n") * 2).alias("calls"), F.to_json(F.struct(F.count("*").alias("users"), F.sum("n").alias("turns"))).alias("summary"))


@query("SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.n, b.n) AS n, coalesce(a.t, '') AS said, coalesce(b.t, '') AS answered FROM (SELECT conv_id, text AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') a FULL JOIN (SELECT conv_id, text AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant') b ON a.conv_id = b.conv_id AND a.n = b.n")
def a44_zipped_dialogue(t):
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long")
    side = lambda role, name: t.conversations.where(F.col("role") == role).select("conv_id", n.alias("n"), F.col("text").alias(name))
    return side("user", "said").join(side("assistant", "answered"), ["conv_id", "n"], "full").select("conv_id", "n", F.coalesce("said", F.lit("")).alias("said"), F.coalesce("answered", F.lit("")).alias("answered"))


@query("SELECT event_id, event_type, value FROM events ORDER BY event_type, value DESC, event_id LIMIT 25")
def o145_mixed_sort(t):
    return t.events.select("event_id", "event_type", "value").orderBy("event_type", F.col("value").desc_nulls_last(), "event_id").limit(25)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal - 5000), c_custkey LIMIT 10")
def o26_nearest_to_target(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.abs(F.col("c_acctbal") - 5000), "c_custkey").limit(10)


@query("SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2)) WHERE (n >= 20 AND r <= 2) OR r = 1")
def o3_threshold_else_first(t):
    per = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    r = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))
    return per.withColumn("r", r).where("(n >= 20 and r <= 2) or r = 1").drop("r")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY least(r, 2), h, doc_id) AS place FROM (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents)) WHERE place <= 30")
def o789_distinct_first(t):
    """One of each source before any second one, in order of a hash."""
    h = F.md5(F.col("doc_id").cast("string"))
    r = F.row_number().over(W.partitionBy("source").orderBy(h, "doc_id"))
    return t.documents.select("doc_id", "source").withColumns({"h": h, "r": r}).orderBy(F.least("r", F.lit(2)), "h", "doc_id").limit(30).select("doc_id")
