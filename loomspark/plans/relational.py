"""Queries over joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vectors as V
from ..operators import joins as J
from .catalogue import query


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j1_left(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1")
def j2_left_other_key(t):
    return t.lineitem.where("l_linenumber = 1").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("SELECT a.conv_id, a.turn, length(b.text) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn WHERE a.role = 'user'")
def j3_two_keys(t):
    other = t.conversations.select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return t.conversations.where("role = 'user'").select("conv_id", "turn").join(other, ["conv_id", "turn"])


@query("SELECT n_name, r_name, CAST(count(*) AS BIGINT) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def j45_dimensions(t):
    star = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return star.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON c_custkey = o_custkey")
def j67_zero_filled(t):
    n = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def j8_semi(t):
    return t.customer.join(t.orders.where("o_totalprice > 450000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def j9_anti(t):
    return t.part.join(t.lineitem.where("l_quantity > 48"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("""SELECT event_id, coalesce(direct, fallback) AS owner FROM (SELECT event_id, user_id, CASE WHEN event_id % 3 <> 0 THEN user_id END AS direct, CAST(user_id % 25 AS INTEGER) AS nk FROM events)
LEFT JOIN (SELECT c_nationkey, fallback FROM (SELECT c_nationkey, o_custkey AS fallback, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, o_custkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2) WHERE n = 1) ON nk = c_nationkey""")
def j10_resolution_chain(t):
    counts = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", "o_custkey").agg(F.count("*").alias("n"))
    modal = counts.groupBy("c_nationkey").agg(F.min_by("o_custkey", F.struct(-F.col("n"), "o_custkey")).alias("fallback"))
    rows = t.events.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("direct"), (F.col("user_id") % 25).alias("c_nationkey"))
    return rows.join(modal, "c_nationkey", "left").select("event_id", F.coalesce("direct", "fallback").alias("owner"))


@query("SELECT event_id, id FROM (SELECT event_id, unnest(list_distinct([user_id % 5, user_id % 7, event_id % 5])) AS id FROM events)")
def j1112_id_lists(t):
    text = F.concat(F.lit("["), (F.col("user_id") % 5).cast("string"), F.lit(","), (F.col("user_id") % 7).cast("string"), F.lit("]"))
    ids = F.array_distinct(F.concat(F.from_json(text, "array<long>"), F.array(F.col("event_id") % 5)))
    return t.events.select("event_id", F.explode(ids).alias("id"))


_SPANS = "SELECT user_id, date_trunc('day', ts) AS day, user_id % 20 AS grp, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1, 2, 3"


@query(f"WITH s AS ({_SPANS}) SELECT a.user_id AS user_a, a.day AS day_a, b.user_id AS user_b, b.day AS day_b FROM s a JOIN s b ON a.grp = b.grp AND a.user_id < b.user_id AND a.lo <= b.hi AND b.lo <= a.hi")
def j13_interval_overlap(t):
    s = t.events.groupBy(F.col("user_id").alias("user"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), (F.col("user_id") % 20).alias("grp")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return J.self_overlaps(s, "grp", "user", ("lo", "hi"), 86400).select("user_a", "day_a", "user_b", "day_b")


@query("SELECT a.event_id AS signup, b.event_id AS near, b.ts >= a.ts AS later FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts - INTERVAL 6 HOUR AND a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'signup'")
def j14_padded_window(t):
    a = t.events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup"), F.col("ts").alias("at"))
    b = t.events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("near"), "ts")
    return a.join(b, "user_id").where("ts BETWEEN at - INTERVAL 6 HOUR AND at + INTERVAL 6 HOUR").select("signup", "near", F.expr("ts >= at").alias("later"))


@query("""SELECT event_id, next_id, CASE WHEN next_id IS NULL AND any_later THEN 'too far' WHEN next_id IS NULL THEN 'none' ELSE 'found' END AS reason FROM (
SELECT a.event_id, arg_min(b.event_id, b.ts) FILTER (WHERE b.ts <= a.ts + INTERVAL 24 HOUR) AS next_id, count(b.event_id) > 0 AS any_later FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.ts >= a.ts WHERE a.event_type = 'click' GROUP BY 1)""")
def j15_next_with_tolerance(t):
    left = t.events.where("event_type = 'click'").select("user_id", "ts", "event_id")
    right = t.events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("next_id"))
    got = J.asof_forward(left, right, ["user_id"], "ts", ["next_id"])
    near = F.expr("next_at <= ts + INTERVAL 24 HOUR")
    return got.select("event_id", F.when(near, F.col("next_id")).alias("next_id"), F.when(near, "found").when(F.col("next_id").isNotNull(), "too far").otherwise("none").alias("reason"))


@query("SELECT a.conv_id, a.turn, max(b.turn) AS prompt_turn FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.role = 'user' AND b.turn <= a.turn WHERE a.role = 'assistant' GROUP BY 1, 2")
def j16_asof_backward(t):
    left = t.conversations.where("role = 'assistant'").select("conv_id", "turn")
    right = t.conversations.where("role = 'user'").select("conv_id", "turn", F.col("turn").alias("prompt_turn"))
    return J.asof_backward(left, right, ["conv_id"], "turn", ["prompt_turn"])


@query("SELECT a.event_id, CAST(count(b.event_id) AS BIGINT) AS bin FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'signup' AND b.ts < a.ts WHERE a.event_type = 'view' GROUP BY 1")
def j17_boundary_bins(t):
    """Boundaries before a row, by one running count: a boundary at the row's own time comes after it."""
    mark = F.when(F.col("event_type") == "signup", 1).otherwise(0)
    n = F.sum(mark).over(W.partitionBy("user_id").orderBy("ts", mark.asc()).rowsBetween(W.unboundedPreceding, 0))
    return t.events.where("event_type IN ('view', 'signup')").withColumn("bin", n).where("event_type = 'view'").select("event_id", F.col("bin").cast("long"))


@query("SELECT user_id, event_type, event_id, CAST(date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') AS BIGINT) AS stale_days FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-20') WHERE n = 1")
def j18_snapshot(t):
    seen = t.events.where("ts <= TIMESTAMP_NTZ '2024-01-20 00:00:00'").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return seen.select("user_id", "event_type", "m.event_id", F.datediff(F.lit("2024-01-20").cast("date"), F.col("m.ts").cast("date")).cast("long").alias("stale_days"))


@query("""WITH c AS (SELECT DISTINCT s_nationkey % 3 AS g, 'src/m' || CAST(s_suppkey % 4 AS VARCHAR) || '/f' || CAST(s_suppkey % 9 AS VARCHAR) || '.py' AS c FROM supplier),
a AS (SELECT p_partkey, p_size % 3 AS g, '/home/u/src/m' || CAST(p_partkey % 6 AS VARCHAR) || '/f' || CAST(p_size % 11 AS VARCHAR) || '.py' AS p FROM part)
SELECT p_partkey, coalesce(arg_max(c, length(c)) FILTER (WHERE ends_with(p, '/' || c)), CASE WHEN count(c) = 1 THEN min(c) END) AS matched FROM a LEFT JOIN c ON a.g = c.g AND split_part(c, '/', 3) = split_part(p, '/', 6) GROUP BY 1""")
def j19_path_suffix(t):
    c = t.supplier.select((F.col("s_nationkey") % 3).alias("g"), F.concat(F.lit("src/m"), (F.col("s_suppkey") % 4).cast("string"), F.lit("/f"), (F.col("s_suppkey") % 9).cast("string"), F.lit(".py")).alias("c"))
    a = t.part.select("p_partkey", (F.col("p_size") % 3).alias("g"), F.concat(F.lit("/home/u/src/m"), (F.col("p_partkey") % 6).cast("string"), F.lit("/f"), (F.col("p_size") % 11).cast("string"), F.lit(".py")).alias("p"))
    return J.suffix_match(a, c, ["g"], "p", "c", ["p_partkey"])


@query("SELECT CAST(count(*) AS BIGINT) AS edges FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber")
def j20_within_key(t):
    other = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("other"))
    return t.lineitem.select("l_orderkey", "l_linenumber").join(other, "l_orderkey").where("l_linenumber < other").agg(F.count("*").alias("edges"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey")
def j2123_cross(t):
    """Each with every other of a small side; crossed() refuses one that is not small."""
    return J.crossed(t.nation.select(F.col("n_nationkey").alias("a")), t.nation.select(F.col("n_nationkey").alias("b"))).where("a <> b")


@query("SELECT vec_id, label AS other, round(sum(v * c) / sqrt(sum(v * v) * sum(c * c)), 6) AS cos FROM (SELECT vec_id, i, v, label, c FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) x JOIN (SELECT label, i, avg(v) AS c FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) y USING (i)) GROUP BY 1, 2")
def j22_rows_by_clusters(t):
    from ..operators.geometry import centroids

    c = centroids(t.embeddings, "label", "embedding").select(F.col("label").alias("other"), "center")
    pairs = J.crossed(t.embeddings.select("vec_id", V.doubles(F.col("embedding")).alias("v")), c)
    return pairs.select("vec_id", "other", F.round(V.cosine(F.col("v"), F.col("center")), 6).alias("cos"))


@query("""WITH c AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i, vec_id % 2 AS h FROM embeddings WHERE vec_id % 2 = 0) GROUP BY 1, 2),
d AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 2 = 1) GROUP BY 1, 2),
s AS (SELECT c.label AS a, d.label AS b, sum(c.v * d.v) / sqrt(sum(c.v * c.v) * sum(d.v * d.v)) AS cos FROM c JOIN d USING (i) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) AS one, row_number() OVER (PARTITION BY b ORDER BY cos DESC, a) AS two FROM s)
SELECT a, b, round(cos, 6) AS cos FROM r WHERE one = 1 AND two = 1""")
def j24_mutual_nearest(t):
    from ..operators.geometry import centroids

    one, two = (centroids(t.embeddings.where(F.col("vec_id") % 2 == k), "label", "embedding").select(F.col("label").alias(n), F.col("center").alias(f"v{n}")) for k, n in ((0, "a"), (1, "b")))
    pairs = one.crossJoin(two).select("a", "b", V.cosine(F.col("va"), F.col("vb")).alias("cos"))  # clusters by clusters
    return J.mutual_nearest(pairs, "a", "b", F.col("cos")).select("a", "b", F.round("cos", 6).alias("cos"))


@query("SELECT a.axis AS a, b.axis AS b, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT user_id, event_type AS axis FROM events) a JOIN (SELECT DISTINCT user_id, event_type AS axis FROM events) b ON a.user_id = b.user_id AND a.axis < b.axis GROUP BY 1, 2")
def j25_axis_pairs(t):
    a = t.events.select("user_id", F.col("event_type").alias("a")).distinct()
    return a.join(a.withColumnRenamed("a", "b"), "user_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'click'), p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'view')
SELECT u.user_id, u.event_id AS call_id, p.event_id AS result_id FROM u LEFT JOIN p ON u.user_id = p.user_id AND u.n = p.n""")
def j26_calls_and_results(t):
    calls = t.events.where("event_type = 'click'").select("user_id", "event_id")
    results = t.events.where("event_type = 'view'").select("user_id", "event_id", F.col("event_id").alias("result_id"))
    return J.nth_pairs(calls, results, ["user_id"], "event_id", ["result_id"]).withColumnRenamed("event_id", "call_id")


@query("SELECT o_custkey, round(max(o_totalprice) FILTER (WHERE n = 1), 2) AS baseline, round(max(o_totalprice) FILTER (WHERE n = 2), 2) AS intervention FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders) WHERE n <= 2 AND c >= 2 GROUP BY 1")
def j27_complete_pairs(t):
    w = W.partitionBy("o_custkey")
    rows = t.orders.withColumns({"n": F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")), "c": F.count("*").over(w)}).where("n <= 2 and c >= 2")
    rows = rows.withColumn("condition", F.when(F.col("n") == 1, "baseline").otherwise("intervention"))
    return J.complete_pairs(rows, ["o_custkey"], "condition", ["baseline", "intervention"], F.round("o_totalprice", 2))


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events c WHERE c.user_id = e.user_id AND c.event_type = e.event_type AND c.event_id % 4 = 0 AND c.value >= 10)")
def j28_cache_misses(t):
    cache = t.events.where("event_id % 4 = 0 and value >= 10").select("user_id", F.sha2("event_type", 256).alias("h")).distinct()
    return t.events.withColumn("h", F.sha2("event_type", 256)).join(cache, ["user_id", "h"], "left_anti").select("event_id")


@query("SELECT conv_id, turn, coalesce(said, '') AS said FROM (SELECT a.conv_id, a.turn, b.text AS said FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'user')")
def j29_attached_text(t):
    b = t.conversations.where("role = 'user'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("said"))
    return t.conversations.select("conv_id", "turn").join(b, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("said", F.lit("")).alias("said"))


@query("SELECT q.conv_id, q.turn AS quoted, c.turn AS found FROM conversations q JOIN conversations c ON q.conv_id = c.conv_id AND q.role = 'user' AND q.text IS NOT NULL AND c.text IS NOT NULL AND len(list_filter(string_split(q.text, '. '), lambda s: NOT contains(c.text, s))) = 0")
def j30_contained_quotes(t):
    """Turns that hold every sentence of a user's turn, of the whole text."""
    q = t.conversations.where("role = 'user'").select("conv_id", F.col("turn").alias("quoted"), F.split("text", r"\. ").alias("segs"))
    return q.join(t.conversations, "conv_id").where(F.forall("segs", lambda s: F.contains("text", s))).select("conv_id", "quoted", F.col("turn").alias("found"))


@query("SELECT event_type, day, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_type, strftime(ts, '%Y-%m-%d') FROM events WHERE event_id % 2 = 1) GROUP BY 1, 2")
def u1_union(t):
    parts = [t.events.where(F.col("event_id") % 2 == k).select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")) for k in range(2)]
    return parts[0].unionByName(parts[1]).groupBy("event_type", "day").agg(F.count("*").alias("n"))


@query("SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def u2_intersect(t):
    return t.events.where("event_type = 'purchase'").select("user_id").intersect(t.events.where("event_type = 'error'").select("user_id"))


@query("SELECT 'left' AS side, o_custkey AS k FROM (SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM events) UNION ALL SELECT 'right', user_id FROM (SELECT user_id FROM events EXCEPT SELECT o_custkey FROM orders)")
def u3_except_both_ways(t):
    a, b = t.orders.select(F.col("o_custkey").alias("k")), t.events.select(F.col("user_id").alias("k"))
    return a.subtract(b).select(F.lit("left").alias("side"), "k").unionByName(b.subtract(a).select(F.lit("right").alias("side"), "k"))


@query("SELECT o_custkey AS k FROM orders UNION SELECT user_id FROM events")
def u4_union_distinct(t):
    return t.orders.select(F.col("o_custkey").alias("k")).union(t.events.select("user_id")).distinct()


@query("SELECT kind, id, moment, who, row_number() OVER (PARTITION BY who ORDER BY moment, kind, id) AS place FROM (SELECT user_id AS who, 'event' AS kind, event_id AS id, ts AS moment FROM events UNION ALL SELECT o_custkey, 'order', o_orderkey, o_orderdate FROM orders)")
def u5_interleaved(t):
    both = t.events.select(F.col("user_id").alias("who"), F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("moment")).unionByName(t.orders.select(F.col("o_custkey").alias("who"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("moment")))
    return both.withColumn("place", F.row_number().over(W.partitionBy("who").orderBy("moment", "kind", "id")).cast("long"))
