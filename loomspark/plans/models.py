"""Queries over model calls as relations, and small models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import geometry as G
from ..operators import judging as L
from ..operators import models as M
from ..operators import trees as TR
from .catalogue import query


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 AND event_id % 8 <> 0 THEN 'cached' END AS kept, event_id % 8 = 4 AS cached FROM events WHERE event_type = 'signup'")
def l1_cached_judgments(t):
    """Of a failed and a good record of a prompt the good one counts; the stand-in sees the rest."""
    asks = t.events.where("event_type = 'signup'").select("event_id", L.prompt_hash(F.col("event_id").cast("string"), F.col("event_type")).alias("prompt_hash"))
    old = asks.where("event_id % 4 = 0").select("event_id", "prompt_hash", F.lit("cached").alias("answer"), (F.col("event_id") % 8 == 0).alias("failed"), F.lit(1).alias("position"))
    got = L.judged(asks, old, ["event_id"], L.stub_answer(["high", "low", "na"]))
    return got.select("event_id", F.when(F.col("cached"), F.col("answer")).alias("kept"), "cached")


@query("""WITH x AS (SELECT event_id, list_distinct(list_filter([event_id % 14, 40, (event_id * 3) % 14, (event_id + 5) % 14], lambda a: a < 14)) AS active, event_id % 11 = 0 AS lost FROM events WHERE event_type = 'signup')
SELECT event_id, CAST(a AS BIGINT) AS axis, CAST(CASE WHEN lost OR NOT list_contains(active, a) OR (event_id + a) % 7 = 0 OR (event_id + a) % 5 = 0 THEN 0 WHEN (event_id + a) % 2 = 0 THEN 1 ELSE -1 END AS INTEGER) AS score,
lost OR len(list_filter(active, lambda b: (event_id + b) % 7 = 0)) > 0 AS failed FROM x, (SELECT unnest(range(0, 14)) AS a)""")
def l1_two_stage_scores(t):
    """A stand-in screens and directs: some screens fail, some directions do, some are none."""
    turns, k = t.events.where("event_type = 'signup'").select("event_id"), F.col("event_id")
    screen = lambda df: df.withColumns({"triggered": F.array(k % 14, F.lit(40).cast("long"), (k * 3) % 14, (k + 5) % 14), "failed": k % 11 == 0})
    sum_ = k + F.col("axis")
    direct = lambda df: df.withColumns({"direction": F.when(sum_ % 5 == 0, 7).when(sum_ % 2 == 0, 1).otherwise(-1), "evidence": F.lit("said"), "failed": sum_ % 7 == 0})
    return L.two_stage_scores(turns, ["event_id"], list(range(14)), screen, direct).select("event_id", F.col("axis").cast("long").alias("axis"), "score", "failed")


@query("""SELECT conv_id, string_agg(CASE role WHEN 'assistant' THEN 'ASSISTANT: ' || trim(text) WHEN 'user' THEN 'TOOL ' || CASE WHEN turn % 3 = 0 THEN 'Edit' ELSE 'Read' END || ': ' || trim(text) ELSE '  -> ' || replace(trim(text), chr(10), ' ') END, chr(10) ORDER BY turn) AS text,
CAST(count(*) FILTER (WHERE role = 'user') AS BIGINT) AS n_calls, CAST(count(*) FILTER (WHERE role = 'user' AND turn % 3 = 0) AS BIGINT) AS edit_calls, CAST(count(*) FILTER (WHERE role = 'user' AND turn % 3 = 0 AND (f IS NULL OR turn < f)) AS BIGINT) AS edits_before_text, false AS plan_mode
FROM (SELECT *, min(turn) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) AS f FROM conversations) GROUP BY 1""")
def l6_rendered_turns(t):
    role = F.col("role")
    kind = F.when(role == "assistant", "said").when(role == "user", "called").otherwise("returned")
    blocks = t.conversations.select("conv_id", "turn", kind.alias("kind"), F.when(F.col("turn") % 3 == 0, "Edit").otherwise("Read").alias("name"), F.col("text").alias("body"))
    return L.rendered_turns(blocks, ["conv_id"], "turn")


@query("SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN axis >= 14 THEN 'unknown axis' WHEN label NOT IN ('high', 'low', 'na') THEN 'unknown label' WHEN axis IN (0, 3) AND label = 'low' THEN 'no low side' WHEN label <> 'na' AND trim(evidence) = '' THEN 'no evidence' WHEN label = 'na' AND trim(evidence) <> '' THEN 'evidence without label' END AS reason FROM (SELECT event_id % 15 AS axis, CASE event_type WHEN 'purchase' THEN 'high' WHEN 'error' THEN 'low' WHEN 'view' THEN 'odd' ELSE 'na' END AS label, CASE WHEN event_id % 2 = 0 THEN 'said' ELSE ' ' END AS evidence FROM events)) GROUP BY 1")
def l2_judgment_checks(t):
    kind = F.col("event_type")
    label = F.when(kind == "purchase", "high").when(kind == "error", "low").when(kind == "view", "odd").otherwise("na")
    reason = L.invalid_reason(label, F.col("event_id") % 15, F.when(F.col("event_id") % 2 == 0, "said").otherwise(" "), 14, [0, 3])
    return t.events.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT user_id, CAST(14 - count(DISTINCT event_id % 14) AS BIGINT) AS missing, CAST(count(*) - count(DISTINCT event_id % 14) AS BIGINT) AS repeated FROM events WHERE event_type = 'signup' GROUP BY 1")
def l3_complete_judgments(t):
    rows = t.events.where("event_type = 'signup'").withColumn("axis", F.col("event_id") % 14)
    return L.complete_judgments(rows, ["user_id"], "axis", 14)


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'pass' END AS verdict FROM events WHERE event_type = 'purchase'")
def l5_verdicts(t):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.lit('Reason.\n```json\n{"verdict": "PASS", "why": "x"}\n```')).when(k == 1, F.lit("a\nVerdict: fail\nb")).when(k == 2, F.lit('{"verdict": "success"}')).otherwise(F.lit("none at all"))
    return t.events.where("event_type = 'purchase'").select("event_id", L.verdict(text).alias("verdict"))


def _slow_judge(prompt: str, attempt: int) -> str:
    """A stand-in for a service: some prompts fail at first, some always."""
    if len(prompt) % 17 == 0 or len(prompt) % 5 == 0 and attempt == 0:
        raise TimeoutError("no answer in time")
    return '{"verdict": "pass"}' if len(prompt) % 2 else "verdict: fail"


@query("SELECT conv_id || ':' || turn AS id, n % 17 = 0 AS failed, CAST(CASE WHEN n % 17 = 0 THEN 3 WHEN n % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempts, CASE WHEN n % 17 = 0 THEN NULL WHEN n % 2 = 1 THEN 'pass' ELSE 'fail' END AS verdict FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS n FROM conversations WHERE role = 'user')")
def l5_called_verdicts(t):
    """Calls with a bounded number in flight, tried again and logged; verdicts of their answers."""
    from ..operators.calls import called
    from ..sources.tables import workspace

    asked = t.conversations.where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    got = called(asked, "id", "text", _slow_judge, workspace(t.spark), attempts=3, wait=0.0)
    return got.select("id", "failed", "attempts", L.verdict(F.col("answer")).alias("verdict"))


@query("SELECT user_id, round(e + 0.2::DOUBLE * s, 6) AS score, round(CASE WHEN a = 0 THEN NULL ELSE (b - a) * 100.0 / a END, 6) AS change FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS e, count(*) FILTER (WHERE event_type = 'signup') AS s, count(*) FILTER (WHERE event_type = 'signup' AND event_id % 2 = 0) AS a, count(*) FILTER (WHERE event_type = 'signup' AND event_id % 2 = 1) AS b FROM events GROUP BY 1)")
def m5_correction_scores(t):
    kind, odd = F.col("event_type"), F.col("event_id") % 2
    n = t.events.groupBy("user_id").agg(F.count_if(kind == "error").alias("e"), F.count_if(kind == "signup").alias("s"), F.count_if((kind == "signup") & (odd == 0)).alias("a"), F.count_if((kind == "signup") & (odd == 1)).alias("b"))
    return n.select("user_id", F.round(L.correction_score(F.col("e"), F.col("s")), 6).alias("score"), F.round(L.change_percent(F.col("a"), F.col("b")), 6).alias("change"))


@query("SELECT n_nationkey, '## Use' || chr(10) || n_name AS body, CASE WHEN n_nationkey % 2 = 0 THEN 'Limits' ELSE '' END AS missing FROM nation")
def x13_skill_text(t):
    inner = F.concat(F.lit("## Use\n"), "n_name")
    more = F.when(F.col("n_nationkey") % 2 == 0, F.lit("")).otherwise(F.lit("\n# Limits\n"))
    return t.nation.select("n_nationkey", L.unfenced(F.concat(F.lit("```markdown\n"), inner, F.lit("\n```"))).alias("body"), F.array_join(L.missing_headings(F.concat(inner, more), ["Use", "Limits"]), ",").alias("missing"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name || chr(10) || 'second' WHEN 1 THEN '  1' || chr(9) || n_name || chr(10) || 'second' || chr(10) || 'third' ELSE n_name END AS text FROM nation")
def x12_unnumbered(t):
    """Numbers go where most lines have one, and stay where few have."""
    k, one = F.col("n_nationkey") % 3, F.concat(F.lit("  1\t"), "n_name")
    text = F.when(k == 0, F.concat(one, F.lit("\n  2\tsecond"))).when(k == 1, F.concat(one, F.lit("\nsecond\nthird"))).otherwise(F.col("n_name"))
    return t.nation.select("n_nationkey", L.unnumbered(text).alias("text"))


@query("WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT vec_id, round(sum((v - m) * (v - m)), 4) AS spread FROM x JOIN (SELECT i, avg(v) AS m FROM x GROUP BY 1) USING (i) GROUP BY 1")
def c8_principal_axes(t):
    """Turning to principal axes keeps each row's squared distance from the mean; the axes themselves have no SQL twin."""
    scores, _ = M.principal_axes(t.embeddings, "vec_id", "embedding", 10_000)
    return scores.select("vec_id", F.round(V.dot(F.col("scores"), F.col("scores")), 4).alias("spread"))


@query()
def c8_projection(t):
    """Each row on the two axes of largest variance, with their shares."""
    scores, shares = M.principal_axes(t.embeddings, "vec_id", "embedding")
    return scores.select("vec_id", F.col("scores")[0].alias("x"), F.col("scores")[1].alias("y"), F.lit(shares[0]).alias("share_x"), F.lit(shares[1]).alias("share_y"))


@query()
def c11_stability(t):
    """How far the centres of random parts of the rows lie from those of all, matched one to one."""
    from ..operators.resampling import random_parts

    e = t.embeddings.select("vec_id", "embedding")
    _, whole = G.kmeans(e, "vec_id", "embedding", 4, seed=1, starts=3, rounds=10)
    rows = []
    for share in (0.5, 0.8):
        part = random_parts(e, ["vec_id"], 9, 1, share).where("part = 'first'")
        _, own = G.kmeans(part, "vec_id", "embedding", 4, seed=1, starts=3, rounds=10)
        match, total = M.matched_centers(np.array(whole["centers"]), np.array(own["centers"]))
        rows.append((share, total / len(match)))
    return t.spark.createDataFrame(rows, "share double, mean_distance double")


@query()
def c13_leaf_order(t):
    rows = sorted((r.label, r.center) for r in G.centroids(t.embeddings, "label", "embedding").select("label", "center").collect())  # a row for each cluster
    order = M.leaf_order(np.array([c for _, c in rows]))
    return t.spark.createDataFrame([(k, rows[j][0]) for k, j in enumerate(order)], "place int, label int")


_PER = """WITH per AS (SELECT user_id, CAST(floor(max(value)) % 4 AS INTEGER) AS label, round(avg(value), 0) AS mean_value, CAST(nullif(count(*) FILTER (WHERE event_type = 'error'), 12) AS DOUBLE) AS errors, median(value) FILTER (WHERE event_type = 'click') AS clicked FROM events GROUP BY 1)"""
_AXES = ["mean_value", "errors", "clicked"]


def _per_user(t):
    """Users with a label and three axes, one with gaps."""
    return t.events.groupBy("user_id").agg(
        (F.floor(F.max("value")) % 4).cast("int").alias("label"),
        F.round(F.avg("value"), 0).alias("mean_value"),
        F.nullif(F.count_if(F.col("event_type") == "error"), F.lit(12)).cast("double").alias("errors"),
        F.percentile(F.when(F.col("event_type") == "click", F.col("value")), 0.5).alias("clicked"),
    )


@query()
def c14_explaining_tree(t):
    """An exact tree of depth 2, with leaves of five users or more."""
    rows = TR.explain_labels(_per_user(t), "label", _AXES, 2)
    return t.spark.createDataFrame(rows, "node int, depth int, axis string, threshold double, missing_goes string, gain double, label int, n int, counts array<int>")


@query(f"""{_PER}, long AS (SELECT user_id, label, 0 AS axis, mean_value AS v FROM per UNION ALL SELECT user_id, label, 1, errors FROM per UNION ALL SELECT user_id, label, 2, clicked FROM per),
d AS (SELECT axis, v + (lead(v) OVER (PARTITION BY axis ORDER BY v) - v) / 2 AS t FROM (SELECT DISTINCT axis, v FROM long WHERE v IS NOT NULL)),
s AS (SELECT axis, t, missing_left, label, count(*) AS n, count(*) FILTER (WHERE CASE WHEN v IS NULL THEN missing_left ELSE v <= t END) AS l FROM long JOIN d USING (axis), (SELECT unnest([true, false]) AS missing_left) WHERE t IS NOT NULL GROUP BY 1, 2, 3, 4),
g AS (SELECT axis, t, missing_left, sum(l) AS nl, sum(n - l) AS nr, round((CAST(sum(l * l) AS DOUBLE) / sum(l) + CAST(sum((n - l) * (n - l)) AS DOUBLE) / sum(n - l)) / sum(n) - CAST(sum(n * n) AS DOUBLE) / (sum(n) * sum(n)), 12) AS gain FROM s GROUP BY 1, 2, 3 HAVING sum(l) >= 5 AND sum(n - l) >= 5)
SELECT ['mean_value', 'errors', 'clicked'][axis + 1] AS axis, round(t, 6) AS threshold, CASE WHEN missing_left THEN 'left' ELSE 'right' END AS missing_goes, round(gain, 9) AS gain, CAST(nl AS BIGINT) AS n_left, CAST(nr AS BIGINT) AS n_right FROM g ORDER BY g.gain DESC, g.axis, t, missing_left DESC LIMIT 1""")
def c14_first_split(t):
    """The root's split, over all axes, thresholds and ways of missing values."""
    per = _per_user(t)
    tree = {r["node"]: r for r in TR.explain_labels(per, "label", _AXES, 1)}
    root = tree[1]
    return t.spark.createDataFrame([(root["axis"], round(root["threshold"], 6), root["missing_goes"], round(root["gain"], 9), tree[2]["n"], tree[3]["n"])], "axis string, threshold double, missing_goes string, gain double, n_left long, n_right long")


@query()
def c14_tree_predictions(t):
    """Each user's leaf and whether it is right; the rows of the tree are checked by hand-made trees."""
    per = _per_user(t)
    got = TR.predicted(per, TR.explain_labels(per, "label", _AXES, 3))
    return got.select("user_id", "label", "tree_prediction", (F.col("label") == F.col("tree_prediction")).alias("correct"))


@query("SELECT conv_id, turn, CAST(len(string_split(text, ' ')) AS BIGINT) AS said FROM conversations WHERE role = 'user' AND length(text) >= 20")
def f16_real_prompts(t):
    entry = F.parse_json(F.to_json(F.struct("role", F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"))))
    rows = t.conversations.select("conv_id", "turn", entry.alias("e"))
    text = F.try_variant_get("e", "$.content[0].text", "string")
    fine = (F.try_variant_get("e", "$.role", "string") == "user") & (F.try_variant_get("e", "$.content[0].type", "string") == "text") & (F.length(text) >= 20)
    return rows.where(fine).select("conv_id", "turn", F.size(F.split(text, " ")).cast("long").alias("said"))


@query("SELECT c_custkey, 1.0::DOUBLE + (c_acctbal > 5000)::INT * 10 + 2 * (c_nationkey % 3) AS rank_score FROM customer ORDER BY rank_score DESC, c_custkey LIMIT 50")
def t2223_candidate_scores(t):
    score = F.lit(1.0) + (F.col("c_acctbal") > 5000).cast("int") * 10 + 2 * (F.col("c_nationkey") % 3)
    return t.customer.select("c_custkey", score.cast("double").alias("rank_score")).orderBy(F.desc("rank_score"), "c_custkey").limit(50)


@query("WITH e AS (SELECT * FROM (VALUES (1, 'AUTOMOBILE'), (2, 'nothing')) v(id, want)) SELECT id, want, CAST(count(c_custkey) AS BIGINT) > 0 AS found FROM e LEFT JOIN customer ON c_mktsegment = want GROUP BY 1, 2")
def a43_expected_cases(t):
    e = t.spark.createDataFrame([(1, "AUTOMOBILE"), (2, "nothing")], "id int, want string")
    return e.join(t.customer, F.col("c_mktsegment") == F.col("want"), "left").groupBy("id", "want").agg((F.count("c_custkey") > 0).alias("found"))


@query("WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(avg((a.v - b.v) * (a.v - b.v))), 6) AS d FROM x a JOIN x b ON a.i = b.i AND a.vec_id <> b.vec_id AND a.vec_id % 100 = 0 WHERE (a.i + a.vec_id) % 3 <> 0 AND (b.i + b.vec_id) % 3 <> 0 GROUP BY 1, 2")
def c10_masked_distances(t):
    """Places that either side lacks do not count."""
    masked = F.transform(V.doubles(F.col("embedding")), lambda v, i: F.when((i + 1 + F.col("vec_id")) % 3 != 0, v))
    e = t.embeddings.withColumn("masked", masked)
    d = G.distances(e, "vec_id", "masked", "label", e.where("vec_id % 100 = 0"), masked=True)  # a stated query set against all rows
    return d.select("a", "b", F.round("d", 6).alias("d"))
