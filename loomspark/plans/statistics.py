"""Queries over statistics, resampling and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import stats as ST
from ..operators import preferences as P
from ..operators import resampling as R
from ..operators import statistics as S
from .catalogue import query
from .preferences import SESSIONS, TURNS

_M = f"WITH {SESSIONS}, m AS (SELECT axis, user_id, count(*)::DOUBLE AS n, avg(mean) AS mean, var_pop(mean) * count(*) AS m2 FROM v GROUP BY 1, 2)"


def _moments(t):
    return S.group_moments(P.vectors(P.turn_scores(t.events), ["user_id", "session"]), ["axis"], "user_id", "mean")


_ICC = "a AS (SELECT axis, count(*) AS k, sum(n) AS r, sum(n * n) AS nn, sum(n * mean) AS s, sum(n * mean * mean) AS ss, sum(m2) AS ssw FROM m GROUP BY 1), b AS (SELECT axis, k, r, (ss - s * s / r) / (k - 1) AS msb, ssw / (r - k) AS msw, (r - nn / r) / (k - 1) AS n0 FROM a)"


@query(f"{_M}, {_ICC} SELECT axis, CAST(k AS BIGINT) AS n_groups, CAST(r AS BIGINT) AS n_rows, round((msb - msw) / (msb + (n0 - 1) * msw), 6) AS icc, 'ok' AS reason FROM b")
def t1_icc(t):
    return S.icc(_moments(t), ["axis"]).withColumn("icc", F.round("icc", 6))


@query(f"{_M.replace('FROM v GROUP', 'FROM v WHERE support > 0 GROUP')}, {_ICC} SELECT axis, CAST(k AS BIGINT) AS n_groups, CAST(r AS BIGINT) AS n_rows, round((msb - msw) / (msb + (n0 - 1) * msw), 6) AS icc FROM b")
def t3_conditional_icc(t):
    v = P.vectors(P.turn_scores(t.events), ["user_id", "session"]).where("support > 0")
    return S.icc(S.group_moments(v, ["axis"], "user_id", "mean"), ["axis"]).select("axis", "n_groups", "n_rows", F.round("icc", 6).alias("icc"))


@query(f"""WITH {SESSIONS}, x AS (SELECT arm, axis, user_id, method, val FROM (SELECT axis, user_id, 'recent' AS method, recent::DOUBLE AS val FROM v UNION ALL SELECT axis, user_id, 'majority', majority FROM v UNION ALL SELECT axis, user_id, 'mean', mean FROM v), (SELECT unnest(['all', 'even', 'odd']) AS arm) WHERE arm = 'all' OR (arm = 'even') = (user_id % 2 = 0)),
m AS (SELECT arm, axis, method, user_id, count(*)::DOUBLE AS n, avg(val) AS mean, var_pop(val) * count(*) AS m2 FROM x GROUP BY 1, 2, 3, 4), a AS (SELECT arm, axis, method, count(*) AS k, sum(n) AS r, sum(n * n) AS nn, sum(n * mean) AS s, sum(n * mean * mean) AS ss, sum(m2) AS ssw FROM m GROUP BY 1, 2, 3)
SELECT arm, axis, method, round(((ss - s * s / r) / (k - 1) - ssw / (r - k)) / ((ss - s * s / r) / (k - 1) + ((r - nn / r) / (k - 1) - 1) * ssw / (r - k)), 6) AS icc FROM a""")
def t2_icc_table(t):
    v = P.vectors(P.turn_scores(t.events), ["user_id", "session"]).select("user_id", "axis", F.col("recent").cast("double"), F.col("majority").cast("double"), "mean")
    long = v.unpivot(["user_id", "axis"], ["recent", "majority", "mean"], "method", "val")
    arms = long.withColumn("arm", F.explode(F.array(F.lit("all"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))))
    return S.icc(S.group_moments(arms, ["arm", "axis", "method"], "user_id", "val"), ["arm", "axis", "method"]).select("arm", "axis", "method", F.round("icc", 6).alias("icc"))


@query(f"{_M} SELECT axis, round(var_samp(mean), 6) AS between, round(avg(m2 / (n - 1)) FILTER (WHERE n > 1), 6) AS within, round(var_samp(mean) / avg(m2 / (n - 1)) FILTER (WHERE n > 1), 6) AS ratio FROM m GROUP BY 1".replace("AS between", 'AS "between"'))
def t4_variance_ratio(t):
    return S.variance_ratio(_moments(t), ["axis"]).select("axis", *[F.round(c, 6).alias(c) for c in ("between", "within", "ratio")])


@query("WITH p AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error')::DOUBLE AS k, count(*)::DOUBLE AS n, 1.959963984540054::DOUBLE AS z FROM events GROUP BY 1) SELECT user_id, round(greatest(0.0, (k / n + z * z / 2 / n - z * sqrt(k / n * (1 - k / n) / n + z * z / 4 / n / n)) / (1 + z * z / n)), 6) AS low, round(least(1.0, (k / n + z * z / 2 / n + z * sqrt(k / n * (1 - k / n) / n + z * z / 4 / n / n)) / (1 + z * z / n)), 6) AS high FROM p")
def t5_wilson(t):
    per = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("k"), F.count("*").alias("n"))
    low, high = ST.wilson(F.col("k"), F.col("n"))
    return per.select("user_id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("WITH p AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS k, count(*) AS n FROM events GROUP BY 1) SELECT user_id, round(least(1.0, coalesce(sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.2) + (n - j) * ln(0.8))) FILTER (WHERE j >= k), 1.0)), 5) AS p FROM p, (SELECT unnest(range(0, 400)) AS j) WHERE j <= n GROUP BY user_id")
def t6_binomial_tail(t):
    per = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").cast("int").alias("k"), F.count("*").cast("int").alias("n"))
    return per.select("user_id", F.round(ST.binomial_survival(F.col("k"), F.col("n"), F.lit(0.2)), 5).alias("p"))


@query("""WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS a, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS b, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS c, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS d FROM labels)
SELECT CAST(a AS BIGINT) AS n11, CAST(b AS BIGINT) AS n10, CAST(c AS BIGINT) AS n01, CAST(d AS BIGINT) AS n00, round((a * d - b * c) / sqrt((a + b)::DOUBLE * (c + d) * (a + c) * (b + d)), 6) AS phi, round(a / (a + b + c), 6) AS jaccard, round(a * (a + b + c + d) / ((a + b) * (a + c)), 6) AS lift, round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 6) AS odds FROM c""")
def t78_two_by_two(t):
    n = S.cell_counts(t.labels, [], F.col("quality") == 1, F.col("toxic") == 1)
    c = [F.col(x) for x in ("n11", "n10", "n01", "n00")]
    return n.select(*c, F.round(ST.phi(*c), 6).alias("phi"), F.round(ST.jaccard(*c[:3]), 6).alias("jaccard"), F.round(ST.lift(*c), 6).alias("lift"), F.round(ST.odds_ratio(*c), 6).alias("odds"))


@query("""WITH c AS (SELECT user_id % 5 AS g, count(*) FILTER (WHERE event_type = 'error' AND value > 40) AS a, count(*) FILTER (WHERE event_type = 'error' AND NOT value > 40) AS b, count(*) FILTER (WHERE event_type <> 'error' AND value > 40) AS c, count(*) FILTER (WHERE event_type <> 'error' AND NOT value > 40) AS d FROM events GROUP BY 1),
p AS (SELECT g, k, a, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1)) AS p FROM c, (SELECT unnest(range(0, 100000)) AS k) WHERE k BETWEEN greatest(0, a - d) AND least(a + b, a + c))
SELECT g, round(least(1.0, sum(p.p) FILTER (WHERE p.p <= o.p * (1 + 1e-7))), 6) AS p FROM p JOIN (SELECT g AS og, p FROM p WHERE k = a) o ON g = og GROUP BY g""")
def t8_fisher(t):
    rows = t.events.withColumn("g", F.col("user_id") % 5)
    n = S.cell_counts(rows, ["g"], F.col("event_type") == "error", F.col("value") > 40)
    return n.select("g", F.round(S.fisher_two_sided("n11", "n10", "n01", "n00"), 6).alias("p"))


@query(f"WITH {SESSIONS} SELECT axis, CAST(count(*) FILTER (WHERE recent <> 0 AND majority <> 0) AS BIGINT) AS both_fired, round(count(*) FILTER (WHERE recent * majority > 0) / nullif(count(*) FILTER (WHERE recent <> 0 AND majority <> 0), 0), 6) AS agree FROM v GROUP BY 1")
def t10_direction_agreement(t):
    v = P.vectors(P.turn_scores(t.events), ["user_id", "session"])
    both = (F.col("recent") != 0) & (F.col("majority") != 0)
    return v.groupBy("axis").agg(F.count_if(both).alias("both_fired"), F.round(ST.ratio(F.count_if(F.col("recent") * F.col("majority") > 0), F.count_if(both)), 6).alias("agree"))


#: Tails of the chi-square and the F distribution as power series, of columns (chi2, df) and (f, d1, d2).
_CHI_TAIL = "(SELECT 1 - sum(exp(df / 2.0 * ln(chi2 / 2) - chi2 / 2 + n * ln(chi2 / 2) - lgamma(df / 2.0 + n + 1))) FROM range(0, 2000) r(n))"
_F_TAIL = "(SELECT exp(d2 / 2.0 * ln(d2 / (d2 + d1 * f)) + d1 / 2.0 * ln(d1 * f / (d2 + d1 * f)) - ln(d2 / 2.0) - lgamma(d1 / 2.0) - lgamma(d2 / 2.0) + lgamma((d1 + d2) / 2.0)) * sum(exp(lgamma((d1 + d2) / 2.0 + n) - lgamma((d1 + d2) / 2.0) - lgamma(d2 / 2.0 + 1 + n) + lgamma(d2 / 2.0 + 1) + n * ln(d2 / (d2 + d1 * f)))) FROM range(0, 400000) r(n))"


def _chi_sql(rows: str, a: str, b: str) -> str:
    return f"(WITH c AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS o FROM {rows} GROUP BY 1, 2), g AS (SELECT x.a, y.b, r * q / n AS e FROM (SELECT a, sum(o) AS r FROM c GROUP BY 1) x, (SELECT b, sum(o) AS q FROM c GROUP BY 1) y, (SELECT sum(o) AS n FROM c)) SELECT sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e) AS chi2, CAST((count(DISTINCT g.a) - 1) * (count(DISTINCT g.b) - 1) AS BIGINT) AS df FROM g LEFT JOIN c ON g.a = c.a AND g.b = c.b)"


def _anova_sql(rows: str, a: str, v: str) -> str:
    return f"(WITH m AS (SELECT {a} AS a, count(*)::DOUBLE AS n, avg({v}) AS mean, var_pop({v}) * count(*) AS m2 FROM {rows} GROUP BY 1) SELECT (sum(n * mean * mean) - sum(n * mean) * sum(n * mean) / sum(n)) / (count(*) - 1) / (sum(m2) / (sum(n) - count(*))) AS f, CAST(count(*) - 1 AS BIGINT) AS d1, CAST(sum(n) - count(*) AS BIGINT) AS d2 FROM m)"


@query(f"SELECT round(chi2, 6) AS chi2, df, round({_CHI_TAIL}, 6) AS p FROM {_chi_sql('documents JOIN labels USING (doc_id)', 'lang', 'quality')}")
def t12_chi_square(t):
    df = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    return S.chi_square(df, "lang", "quality").select(F.round("chi2", 6).alias("chi2"), "df", F.round("p", 6).alias("p"))


@query(f"SELECT round(f, 5) AS f, d1 AS df_between, d2 AS df_within, round({_F_TAIL}, 5) AS p FROM {_anova_sql('events', 'event_type', 'value')}")
def t12_anova(t):
    return S.anova_f(S.group_moments(t.events, [], "event_type", "value")).withColumns({"f": F.round("f", 5), "p": F.round("p", 5)})


_C = "(SELECT c_custkey % 4 AS g, c_mktsegment, c_nationkey % 3 AS third, c_acctbal FROM customer)"


@query(f"""SELECT 'c_mktsegment' AS feature, 'categorical' AS kind, round(chi2, 5) AS statistic, df, CAST(NULL AS BIGINT) AS df_within, round({_CHI_TAIL}, 5) AS p FROM {_chi_sql(_C, 'g', 'c_mktsegment')}
UNION ALL SELECT 'third', 'categorical', round(chi2, 5), df, NULL, round({_CHI_TAIL}, 5) FROM {_chi_sql(_C, 'g', 'third')}
UNION ALL SELECT 'c_acctbal', 'numeric', round(f, 5), d1, d2, round({_F_TAIL}, 5) FROM {_anova_sql(_C, 'g', 'c_acctbal')}""")
def c16_associations(t):
    """What outside features have to do with a grouping."""
    rows = t.customer.select((F.col("c_custkey") % 4).alias("g"), "c_mktsegment", (F.col("c_nationkey") % 3).alias("third"), "c_acctbal")
    return S.associations(rows, "g", ["c_mktsegment", "third"], ["c_acctbal"]).withColumns({"statistic": F.round("statistic", 5), "p": F.round("p", 5)})


@query(f"SELECT g, value, round(n / sum(n) OVER (PARTITION BY g), 6) AS share FROM (SELECT g, c_mktsegment AS value, count(*) AS n FROM {_C} GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, value) <= 2")
def c16_top_values(t):
    rows = t.customer.select((F.col("c_custkey") % 4).alias("g"), "c_mktsegment")
    return S.association_shares(rows, "g", "c_mktsegment").withColumn("share", F.round("share", 6))


@query("SELECT user_id % 3 AS g, round((avg(value * k) - avg(value) * avg(k)) / (stddev_pop(value) * stddev_pop(k)), 6) AS r FROM (SELECT user_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY 1")
def t13_pearson(t):
    k = F.from_json("props", "k double")["k"]
    return t.events.withColumn("k", k).groupBy((F.col("user_id") % 3).alias("g")).agg(F.round(ST.pearson(F.col("value"), F.col("k")), 6).alias("r"))


_U = f"WITH {SESSIONS}, u AS (SELECT user_id, axis, CAST(sum(high) AS BIGINT) AS pos, CAST(sum(low) AS BIGINT) AS neg FROM v GROUP BY 1, 2), p AS (SELECT *, (sum(pos) OVER w - pos + 0.5) / (sum(pos) OVER w - pos + sum(neg) OVER w - neg + 1) AS prior FROM u WINDOW w AS (PARTITION BY axis))"


def _shrunk(t):
    per = P.vectors(P.turn_scores(t.events), ["user_id", "session"]).groupBy("user_id", "axis").agg(F.sum("high").alias("pos"), F.sum("low").alias("neg"))
    return S.leave_one_out_prior(per, "axis", "pos", "neg")


@query(f"{_U} SELECT user_id, axis, round(prior, 6) AS prior, round((pos + 10 * prior) / (pos + neg + 10), 6) AS posterior FROM p")
def t14_shrunk_posterior(t):
    return _shrunk(t).select("user_id", "axis", F.round("prior", 6).alias("prior"), F.round("posterior", 6).alias("posterior"))


@query(f"{_U}, q AS (SELECT *, (pos + 10 * prior) / (pos + neg + 10) AS post FROM p) SELECT user_id, round(sum(-(pos * ln(prior) + neg * ln(1 - prior)) + pos * ln(post) + neg * ln(1 - post)) / nullif(sum(pos + neg), 0), 6) AS gain FROM q GROUP BY 1")
def t15_log_loss_gain(t):
    one, zero = F.lit(1.0), F.lit(0.0)
    loss = lambda p: F.col("pos") * ST.log_loss(one, F.col(p)) + F.col("neg") * ST.log_loss(zero, F.col(p))
    return _shrunk(t).groupBy("user_id").agg(F.round(F.try_divide(F.sum(loss("prior") - loss("posterior")), F.sum(F.col("pos") + F.col("neg"))), 6).alias("gain"))


@query(f"{_U}, q AS (SELECT *, (greatest(pos, neg) + 1.0) / (pos + neg + 2.0) AS c FROM u) SELECT confidence, support, CAST(count(*) FILTER (WHERE c >= confidence AND pos + neg >= support) AS BIGINT) AS kept, round(count(*) FILTER (WHERE c >= confidence AND pos + neg >= support AND pos > neg) / nullif(count(*) FILTER (WHERE c >= confidence AND pos + neg >= support), 0), 6) AS accuracy FROM q, (SELECT unnest([0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS confidence), (SELECT unnest([1, 2, 4]) AS support) GROUP BY 1, 2")
def t18_threshold_grid(t):
    per = _shrunk(t).withColumns({"c": ST.laplace_confidence(F.col("pos"), F.col("neg")), "s": F.col("pos") + F.col("neg")})
    return S.trust_grid(per, "c", "s", F.col("pos") > F.col("neg"), [0.5, 0.6, 0.7, 0.8], [1, 2, 4]).withColumn("accuracy", F.round("accuracy", 6))


_H = "WITH h AS (SELECT user_id, event_type AS axis, avg(value) FILTER (WHERE i <= n / 2) AS e, avg(value) FILTER (WHERE i > n / 2) AS l FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) GROUP BY 1, 2)"


@query(f"{_H}, s AS (SELECT axis, CASE WHEN coalesce(stddev_samp(e), 0) = 0 THEN 1 ELSE stddev_samp(e) END AS sd FROM h GROUP BY 1), d AS (SELECT a.user_id AS a, b.user_id AS b, round(sqrt(avg((a.e / sd - b.l / sd) * (a.e / sd - b.l / sd))), 9) AS d FROM h a JOIN h b ON a.axis = b.axis JOIN s ON a.axis = s.axis WHERE a.e IS NOT NULL AND b.l IS NOT NULL AND a.user_id % 100 = 0 GROUP BY 1, 2) SELECT d.a AS user_id, CAST(count(*) FILTER (WHERE d.d < o.d OR (d.d = o.d AND d.b < d.a)) + 1 AS BIGINT) AS rank, round(min(d.d) FILTER (WHERE d.a <> d.b), 6) AS nearest FROM d JOIN d o ON d.a = o.a AND o.a = o.b GROUP BY 1")
def t20_retrieval(t):
    """Users whose id is divisible by 100 against all."""
    w = W.partitionBy("user_id", "event_type")
    rows = t.events.select("user_id", F.col("event_type").alias("axis"), "value", F.row_number().over(w.orderBy("event_id")).alias("i"), F.count("*").over(w).alias("n"))
    half = lambda past: rows.where(F.expr("i <= n / 2") if past else F.expr("i > n / 2")).groupBy("user_id", "axis").agg(F.avg("value").alias("value"))
    return S.retrieval(half(True), half(False), "user_id", "axis", "value", F.col("user_id") % 100 == 0).select("user_id", "rank", F.round("nearest", 6).alias("nearest"))


_FUTURE = f"""WITH {TURNS}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY turn_number) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM t WHERE score <> 0),
both_ AS (SELECT user_id FROM a GROUP BY 1 HAVING count(*) FILTER (WHERE i <= 0.7 * n) > 0 AND count(*) FILTER (WHERE i > 0.7 * n) > 0),
own AS (SELECT user_id, axis, count(*) FILTER (WHERE score > 0) AS pos, count(*) AS m FROM a SEMI JOIN both_ USING (user_id) WHERE i <= 0.7 * n GROUP BY 1, 2),
tot AS (SELECT axis, sum(pos) AS p, sum(m) AS m FROM own GROUP BY 1),
prof AS (SELECT user_id, axis, coalesce(pos, 0) AS pos, coalesce(own.m, 0) AS m, (coalesce(p, 0) - coalesce(pos, 0) + 0.5::DOUBLE) / (coalesce(tot.m, 0) - coalesce(own.m, 0) + 1) AS pp FROM both_ CROSS JOIN (SELECT DISTINCT axis FROM a) LEFT JOIN own USING (user_id, axis) LEFT JOIN tot USING (axis)),
full_ AS (SELECT *, (10 * pp + pos) / (10 + m) AS up FROM prof),
obs AS (SELECT user_id, axis, CAST(score > 0 AS INTEGER) AS y, pos, f.m, pp, up, CASE WHEN score > 0 THEN pp < 0.5 ELSE pp >= 0.5 END AS minority, -ln(CASE WHEN score > 0 THEN pp ELSE 1 - pp END) AS surprisal FROM a JOIN full_ f USING (user_id, axis) WHERE i > 0.7 * n)"""


def _future(t):
    rows = P.turn_scores(t.events).where("score <> 0")
    w = W.partitionBy("user_id")
    rows = rows.withColumns({"i": F.row_number().over(w.orderBy("turn_number")), "n": F.count("*").over(w)})
    early = F.expr("i <= 0.7 * n")  # a decimal, exact for any n
    return S.future_observations(rows.where(early), rows.where(~early), "user_id", "axis", "score")


@query(f"""{_FUTURE}, g AS (SELECT *, CASE WHEN m > 0 THEN greatest(pos, m - pos) / m ELSE 0 END AS cons, CASE WHEN m > 0 THEN abs(2 * pos - m) / m ELSE 0 END AS margin FROM obs),
e AS (SELECT user_id, y, pp, 'always' AS method, true AS ok, up AS q FROM g UNION ALL SELECT user_id, y, pp, 'support>=' || s, m >= s, CASE WHEN m >= s THEN up ELSE pp END FROM g, (SELECT unnest([1, 2, 3, 5, 10, 20]) AS s)
UNION ALL SELECT user_id, y, pp, 'support>=' || s || ',consistency>=' || c, m >= s AND cons >= c, CASE WHEN m >= s AND cons >= c THEN up ELSE pp END FROM g, (SELECT unnest([2, 3, 5, 10]) AS s), (SELECT unnest([0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS c)
UNION ALL SELECT user_id, y, pp, 'continuous ' || k, m / (m + k) * margin > 0, (1 - m / (m + k) * margin) * pp + m / (m + k) * margin * up FROM g, (SELECT unnest([1, 2, 3, 5, 10, 20]::DOUBLE[]) AS kk, CAST(kk AS INTEGER) AS k)),
l AS (SELECT user_id, method, ok, -(y * ln(pp) + (1 - y) * ln(1 - pp)) AS base, -(y * ln(q) + (1 - y) * ln(1 - q)) AS loss FROM e),
u AS (SELECT method, user_id, count(*) AS n, count(*) FILTER (WHERE ok) AS k, sum(loss) AS loss, sum(base - loss) AS gain FROM l GROUP BY 1, 2)
SELECT method, CAST(sum(n) AS BIGINT) AS n_observations, CAST(sum(k) AS BIGINT) AS personalized, round(sum(k) / sum(n), 6) AS coverage, round(sum(loss) / sum(n), 6) AS log_loss, round(sum(gain) / sum(n), 6) AS improvement, round(avg(gain / n), 6) AS mean_user_gain, CAST(count(*) FILTER (WHERE k > 0) AS BIGINT) AS users_personalized, CAST(count(*) FILTER (WHERE gain / n > 0) AS BIGINT) AS users_improved FROM u GROUP BY 1""")
def t17_trust_gates(t):
    seen, _ = _future(t)
    got = S.trust_gates(seen, "user_id", [1, 2, 3, 5, 10, 20], [(s, c) for s in (2, 3, 5, 10) for c in (0.6, 0.7, 0.8, 0.9)], [1, 2, 3, 5, 10, 20])
    return got.withColumns({c: F.round(c, 6) for c in ("coverage", "log_loss", "improvement", "mean_user_gain")})


@query()
def t17_trust_intervals(t):
    """The gain of trusting profiles always, with an interval over users drawn anew."""
    seen, _ = _future(t)
    return S.trust_gates(seen, "user_id", [5], [], [], replicates=50, seed=17).select("method", "mean_user_gain", "ci_low", "ci_high")


@query(f"""{_FUTURE}, w AS (SELECT user_id, axis, y, mode, CASE mode WHEN 'all' THEN 1.0 WHEN 'majority' THEN CASE WHEN NOT minority THEN 1.0 END WHEN 'minority' THEN CASE WHEN minority THEN 1.0 END ELSE surprisal END AS w FROM obs, (SELECT unnest(['all', 'majority', 'minority', 'surprisal']) AS mode) WHERE user_id % 100 = 0),
sc AS (SELECT w.user_id AS a, mode, f.user_id AS b, round(sum(w * ln(CASE WHEN y = 1 THEN up ELSE 1 - up END)) / sum(w), 9) AS s, count(*) AS n FROM w JOIN full_ f USING (axis) WHERE w IS NOT NULL GROUP BY 1, 2, 3)
SELECT o.a AS user_id, o.mode, CAST(any_value(o.n) AS BIGINT) AS n_observations, CAST(count(*) FILTER (WHERE s.s > o.s OR (s.s = o.s AND s.b < o.a)) + 1 AS BIGINT) AS rank FROM sc s JOIN sc o ON s.a = o.a AND s.mode = o.mode AND o.a = o.b GROUP BY 1, 2""")
def t16_likelihood_retrieval(t):
    """Users whose id is divisible by 100 against all profiles, in four weightings."""
    seen, profiles = _future(t)
    return S.likelihood_retrieval(seen, profiles, "user_id", "axis", F.col("user_id") % 100 == 0)


@query()
def b1_bootstrap_icc(t):
    """Percentiles over 50 replicates; our own stream of draws, so no SQL twin."""
    m = _moments(t)
    weights = R.bootstrap_weights(m, "user_id", 50, 11)
    reps = S.icc(m.join(weights, "user_id"), ["replicate", "axis"], F.col("weight"))
    q = F.percentile("icc", F.array(*map(F.lit, (0.05, 0.5, 0.95))))
    return reps.groupBy("axis").agg(q.alias("q")).select("axis", *[F.col("q")[k].alias(n) for k, n in enumerate(("p05", "p50", "p95"))])


@query()
def b2_bootstrap_phi(t):
    rows = t.labels.withColumn("g", F.col("doc_id") % 40)
    n = S.cell_counts(rows, ["g"], F.col("quality") == 1, F.col("toxic") == 1)
    reps = n.join(R.bootstrap_weights(n, "g", 50, 12), "g").groupBy("replicate").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("n11", "n10", "n01", "n00")])
    phi = ST.phi(*[F.col(c) for c in ("n11", "n10", "n01", "n00")])
    return reps.select("replicate", phi.alias("phi")).agg(F.percentile("phi", 0.025).alias("low"), F.percentile("phi", 0.975).alias("high"))


@query()
def b3_bootstrap_mean(t):
    per = t.events.groupBy("user_id").agg(F.avg("value").alias("v"))
    reps = per.join(R.bootstrap_weights(per, "user_id", 50, 13), "user_id").groupBy("replicate").agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("m"))
    return reps.agg(F.percentile("m", 0.05).alias("low"), F.percentile("m", 0.95).alias("high"))


@query()
def b4_permutation_p(t):
    """p of the difference in mean value between two groups of users, labels dealt anew 99 times."""
    per = t.events.groupBy("user_id").agg(F.avg("value").alias("v")).withColumn("label", F.col("user_id") % 2)
    gap = F.abs(F.avg(F.when(F.col("label") == 1, F.col("v"))) - F.avg(F.when(F.col("label") == 0, F.col("v"))))
    real = per.agg(gap.alias("real"))
    null = R.permuted(per, "user_id", "label", 99, 14).join(per.select("user_id", "v"), "user_id").groupBy("replicate").agg(gap.alias("gap"))
    return null.crossJoin(F.broadcast(real)).agg(((F.count_if(F.col("gap") >= F.col("real")) + 1) / (F.count("*") + 1)).alias("p"))  # one row


@query("SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY sha256('15:' || CAST(user_id AS VARCHAR)), user_id LIMIT 20")
def b56_hashed_sample(t):
    return R.sample_rows(t.events.select("user_id").distinct(), ["user_id"], 15, 20)


@query("SELECT replicate, c_custkey, CASE WHEN row_number() OVER (PARTITION BY replicate ORDER BY sha256('6:' || CAST(replicate AS VARCHAR) || ':' || CAST(c_custkey AS VARCHAR)), c_custkey) <= floor(n * 0.7) THEN 'first' ELSE 'rest' END AS part FROM (SELECT c_custkey, count(*) OVER () AS n FROM customer), (SELECT unnest([0, 1, 2]) AS replicate)")
def b6_random_splits(t):
    return R.random_parts(t.customer.select("c_custkey"), ["c_custkey"], 6, 3, 0.7).select("replicate", "c_custkey", "part")


@query("SELECT t.task, c.condition, r.rep FROM (SELECT c_custkey AS task FROM customer) t, (SELECT unnest(['baseline', 'profile', 'skill']) AS condition) c, (SELECT unnest([1, 2]) AS rep) r WHERE NOT (task % 5 = 0 AND condition = 'skill')")
def l7_experiment_plan(t):
    grid = t.customer.select(F.col("c_custkey").alias("task"), F.explode(F.array(*map(F.lit, ("baseline", "profile", "skill")))).alias("condition")).withColumn("rep", F.explode(F.array(F.lit(1), F.lit(2))))
    left_out = t.customer.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("task"), F.lit("skill").alias("condition"))
    return grid.join(left_out, ["task", "condition"], "left_anti").select("task", "condition", "rep")


@query("SELECT o_orderkey, CASE WHEN prior >= 5 THEN 'kept' WHEN prior = 0 THEN 'no prior' ELSE 'few prior' END AS reason FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS prior FROM orders)")
def l11_manifest(t):
    """Strictly earlier rows of the same key: those up to and with this time, less those at this time."""
    upto = F.count("*").over(W.partitionBy("o_custkey").orderBy("o_orderdate").rangeBetween(W.unboundedPreceding, 0))
    prior = upto - F.count("*").over(W.partitionBy("o_custkey", "o_orderdate"))
    return t.orders.withColumn("prior", prior).select("o_orderkey", F.when(F.col("prior") >= 5, "kept").when(F.col("prior") == 0, "no prior").otherwise("few prior").alias("reason"))
