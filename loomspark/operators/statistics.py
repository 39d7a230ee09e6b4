"""Agreement, discriminability and prediction measures from sufficient statistics: no raw row is visited twice."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import stats as ST
from ..functions import vectors as V
from ..sources.tables import stored
from . import tiles
from .resampling import bootstrap_weights


def group_moments(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """by, group, n, mean, m2: what all measures of spread between and within groups need."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, group).agg(F.count("*").cast("double").alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count("*")).alias("m2"))


def icc(moments: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """by, n_groups, n_rows, icc, reason: one-way random effects for groups of unequal size. weight repeats groups."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    n = F.col("n")
    per = moments.groupBy(*by).agg(
        F.sum(w).alias("k"), F.sum(w * n).alias("rows"), F.sum(w * n * n).alias("nn"), F.sum(w * n * F.col("mean")).alias("s"), F.sum(w * n * F.col("mean") * F.col("mean")).alias("ss"), F.sum(w * F.col("m2")).alias("ssw"),
    )
    k, rows = F.col("k"), F.col("rows")
    ssb = F.greatest(F.col("ss") - F.try_divide(F.col("s") * F.col("s"), rows), F.lit(0.0))
    msb, msw = F.try_divide(ssb, k - 1), F.try_divide(F.col("ssw"), rows - k)
    n0 = F.try_divide(rows - F.try_divide(F.col("nn"), rows), k - 1)
    below = msb + (n0 - 1) * msw
    reason = F.when(k < 2, "few groups").when(rows <= k, "no repeats").when(F.abs(below) < 1e-12, "no variance").otherwise("ok")
    return per.select(*by, k.cast("long").alias("n_groups"), rows.cast("long").alias("n_rows"), F.when(reason == "ok", F.try_divide(msb - msw, below)).alias("icc"), reason.alias("reason"))


def variance_ratio(moments: DataFrame, by: list[str]) -> DataFrame:
    """by, between, within, ratio: the sample variance of group means over the mean sample variance of groups of two or more."""
    inner = F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1))
    per = moments.groupBy(*by).agg(F.var_samp("mean").alias("between"), F.avg(inner).alias("within"))
    return per.select(*by, "between", "within", F.try_divide("between", "within").alias("ratio"))


def cell_counts(df: DataFrame, by: list[str], a: Column, b: Column) -> DataFrame:
    """by, n11, n10, n01, n00 of two conditions."""
    return df.groupBy(*by).agg(F.count_if(a & b).alias("n11"), F.count_if(a & ~b).alias("n10"), F.count_if(~a & b).alias("n01"), F.count_if(~a & ~b).alias("n00"))


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """chi2, df, p of independence, and Cramer's v. Nulls are left out."""
    df = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    cells = df.groupBy(row, column).agg(F.count("*").alias("o"))
    rows, cols = cells.groupBy(row).agg(F.sum("o").alias("r")), cells.groupBy(column).agg(F.sum("o").alias("c"))
    met = cells.join(rows, row).join(cols, column)  # cells that nobody is in add nothing to the sum of squares
    share = F.sum(F.col("o").cast("double") * F.col("o") / (F.col("r").cast("double") * F.col("c")))
    per = met.agg(share.alias("s"), F.countDistinct(row).alias("rows"), F.countDistinct(column).alias("cols"), F.sum("o").alias("n"))
    per = per.withColumn("chi2", F.greatest(F.col("n") * (F.col("s") - 1), F.lit(0.0)))
    free = (F.col("rows") - 1) * (F.col("cols") - 1)
    return per.select("chi2", free.alias("df"), ST.chi_square_tail("chi2", free).alias("p"), F.sqrt(F.try_divide("chi2", F.col("n") * (F.least("rows", "cols") - 1))).alias("v"))


def anova_f(moments: DataFrame) -> DataFrame:
    """f, df_between, df_within, p of one-way analysis."""
    n, k = F.sum("n"), F.count("*")
    per = moments.agg(n.alias("n"), k.cast("double").alias("k"), (F.sum(F.col("n") * F.col("mean") * F.col("mean")) - F.try_divide(F.sum(F.col("n") * F.col("mean")) * F.sum(F.col("n") * F.col("mean")), n)).alias("ssb"), F.sum("m2").alias("ssw"))
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    got = per.select(F.try_divide(F.try_divide(F.col("ssb"), d1), F.try_divide(F.col("ssw"), d2)).alias("f"), d1.cast("long").alias("df_between"), d2.cast("long").alias("df_within"))
    return got.withColumn("p", ST.f_tail("f", F.col("df_between").cast("double"), F.col("df_within").cast("double")))


def associations(df: DataFrame, label: str, categorical: list[str], numeric: list[str]) -> DataFrame:
    """feature, kind, statistic, df, df_within, p: how a label goes with each feature, by contingency or by variance.

    Nulls are left out; groups of one row do not enter the variances; a feature with fewer than two values or groups has
    no statistic.
    """
    out = []
    for c in categorical:
        got = chi_square(df, label, c)
        out.append(got.select(F.lit(c).alias("feature"), F.lit("categorical").alias("kind"), F.when(F.col("df") > 0, F.col("chi2")).alias("statistic"), "df", F.lit(None).cast("long").alias("df_within"), "p"))
    for c in numeric:
        got = anova_f(group_moments(df.where(F.col(label).isNotNull()), [], label, c).where("n >= 2"))
        out.append(got.select(F.lit(c).alias("feature"), F.lit("numeric").alias("kind"), F.when(F.col("df_between") > 0, F.col("f")).alias("statistic"), F.col("df_between").alias("df"), "df_within", "p"))
    return functools.reduce(DataFrame.unionByName, out)


def association_shares(df: DataFrame, label: str, feature: str, top: int = 2) -> DataFrame:
    """label, feature value, share: the most frequent values of each group."""
    n = df.where(F.col(feature).isNotNull()).groupBy(label, feature).agg(F.count("*").alias("n"))
    ranked = n.withColumns({"share": F.col("n") / F.sum("n").over(W.partitionBy(label)), "__r": F.row_number().over(W.partitionBy(label).orderBy(F.desc("n"), feature))})
    return ranked.where(F.col("__r") <= top).select(label, F.col(feature).alias("value"), "share")


@F.pandas_udf(T.DoubleType())
def fisher_two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided exact p of a 2 x 2 table: all tables with the same margins that are no likelier."""
    lg, out = math.lgamma, []
    for w, x, y, z in zip(a, b, c, d, strict=True):
        r, s, n = w + x, w + y, w + x + y + z
        base = lg(r + 1) + lg(n - r + 1) + lg(s + 1) + lg(n - s + 1) - lg(n + 1)
        p = lambda k: math.exp(base - lg(k + 1) - lg(r - k + 1) - lg(s - k + 1) - lg(n - r - s + k + 1))  # noqa: B023, E731
        own = p(w)
        out.append(min(1.0, sum(q for k in range(max(0, r + s - n), min(r, s) + 1) if (q := p(k)) <= own * (1 + 1e-7))))
    return pd.Series(out, dtype="float64")


def leave_one_out_prior(per_user: DataFrame, axis: str, pos: str, neg: str, strength: float = 10.0) -> DataFrame:
    """Adds prior and posterior: the others' smoothed share, and the own counts shrunk to it."""
    total = per_user.groupBy(axis).agg(F.sum(pos).alias("__p"), F.sum(neg).alias("__n"))
    joined = per_user.join(F.broadcast(total), axis)  # a row for each axis
    p, n = F.col("__p") - F.col(pos), F.col("__n") - F.col(neg)
    out = joined.withColumn("prior", (p + 0.5) / (p + n + 1))
    return out.withColumn("posterior", (F.col(pos) + strength * F.col("prior")) / (F.col(pos) + F.col(neg) + strength)).drop("__p", "__n")


def future_observations(train: DataFrame, test: DataFrame, entity: str, axis: str, score: str, strength: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Held-out observations with what earlier ones foretell, and the profiles behind it.

    train, test: entity, axis, score (not zero; its sign counts). Only entities with both count, in the population too.
    First result, a row for each test row: entity, axis, y, pos, n, population_p (the others' smoothed share), user_p (the
    own counts shrunk to it), minority, surprisal. Second: entity, axis, p of every profile and axis.
    """
    both = train.select(entity).distinct().join(test.select(entity).distinct(), entity, "left_semi")
    own = train.join(both, entity, "left_semi").groupBy(entity, axis).agg(F.count_if(F.col(score) > 0).alias("pos"), F.count("*").alias("n"))
    total = F.broadcast(own.groupBy(axis).agg(F.sum("pos").alias("__p"), F.sum("n").alias("__n")))  # a row for each axis
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    prior = (zero("__p") - zero("pos") + 0.5) / (zero("__n") - zero("n") + 1.0)

    def judged(rows):
        out = rows.join(own, [entity, axis], "left").join(total, axis, "left").withColumns({"pos": zero("pos"), "n": zero("n"), "population_p": prior}).drop("__p", "__n")
        return out.withColumn("user_p", (strength * F.col("population_p") + F.col("pos")) / (strength + F.col("n")))

    y = (F.col(score) > 0).cast("int")
    seen = judged(test.join(both, entity, "left_semi").select(entity, axis, y.alias("y")))
    minority = F.when(F.col("y") == 1, F.col("population_p") < 0.5).otherwise(F.col("population_p") >= 0.5)
    seen = seen.withColumns({"minority": minority, "surprisal": -F.ln(F.when(F.col("y") == 1, F.col("population_p")).otherwise(1 - F.col("population_p")))})
    axes = own.select(axis).union(test.select(axis)).distinct()  # few
    return seen, judged(both.crossJoin(F.broadcast(axes))).select(entity, axis, F.col("user_p").alias("p"))


def trust_gates(observations: DataFrame, entity: str, supports: list[int], pairs: list[tuple[int, float]], softness: list[int], replicates: int = 0, seed: int = 0) -> DataFrame:
    """method, n_observations, personalized, coverage, log_loss, improvement, mean_user_gain, users_personalized,
    users_improved: what is lost when own profiles are trusted always, from a support on, from a support and a consistency
    on, or the more the larger and clearer the support. With replicates also ci_low and ci_high of the mean gain, by
    drawing entities anew."""
    n, pos = F.col("n"), F.col("pos")
    consistency = F.coalesce(F.try_divide(F.greatest(pos, n - pos), n), F.lit(0.0))
    margin = F.coalesce(F.try_divide(F.abs(2 * pos - n), n), F.lit(0.0))
    pop, own = F.col("population_p"), F.col("user_p")
    gate = lambda name, ok: (name, ok, F.when(ok, own).otherwise(pop))
    methods = [("always", F.lit(True), own)]
    methods += [gate(f"support>={s}", n >= s) for s in supports]
    methods += [gate(f"support>={s},consistency>={c}", (n >= s) & (consistency >= c)) for s, c in pairs]
    for k in softness:
        trust = n / (n + F.lit(float(k))) * margin
        methods.append((f"continuous {k}", trust > 0, (1 - trust) * pop + trust * own))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), ok.alias("personal"), p.alias("p")) for m, ok, p in methods]))
    rows = observations.select(entity, "y", "population_p", each.alias("m")).select(entity, "m.method", "m.personal", ST.log_loss(F.col("y"), F.col("population_p")).alias("base"), ST.log_loss(F.col("y"), F.col("m.p")).alias("loss"))
    per = rows.groupBy("method", entity).agg(F.count("*").alias("rows"), F.count_if("personal").alias("personal"), F.sum("loss").alias("loss"), F.sum(F.col("base") - F.col("loss")).alias("gain")).withColumn("mean_gain", F.col("gain") / F.col("rows"))
    out = per.groupBy("method").agg(
        F.sum("rows").alias("n_observations"), F.sum("personal").alias("personalized"), (F.sum("personal") / F.sum("rows")).alias("coverage"), (F.sum("loss") / F.sum("rows")).alias("log_loss"), (F.sum("gain") / F.sum("rows")).alias("improvement"),
        F.avg("mean_gain").alias("mean_user_gain"), F.count_if(F.col("personal") > 0).alias("users_personalized"), F.count_if(F.col("mean_gain") > 0).alias("users_improved"),
    )
    if not replicates:
        return out
    drawn = per.join(bootstrap_weights(observations.select(entity).distinct(), entity, replicates, seed), entity)
    means = drawn.groupBy("method", "replicate").agg((F.sum(F.col("mean_gain") * F.col("weight")) / F.sum("weight")).alias("m"))
    ci = means.groupBy("method").agg(F.percentile("m", 0.025).alias("ci_low"), F.percentile("m", 0.975).alias("ci_high"))
    return out.join(ci, "method")


def packed(df: DataFrame, entity: str, axis: str, value: Column, axes: list) -> DataFrame:
    """entity, v: the values in the order of the axes, null where there is none."""
    m = F.map_from_entries(F.collect_list(F.struct(axis, value.alias("__v"))))  # a value for each axis
    return df.groupBy(entity).agg(m.alias("__m")).select(entity, F.array(*[F.col("__m")[a] for a in axes]).alias("v"))


def likelihood_retrieval(observations: DataFrame, profiles: DataFrame, entity: str, axis: str, queries: Column) -> DataFrame:
    """entity, mode, n_observations, rank: where the own profile ranks among all by the mean log likelihood of the held-out
    observations: of all, of those that go with the others' majority, of those against it, and weighted by surprisal."""
    axes = sorted(r[0] for r in profiles.select(axis).distinct().collect())  # few
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), w.alias("w")) for m, w in (("all", F.lit(1.0)), ("majority", F.when(~F.col("minority"), 1.0)), ("minority", F.when(F.col("minority"), 1.0)), ("surprisal", F.col("surprisal")))])
    rows = observations.where(queries).select(F.col(entity).alias("a"), axis, "y", F.explode(modes).alias("m")).select("a", "m.mode", axis, "y", "m.w").where("w is not null")
    cell = lambda a, y: F.coalesce(F.sum(F.when((F.col(axis) == a) & (F.col("y") == y), F.col("w"))), F.lit(0.0))
    asked = rows.groupBy("a", "mode").agg(F.count("*").alias("n_observations"), F.sum("w").alias("all"), F.array(*[cell(a, y) for a in axes for y in (1, 0)]).alias("w"))
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("p")))
    logs = profiles.withColumn("__l", F.array(F.ln(p), F.ln(1 - p)))
    known = packed(logs, entity, axis, F.col("__l"), axes).select(F.col(entity).alias("b"), F.flatten("v").alias("l"))
    known, asked = stored(known.withColumnRenamed("l", "v")), stored(asked)
    mean = F.transform("w", lambda x: F.try_divide(x, F.col("all")))
    asked = asked.select("a", "mode", "n_observations", mean.alias("w"))
    own = asked.join(known, F.col("a") == F.col("b")).select("a", "mode", "n_observations", F.round(-V.dot(F.col("w"), F.col("v")), 9).alias("own"), F.col("w").alias("v")).where("own is not null")
    got = tiles.ranked(own, known, ["a", "mode", "n_observations"], "own", tiles.minus_dot)
    return got.select(F.col("a").alias(entity), "mode", "n_observations", "rank")


def retrieval(early: DataFrame, late: DataFrame, entity: str, axis: str, value: str, queries: Column) -> DataFrame:
    """entity, rank, nearest: where the entity's own later profile ranks among all, by root mean square distance over the
    axes that both have, each scaled by its deviation over early profiles. queries: the entities that are asked for."""
    sd = {r[0]: r[1] or 1.0 for r in early.groupBy(axis).agg(F.stddev_samp(value)).collect()}  # a row for each axis
    axes = sorted(sd)
    scale = F.create_map(*[x for a in axes for x in (F.lit(a), F.lit(float(sd[a])))])
    side = lambda df, n, v: packed(df.where(F.col(value).isNotNull() & F.col(axis).isin(axes)), entity, axis, F.col(value) / scale[F.col(axis)], axes).select(F.col(entity).alias(n), F.col("v").alias(v))
    asked, known = side(early.where(queries), "a", "v"), side(late, "b", "v")
    asked, known = stored(asked), stored(known)
    own = asked.join(known.withColumnRenamed("v", "w"), F.col("a") == F.col("b")).select("a", F.round(V.masked_rms(F.col("v"), F.col("w")), 9).alias("own"), "v").where("own is not null")
    got = tiles.ranked(own, known, ["a"], "own", tiles.masked_rms)
    return got.select(F.col("a").alias(entity), "rank", F.col("best_other").alias("nearest"))


def trust_grid(df: DataFrame, confidence: str, support: str, hit: Column, levels: list[float], supports: list[int]) -> DataFrame:
    """confidence, support, kept, accuracy of each pair of thresholds, in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("confidence"), F.lit(s).alias("support"), F.count_if((F.col(confidence) >= c) & (F.col(support) >= s)).alias("kept"), ST.ratio(F.count_if((F.col(confidence) >= c) & (F.col(support) >= s) & hit), F.count_if((F.col(confidence) >= c) & (F.col(support) >= s))).alias("accuracy")) for c in levels for s in supports])
    return df.agg(cells.alias("s")).select(F.inline("s"))
