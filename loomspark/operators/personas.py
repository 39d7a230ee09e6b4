"""Do later sessions return to an entity's own earlier profile, and to its earlier cluster?"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as ST
from ..functions import vectors as V
from ..sources.tables import stored
from . import tiles
from .sequences import exact_percentile, running_sums

#: The normal quantile that these tables have always used; a fixed value.
Z = 1.96


def split_profiles(sessions: DataFrame, entity: str, order: list[str], vector: str, width: int, fraction: float = 0.7) -> DataFrame:
    """entity, n_reference, n_query, reference, query: means of the first floor(n * fraction) sessions, at least one, and of the
    rest, at least one, with nulls as zero. Entities with one session, and sessions with a null order, are left out.

    order: columns that tell an entity's sessions apart. One entity may have most of the rows: sessions are numbered by
    running sums over ranges.
    """
    known = sessions.where(" and ".join(f"`{c}` is not null" for c in order)).select(F.col(entity).alias("e"), F.struct(*order).alias("o"), V.doubles(F.col(vector)).alias("v"))
    numbered = running_sums(known, ["e"], "o", {"one": F.lit(1)}).where("all_one > 1")
    cut = F.greatest(F.lit(1), F.least(F.floor(F.col("all_one") * F.lit(fraction)), F.col("all_one") - 1))
    past = F.col("upto_one") <= cut
    place = lambda i: F.coalesce(F.get("v", F.lit(i)), F.lit(0.0))
    mean = lambda which: F.array(*[F.avg(F.when(which, place(i))) for i in range(width)])
    return stored(numbered.groupBy(F.col("e").alias(entity)).agg(F.count_if(past).alias("n_reference"), F.count_if(~past).alias("n_query"), mean(past).alias("reference"), mean(~past).alias("query")))


def axis_moments(profiles: DataFrame, vector: str, width: int, ddof: int) -> tuple[list[float], list[float]]:
    """Mean and deviation of each place over the rows; deviations of zero, or that one row has not, are 1."""
    sd = F.stddev_samp if ddof else F.stddev_pop
    row = profiles.agg(F.array(*[F.avg(F.col(vector)[i]) for i in range(width)]).alias("m"), F.array(*[sd(F.col(vector)[i]) for i in range(width)]).alias("s")).first()  # a value for each axis
    return [x or 0.0 for x in row["m"]], [x if x and x == x else 1.0 for x in row["s"]]


def scaled(v: Column, center: list[float], scale: list[float]) -> Column:
    pair = F.arrays_zip(F.array(*map(F.lit, center)).alias("c"), F.array(*map(F.lit, scale)).alias("s"))
    return F.zip_with(v, pair, lambda x, p: (x - p["c"]) / p["s"])


def identifiability(profiles: DataFrame, entity: str, width: int, queries: Column | None = None) -> DataFrame:
    """For each entity (or those that `queries` names): where its own reference ranks among all entities' references by
    distance from its later profile, and how far it and the nearest other one are.

    Distance: root mean square over the axes, each scaled by its sample deviation over references. Distances are compared to
    nine digits; ties go to the smaller entity.
    """
    _, sd = axis_moments(profiles, "reference", width, 1)
    unit = lambda c: scaled(F.col(c), [0.0] * width, sd)
    asked = profiles if queries is None else profiles.where(queries)
    own = asked.select(F.col(entity).alias("a"), "n_reference", "n_query", unit("query").alias("v"), F.round(V.masked_rms(unit("query"), unit("reference")), 9).alias("own"))
    got = tiles.ranked(own, profiles.select(F.col(entity).alias("b"), unit("reference").alias("v")), ["a", "n_reference", "n_query", "own"], "own", tiles.masked_rms)
    n = F.broadcast(profiles.agg(F.count("*").alias("__n")))  # one row
    got = stored(got)
    rank, nearest = F.col("rank"), F.col("best_other")
    return got.crossJoin(n).select(
        F.col("a").alias(entity), F.col("n_reference").alias("n_reference_sessions"), F.col("n_query").alias("n_query_sessions"),
        F.col("own").alias("own_distance"), nearest.alias("nearest_other_distance"), (nearest - F.col("own")).alias("distance_margin"), F.try_divide(F.col("own"), nearest).alias("distance_ratio"),
        "rank", (rank == 1).alias("top1_match"), (rank <= 5).alias("top5_match"), (1.0 / rank).alias("reciprocal_rank"), (1 - (rank - 1) / F.greatest(F.col("__n") - 1, F.lit(1))).alias("rank_percentile"), F.col("best_b").alias("nearest_other"),
    )


def identifiability_summary(table: DataFrame, candidates: int) -> DataFrame:
    """One row of what identifiability says together; candidates: how many references each query met."""
    got = table.agg(F.count("*").alias("n_queries"), F.count_if("top1_match").alias("top1_matches"), F.count_if("top5_match").alias("top5_matches"), F.avg("reciprocal_rank").alias("mean_reciprocal_rank"))
    for name, column in (("median_rank", "rank"), ("median_own_distance", "own_distance"), ("median_nearest_other_distance", "nearest_other_distance")):
        got = got.crossJoin(F.broadcast(exact_percentile(table, column).withColumnRenamed("percentile", name)))  # one row each
    n, one, five = F.col("n_queries"), F.lit(1.0 / candidates), F.lit(min(5.0 / candidates, 1.0))
    low, high = ST.wilson(F.col("top1_matches"), n, Z)
    survival = lambda k, p: ST.binomial_tail(F.col(k), n, p)
    return got.withColumns({
        "chance_top1": one, "top1_accuracy": F.col("top1_matches") / n, "top1_ci95_low": low, "top1_ci95_high": high, "top1_chance_p_value": survival("top1_matches", one),
        "chance_top5": five, "top5_accuracy": F.col("top5_matches") / n, "top5_chance_p_value": survival("top5_matches", five),
    })


def persona_return(profiles: DataFrame, entity: str, width: int, centers: list[list[float]], historical: DataFrame | None = None) -> DataFrame:
    """For each entity its historical cluster, the cluster nearest to its later profile, and the distances to the own and the
    nearest other centre. Centres are in units of the references' means and population deviations: history alone sets the
    scale. historical: entity, cluster; by default the centre nearest to the reference. Ties go to the smaller cluster."""
    mean, sd = axis_moments(profiles, "reference", width, 0)
    places = F.array(*[F.array(*map(F.lit, map(float, c))) for c in centers])
    away = lambda c: F.transform(places, lambda m: V.euclidean(scaled(F.col(c), mean, sd), m))
    rows = profiles.select(F.col(entity).alias("e"), "n_reference", "n_query", away("query").alias("d"), away("reference").alias("r"))
    first = lambda d: (F.array_position(d, F.array_min(d)) - 1).cast("int")
    if historical is None:
        rows = rows.withColumn("h", first(F.col("r")))
    else:
        rows = rows.join(historical.toDF("e", "h"), "e")
    d, h = F.col("d"), F.col("h")
    rows = rows.withColumn("own", F.element_at(d, h + 1)).withColumn("other", F.array_min(F.filter(d, lambda x, i: i != h)))
    return rows.select(
        F.col("e").alias(entity), F.col("n_reference").alias("n_reference_sessions"), F.col("n_query").alias("n_future_sessions"), h.alias("historical_cluster"), first(d).alias("future_nearest_cluster"),
        (first(d) == h).alias("same_cluster"), F.col("own").alias("own_centroid_distance"), F.col("other").alias("nearest_other_centroid_distance"), (F.col("other") - F.col("own")).alias("centroid_margin"),
    )


def persona_summary(table: DataFrame, k: int) -> DataFrame:
    """One row: how many entities return to their cluster, its interval, what cluster sizes alone would give, the median margin."""
    cells = table.groupBy("historical_cluster", "future_nearest_cluster").agg(F.count("*").alias("n"))  # clusters x clusters
    total = cells.agg(F.sum("n").alias("n_users"), F.coalesce(F.sum(F.when(F.col("historical_cluster") == F.col("future_nearest_cluster"), F.col("n"))), F.lit(0)).alias("same_cluster_users"))
    side = lambda c: cells.groupBy(F.col(c).alias("c")).agg(F.sum("n").alias(c))
    both = side("historical_cluster").join(side("future_nearest_cluster"), "c").agg(F.coalesce(F.sum(F.col("historical_cluster").cast("double") * F.col("future_nearest_cluster")), F.lit(0.0)).alias("__both"))
    got = total.crossJoin(F.broadcast(both)).crossJoin(F.broadcast(exact_percentile(table, "centroid_margin").withColumnRenamed("percentile", "median_centroid_margin")))
    n = F.col("n_users")
    low, high = ST.wilson(F.col("same_cluster_users"), n, Z)
    return got.select("n_users", F.lit(k).alias("k"), "same_cluster_users", (F.col("same_cluster_users") / n).alias("same_cluster_accuracy"), low.alias("same_cluster_ci95_low"), high.alias("same_cluster_ci95_high"), (F.col("__both") / n / n).alias("chance_agreement"), "median_centroid_margin")


def agreement_p(table: DataFrame, a: str, b: str, replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """replicates, at_least, p: how often labels a, dealt anew over the entities, agree with labels b as often as they do.

    What a permutation leaves of the entities is the table of counts by both labels: given its margins it is drawn label by
    label from multivariate hypergeometric laws, so no replicate visits the entities. Each replicate has a stream of its own.
    """
    counts = {(r[0], r[1]): r[2] for r in table.groupBy(a, b).agg(F.count("*")).collect()}  # labels x labels
    labels = sorted({x for pair in counts for x in pair})
    rows, columns = (np.array([sum(n for pair, n in counts.items() if pair[side] == x) for x in labels], dtype=np.int64) for side in (0, 1))
    agreed = sum(n for (x, y), n in counts.items() if x == y)

    def draw(batches):
        for batch in batches:
            hits = 0
            for replicate in batch.column("id").to_pylist():
                rng, left, same = np.random.default_rng([seed, replicate]), rows.copy(), 0
                for k, size in enumerate(columns):
                    dealt = rng.multivariate_hypergeometric(left, size)
                    left -= dealt
                    same += int(dealt[k])
                hits += same >= agreed
            yield pa.RecordBatch.from_arrays([pa.array([hits], type=pa.int64())], names=["hits"])

    hits = table.sparkSession.range(replicates).mapInArrow(draw, "hits long").agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("at_least"))
    return hits.select(F.lit(replicates).alias("replicates"), "at_least", ((F.col("at_least") + 1) / F.lit(replicates + 1)).alias("p"))
