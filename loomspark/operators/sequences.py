"""Ordered operators: chronological splits, sliding context, neighbours, running means, step-up."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import workspace


def last_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The last k rows of each key, in the order's reverse."""
    back = [c.desc() for c in order]
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*back))).where(F.col("__n") <= k).drop("__n")


def chronological_split(df: DataFrame, keys: list[str], order: list[str], fraction: float, upwards: bool = False, least: int = 1) -> DataFrame:
    """Adds `part`: past for the first share of each key's rows, at least `least` and at most all but one; future for
    the rest. Keys with a single row have no part. upwards rounds the future's share up instead of the past's down."""
    w = W.partitionBy(*keys)
    n = F.count("*").over(w)
    share = Decimal(str(fraction))  # as written: 0.7 of 90 rows are 63
    past = (n - F.ceil(n * F.lit(1 - share))) if upwards else F.floor(n * F.lit(share))
    past = F.greatest(F.lit(least), F.least(past, n - 1))
    return df.withColumns({"__i": F.row_number().over(w.orderBy(*order)), "__n": n, "__past": past}).withColumn("part", F.when(F.col("__n") > F.lit(1), F.when(F.col("__i") <= F.col("__past"), "past").otherwise("future"))).drop("__i", "__n", "__past")


def elapsed_split(df: DataFrame, keys: list[str], at: str, fraction: float) -> DataFrame:
    """Adds `part` by the share of the key's time span that has passed."""
    w = W.partitionBy(*keys)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    low, high = F.min(micros).over(w), F.max(micros).over(w)
    return df.withColumn("part", F.when(micros <= low + (high - low) * F.lit(fraction), "past").otherwise("future"))


def sliding_text(df: DataFrame, keys: list[str], order: str, line: Column, width: int, joiner: str = "\n") -> DataFrame:
    """Adds `context`: the last `width` lines up to and with the row's own."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(1 - width, 0)
    return df.withColumn("context", F.array_join(F.collect_list(line).over(w), joiner))


def around(df: DataFrame, keys: list[str], order: str, anchor: Column, n: int) -> DataFrame:
    """Rows within n places of an anchor row, with the anchor's place and the offset. One window, no join: each row
    looks at the anchors in the frame around it."""
    w = W.partitionBy(*keys).orderBy(order)
    numbered = df.withColumn("__i", F.row_number().over(w))
    frame = W.partitionBy(*keys).orderBy("__i").rowsBetween(-n, n)
    found = numbered.withColumn("__anchors", F.collect_list(F.when(anchor, F.col("__i"))).over(frame))
    return found.withColumn("anchor_place", F.explode("__anchors")).withColumn("offset", F.col("__i") - F.col("anchor_place")).drop("__i", "__anchors")


def running_mean(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds k and running: the mean of the first k rows."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"k": F.row_number().over(w), "running": F.avg(value).over(w.rowsBetween(W.unboundedPreceding, 0))})


def first_stable(df: DataFrame, keys: list[str], order: str, good: Column) -> DataFrame:
    """Of each key the first place from which on every row is good; null where the last one is not: the first place
    after the last bad one. One shuffle by the keys, and no list of places."""
    bad = F.max(F.when(~F.coalesce(good, F.lit(False)), F.col(order))).over(W.partitionBy(*keys))
    after = df.withColumn("__bad", bad)
    return after.groupBy(*keys).agg(F.min(F.when(F.col("__bad").isNull() | (F.col(order) > F.col("__bad")), F.col(order))).alias("stable_from"))


def step_up(df: DataFrame, p: str, bins: int = 1000) -> DataFrame:
    """Adds q: Benjamini-Hochberg adjusted p values of the whole table; null p values have none and do not count.

    Equal p values share a q, so distinct ones are ranked with their counts: within bins of the p value, then over one
    row for each bin.
    """
    tests = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("__n")).withColumn("__bin", F.floor(F.col("__p") * bins))
    below = W.orderBy("__bin")
    bin_ = tests.groupBy("__bin").agg(F.sum("__n").alias("__all"))
    offsets = bin_.select("__bin", (F.sum("__all").over(below) - F.col("__all")).alias("__before"), F.sum("__all").over(W.partitionBy()).alias("__total"))  # a row for each bin
    w = W.partitionBy("__bin").orderBy("__p")
    ranked = tests.join(F.broadcast(offsets), "__bin").withColumn("__q", F.col("__p") * F.col("__total") / (F.col("__before") + F.sum("__n").over(w)))
    lowest = ranked.groupBy("__bin").agg(F.min("__q").alias("__m"))
    later = lowest.select("__bin", F.min("__m").over(below.rowsBetween(1, W.unboundedFollowing)).alias("__later"))  # a row for each bin
    own = F.min("__q").over(w.rowsBetween(0, W.unboundedFollowing))
    q = ranked.join(F.broadcast(later), "__bin").select("__p", F.least(F.lit(1.0), own, F.col("__later")).alias("q"))
    return df.join(q, F.col(p).eqNullSafe(F.col("__p")), "left").drop("__p")


def running_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name, `upto_` (the sum over the rows of the same keys up to this one) and `all_` (over all of them), and
    `following`, the next row's order. Rows of the same keys have distinct orders, none of them null.

    Rows are dealt in ranges of (keys, order) and written; running sums stay within a range, and a table with a row for each
    range and key tells what stands before and after it. So one key may hold all rows.
    """
    spark = df.sparkSession
    where = workspace(spark)
    ranged = df.withColumns({f"__{n}": c for n, c in sums.items()}).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, order)
    ranged.withColumn("__range", F.spark_partition_id()).write.parquet(where)
    rows = spark.read.parquet(where)
    totals = rows.groupBy("__range", *keys).agg(F.min(order).alias("__first"), *[F.sum(f"__{n}").alias(f"__t_{n}") for n in sums])
    by_key = W.partitionBy(*keys)  # a row for each range that the key is in
    before = by_key.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    stands = totals.select("__range", *keys, F.lead("__first").over(by_key.orderBy("__range")).alias("__then"), *[c for n in sums for c in (F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}"), F.sum(f"__t_{n}").over(by_key).alias(f"all_{n}"))])
    own = W.partitionBy("__range", *keys).orderBy(order)
    run = rows.withColumns({"following": F.lead(order).over(own), **{f"upto_{n}": F.sum(f"__{n}").over(own.rowsBetween(W.unboundedPreceding, 0)) for n in sums}})
    met = run.join(stands, ["__range", *keys])
    met = met.withColumns({"following": F.coalesce("following", "__then"), **{f"upto_{n}": F.col(f"upto_{n}") + F.col(f"__b_{n}") for n in sums}})
    return met.drop("__range", "__then", *[x for n in sums for x in (f"__{n}", f"__b_{n}")])


def exact_percentile(df: DataFrame, value: str, at: float = 0.5) -> DataFrame:
    """One row, `percentile`: the value at a share of the sorted rows, between two rows linearly; nulls do not count. No task
    holds more than a range of the distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")).withColumn("__one", F.lit(0))
    run = running_sums(counts, ["__one"], "v", {"n": F.col("n")})
    spot = F.lit(at) * (F.col("all_n") - 1)
    low, high = F.floor(spot), F.ceil(spot)
    covers = lambda k: (F.col("upto_n") > k) & (F.col("upto_n") - F.col("n") <= k)
    ends = run.agg(F.max(F.when(covers(low), F.col("v"))).alias("a"), F.max(F.when(covers(high), F.col("v"))).alias("b"), F.max(spot - low).alias("share"))
    return ends.select((F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("percentile"))
