"""Seeded resampling by hash, so that a result depends on the seed and the keys alone, not on partitions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def hashed(keys: list[str], seed) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"), 256)


def numbered(df: DataFrame, keys: list[str], seed, by: list[str] | None = None, name: str = "place") -> DataFrame:
    """Adds each row's number, from 1, in the order of a hash of its keys (within `by`).

    Rows are numbered within the 4096 stretches that the first digits of the hash make, and stretches by their counts, so
    that no task sorts the whole table.
    """
    by = by or []
    rows = df.withColumn("__h", hashed([*by, *keys], seed)).withColumn("__s", F.substring("__h", 1, 3))
    counts = rows.groupBy(*by, "__s").agg(F.count("*").alias("__n"))
    w = W.partitionBy(*by).orderBy("__s").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(*by, "__s", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.row_number().over(W.partitionBy(*by, "__s").orderBy("__h", *keys))
    return rows.join(before, [*by, "__s"]).withColumn(name, place).drop("__h", "__s", "__before")


def shuffled(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Adds place: the row's number in an order by hash."""
    return numbered(df, keys, seed)


def random_parts(df: DataFrame, keys: list[str], seed: int, replicates: int, fraction: float) -> DataFrame:
    """Adds replicate and part: in each replicate floor(n * fraction) rows, by hash, are `first`, the others `rest`. The
    fraction is the decimal number that it is written as: 0.7 of 90 rows are 63, though the double below 0.7 makes 62."""
    each = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    n = df.agg(F.floor(F.count("*") * F.lit(Decimal(str(fraction)))).cast("long").alias("__first"))  # one row
    return numbered(each, keys, seed, ["replicate"], "__place").crossJoin(F.broadcast(n)).withColumn("part", F.when(F.col("__place") <= F.col("__first"), "first").otherwise("rest")).drop("__place", "__first")


def sample_rows(df: DataFrame, keys: list[str], seed: int, n: int) -> DataFrame:
    """n rows without replacement: the smallest hashes, by a partial top-n."""
    return df.withColumn("__h", hashed(keys, seed)).orderBy("__h", *keys).limit(n).drop("__h")


def bootstrap_weights(groups: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """replicate, key, weight: how often each group is drawn when as many are drawn, with replacement, as there are.

    Each draw picks a group by a hash, by its number; only the groups that were drawn have rows. Draws are dealt over
    all tasks; the driver gets one count.
    """
    every = numbered(groups.select(key).distinct(), [key], seed, name="__i").withColumn("__i", F.col("__i") - 1)
    n = groups.select(key).distinct().count()
    draws = groups.sparkSession.range(replicates * n).select(F.expr(f"cast(id div {max(n, 1)} as int)").alias("replicate"), F.expr(f"cast(id % {max(n, 1)} as int)").alias("__d"))
    picked = draws.select("replicate", F.pmod(F.xxhash64(F.lit(seed), "replicate", "__d"), F.lit(max(n, 1))).alias("__i"))
    return picked.groupBy("replicate", "__i").agg(F.count("*").alias("weight")).join(every, "__i").select("replicate", key, "weight")


def permuted(df: DataFrame, key: str, label: str, replicates: int, seed: int) -> DataFrame:
    """replicate, key, label: the labels dealt anew over the keys."""
    each = df.select(key, label).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    spot = numbered(each, [key], f"{seed}:spots", ["replicate"], "__i").select("replicate", key, "__i")
    dealt = numbered(each, [key], f"{seed}:labels", ["replicate"], "__i").select("replicate", "__i", label)
    return spot.join(dealt, ["replicate", "__i"]).drop("__i")
