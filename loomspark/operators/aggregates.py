"""Aggregates that take more than one built-in: modes, distributions, histograms, shares, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def mode(df: DataFrame, keys: list[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent value of each key; ties go to the smallest. Two partial aggregations, no window."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(name))


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, p25, median, p75, p90, largest: exact, linearly interpolated quantiles."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    got = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q.alias("q"), F.max(value).alias("largest"))
    return got.select(*keys, "n", "mean", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), F.col("q")[3].alias("p90"), "largest")


def top_values(df: DataFrame, value: str, k: int) -> DataFrame:
    """The k most frequent values, null as '<null>', with counts and shares of all rows."""
    counts = df.groupBy(F.coalesce(F.col(value).cast("string"), F.lit("<null>")).alias(value)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.orderBy(F.desc("n"), value).limit(k).crossJoin(F.broadcast(total)).select(value, "n", F.try_divide(F.col("n"), F.col("total")).alias("share"))  # one row


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """lo, hi, n of half-open bins, the last one closed; empty bins stay, rows outside do not count."""
    v, last = F.col(value), len(edges) - 2
    counts = F.array(*[F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.count_if((v >= lo) & ((v <= hi) if k == last else (v < hi))).alias("n")) for k, (lo, hi) in enumerate(zip(edges, edges[1:]))])
    return df.agg(counts.alias("s")).select(F.inline("s"))


def cut(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins (lo, hi]; null outside."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((value > lo) & (value <= hi), label).otherwise(out)
    return out


def top_share(df: DataFrame, value: str, k: int) -> DataFrame:
    """top, total, share of the k largest values."""
    top = df.orderBy(F.col(value).desc()).limit(k).agg(F.sum(value).alias("top"))
    return top.crossJoin(F.broadcast(df.agg(F.sum(value).alias("total")))).select("top", "total", F.try_divide(F.col("top"), F.col("total")).alias("share"))  # one row


def nested_mean(df: DataFrame, levels: list[list[str]], value: str) -> DataFrame:
    """Means of means: each level's groups weigh alike within the next."""
    for keys in levels:
        df = df.groupBy(*keys).agg(F.avg(value).alias(value))
    return df


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows alike in keys the first by an order that the caller makes total."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts and row shares of the stated values."""
    n = df.groupBy(row).agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == v).alias(v) for v in values])
    return n.select(row, *values, *[F.round(F.try_divide(F.col(v), F.col("total")), 6).alias(f"{v}_share") for v in values])
