"""Filters and counting filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(name: str) -> Column:
    """Not null and not blank."""
    return F.col(name).isNotNull() & (F.trim(name) != "")


def any_nonzero(columns: list[str]) -> Column:
    return F.greatest(*[F.abs(F.coalesce(F.col(c), F.lit(0))) for c in columns], F.lit(0)) > 0


def matching(df: DataFrame, wanted: dict[str, str | None]) -> DataFrame:
    """Rows whose columns, as text, equal the given values; None sets no condition."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name).cast("string") == str(value))
    return df


def cascade(df: DataFrame, conditions: list[Column]) -> DataFrame:
    """step, n: how many rows pass the first `step` conditions, all in one pass."""
    so_far, counts = F.lit(True), []
    for c in conditions:
        so_far = so_far & F.coalesce(c, F.lit(False))
        counts.append(F.count_if(so_far))
    one = df.agg(F.array(*counts).alias("ns"))
    return one.select(F.posexplode("ns").alias("at", "n")).select((F.col("at") + 1).alias("step"), "n")


def threshold_curve(df: DataFrame, value: str, thresholds: list) -> DataFrame:
    """k, entities: rows with a value of k or more, one pass for all thresholds."""
    pairs = df.agg(F.array(*[F.struct(F.lit(k).alias("k"), F.count_if(F.col(value) >= k).alias("entities")) for k in thresholds]).alias("s"))
    return pairs.select(F.inline("s"))


def bands(df: DataFrame, value: str, limits: list[tuple]) -> DataFrame:
    """A row for each band (lo, hi), both ends inclusive, that the value is in."""
    each = F.array(*[F.when(F.col(value).between(lo, hi), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))) for lo, hi in limits])
    return df.withColumn("__b", F.explode(F.filter(each, lambda s: s.isNotNull()))).select("*", "__b.lo", "__b.hi").drop("__b")
