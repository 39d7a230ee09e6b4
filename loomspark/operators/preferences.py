"""Ternary preference scores in long form: sessions, users, confidence, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stats import laplace_confidence
from ..functions.text import squeezed

AXES = 14


def turn_scores(events: DataFrame) -> DataFrame:
    """user_id, session, turn_number, ts, axis, score: an event is a turn that speaks for, against or not on an axis."""
    kind = F.col("event_type")
    return events.select(
        "user_id",
        F.concat_ws(":", F.col("user_id").cast("string"), F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")).alias("session"),
        F.col("event_id").alias("turn_number"),
        "ts",
        (F.from_json("props", "k int")["k"] % AXES).alias("axis"),
        F.when(kind.isin("purchase", "signup"), 1).when(kind == "error", -1).otherwise(0).alias("score"),
        "value",
    )


def vectors(turns: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """For each key and axis: high, low, support, revised, recent, majority and mean of the turns that fired.

    recent is the score of the last such turn; majority the sign of the sum, with ties to recent. One hash aggregate.
    """
    order = F.col("turn_number") if order is None else order
    fired = F.col("score") != 0
    per = turns.groupBy(*keys, "axis").agg(F.count_if(F.col("score") > 0).alias("high"), F.count_if(F.col("score") < 0).alias("low"), F.max(F.when(fired, F.struct(order.alias("o"), F.col("score").alias("s")))).alias("last"))
    high, low = F.col("high"), F.col("low")
    recent = F.coalesce(F.col("last.s"), F.lit(0))
    return per.select(
        *keys, "axis", "high", "low", (high + low).alias("support"), ((high > 0) & (low > 0)).alias("revised"), recent.alias("recent"),
        F.when(high > low, 1).when(low > high, -1).otherwise(recent).alias("majority"),
        F.round(F.coalesce(F.try_divide((high - low).cast("double"), (high + low).cast("double")), F.lit(0.0)), 4).alias("mean"),
    )


def preferred_latest(turns: DataFrame, keys: list[str], preferred: Column) -> DataFrame:
    """The score of the latest preferred turn that fired, or else of the latest that did."""
    fired = F.when(F.col("score") != 0, F.struct(preferred.cast("int").alias("p"), F.col("turn_number").alias("n"), F.col("score").alias("s")))
    return turns.groupBy(*keys, "axis").agg(F.max(fired).alias("m")).select(*keys, "axis", F.coalesce("m.s", F.lit(0)).alias("score"))


def user_vectors(sessions: DataFrame) -> DataFrame:
    """Of session majorities, each supported session with the same weight: supported, mean, majority by user and axis."""
    s = F.when(F.col("support") > 0, F.col("majority"))
    per = sessions.groupBy("user_id", "axis").agg(F.count(s).alias("supported"), F.avg(s.cast("double")).alias("m"), F.sum(s).alias("t"))
    return per.select("user_id", "axis", "supported", F.round(F.coalesce("m", F.lit(0.0)), 6).alias("mean"), F.coalesce(F.sign("t").cast("int"), F.lit(0)).alias("majority"))


def profiles(turns: DataFrame, threshold: float, least_sessions: int) -> DataFrame:
    """user_id, axis, direction, confidence, sessions of well supported preferences: by distinct sessions for and against."""
    per = turns.where("score <> 0").groupBy("user_id", "axis").agg(F.countDistinct(F.when(F.col("score") > 0, F.col("session"))).alias("high"), F.countDistinct(F.when(F.col("score") < 0, F.col("session"))).alias("low"), F.countDistinct("session").alias("sessions"))
    conf = laplace_confidence(F.col("high"), F.col("low"))
    return per.withColumn("confidence", conf).where((F.col("high") != F.col("low")) & (conf >= threshold) & (F.col("sessions") >= least_sessions)).select("user_id", "axis", F.when(F.col("high") > F.col("low"), "high").otherwise("low").alias("direction"), F.round("confidence", 6).alias("confidence"), "sessions")


def of_exactly(sessions: DataFrame, entity: str, session: str, n: int) -> DataFrame:
    """The rows of entities with exactly n sessions, so that all weigh alike."""
    per = sessions.groupBy(entity).agg(F.countDistinct(session).alias("__n")).where(F.col("__n") == n).select(entity)
    return sessions.join(per, entity, "left_semi")


def retained_values(counts: DataFrame, threshold: float) -> DataFrame:
    """user_id, axis, value: the confidence with the sign of the majority where it is above the threshold, else 0.

    counts: user_id, axis, high, low.
    """
    c = laplace_confidence(F.col("high"), F.col("low"))
    direction = F.signum(F.col("high") - F.col("low"))
    return counts.select("user_id", "axis", F.when((c > threshold) & (direction != 0), direction * c).otherwise(0.0).alias("value"))


def evidence_profiles(records: DataFrame, threshold: float, least_sessions: int) -> DataFrame:
    """user_id, axis, direction, confidence, high_confidence, high_turns, low_turns, supporting, contradicting (sessions).

    records: user_id, axis, session, turn_number, label (high, low or other). As many turns for as against give no
    direction and a confidence of 0.
    """
    high, low = F.count_if(F.col("label") == "high"), F.count_if(F.col("label") == "low")
    session = lambda label: F.countDistinct(F.when(F.col("label") == label, F.col("session")))
    per = records.groupBy("user_id", "axis").agg(high.alias("high_turns"), low.alias("low_turns"), session("high").alias("__h"), session("low").alias("__l"))
    direction = F.when(F.col("high_turns") > F.col("low_turns"), "high").when(F.col("low_turns") > F.col("high_turns"), "low")
    confidence = F.when(direction.isNull(), 0.0).otherwise(laplace_confidence(F.col("high_turns"), F.col("low_turns")))
    own, other = F.when(direction == "high", F.col("__h")).when(direction == "low", F.col("__l")).otherwise(0), F.when(direction == "high", F.col("__l")).when(direction == "low", F.col("__h")).otherwise(0)
    sure = direction.isNotNull() & (confidence >= threshold) & (own >= least_sessions)
    return per.select("user_id", "axis", direction.alias("direction"), F.round(confidence, 4).alias("confidence"), sure.alias("high_confidence"), "high_turns", "low_turns", own.alias("supporting"), other.alias("contradicting"))


def ordered_evidence(records: DataFrame, message: Column) -> DataFrame:
    """user_id, axis, place, label, session, turn_number, message: the turns that speak for a side and say something, in
    order; a row each, so that no list grows with a user."""
    rows = records.withColumn("message", squeezed(message)).where("label in ('high', 'low') and message <> ''")
    place = F.row_number().over(W.partitionBy("user_id", "axis").orderBy("session", "turn_number"))
    return rows.select("user_id", "axis", place.alias("place"), "label", "session", "turn_number", "message")


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.85, "consistent").when(c >= 0.7, "default").when(c >= 0.5, "tentative")


def one_sided_confidence(high: Column) -> Column:
    """Of an axis without a low side; null without any high."""
    return F.when(high > 0, (high + 1.0) / (high + 2.0))


def representatives(df: DataFrame, keys: list[str], label: str, order: list[Column], most: int = 3) -> DataFrame:
    """At most `most` rows of each key: the first of every label, then the others in order."""
    first = F.row_number().over(W.partitionBy(*keys, label).orderBy(*order))
    ranked = df.withColumn("__first", F.when(first == 1, 0).otherwise(1))
    return ranked.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy("__first", *order))).where(F.col("__n") <= most).drop("__first", "__n")


def distinct_folded(df: DataFrame, keys: list[str], value: str, order: list[Column], most: int) -> DataFrame:
    """Values that differ beyond case and white space, the first of each, `most` of a key."""
    folded = F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))
    one = F.row_number().over(W.partitionBy(*keys, folded).orderBy(*order))
    kept = df.withColumn("__one", one).where("__one = 1").drop("__one")
    return kept.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def until_full(df: DataFrame, keys: list[str], value: str, order: list[Column], most: int) -> DataFrame:
    """Lines in order up to, and without, the first that makes the text longer than `most` characters."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("__sum", F.sum(F.length(value) + 1).over(w)).where(F.col("__sum") <= most).drop("__sum")
