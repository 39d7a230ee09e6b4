"""Model calls as relations: what to ask, cached answers, validation, verdicts. The call itself is a plugged-in function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import latest_record


def prompt_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256)


def judged(requests: DataFrame, cache: DataFrame, keys: list[str], answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every request with its answer: the last good cached one of the same key and prompt hash, or else that of
    `answer`, which sees only the requests that the cache lacks and returns keys, prompt_hash and answer."""
    on = [*keys, "prompt_hash"]
    good = latest_record(cache, on, "position", ~F.coalesce(F.col("failed"), F.lit(False))).select(*on, "answer")
    hit = requests.join(good, on)
    asked = requests.join(good, on, "left_anti")
    return hit.withColumn("cached", F.lit(True)).unionByName(asked.join(answer(asked).select(*on, "answer"), on, "left").withColumn("cached", F.lit(False)))


#: Axes of one turn that are asked for a direction.
MOST_ACTIVE = 4


def two_stage_scores(turns: DataFrame, keys: list[str], axes: list, screen: Callable[[DataFrame], DataFrame], direct: Callable[[DataFrame], DataFrame], most: int = MOST_ACTIVE) -> DataFrame:
    """keys, axis, score, evidence, failed of every turn and axis: 0 where nothing is said.

    screen returns keys, triggered (an array of axes) and failed; unknown axes are left out, then the first `most` stay.
    direct sees a row for each turn and axis that is left (with the turn's columns) and returns keys, axis, direction,
    evidence and failed; a direction other than 1 and -1 counts as none. failed marks a turn of which any call failed: its
    zeros may be no zeros.
    """
    known = F.array(*map(F.lit, axes))
    screened = screen(turns).select(*keys, F.slice(F.filter("triggered", lambda a: F.array_contains(known, a)), 1, most).alias("triggered"), F.coalesce("failed", F.lit(False)).alias("__screen"))
    asked = turns.join(screened.where("not __screen").select(*keys, F.explode(F.array_distinct("triggered")).alias("axis")), keys)
    got = direct(asked).select(*keys, "axis", "direction", "evidence", F.coalesce("failed", F.lit(False)).alias("__direct"))
    lost = got.groupBy(*keys).agg(F.bool_or("__direct").alias("__lost"))
    every = turns.select(*keys, F.explode(known).alias("axis")).join(screened.select(*keys, "__screen"), keys, "left").join(lost, keys, "left").join(got, [*keys, "axis"], "left")
    said = F.col("direction").isin(1, -1) & ~F.coalesce("__direct", F.lit(False))
    failed = F.coalesce("__screen", F.lit(False)) | F.coalesce("__lost", F.lit(False))
    return every.select(*keys, "axis", F.when(said, F.col("direction").cast("int")).otherwise(0).alias("score"), F.when(said, F.coalesce("evidence", F.lit(""))).otherwise("").alias("evidence"), failed.alias("failed"))


# The calls that change files, and those that plan, in a rendered turn.
EDIT_CALLS = ("Edit", "MultiEdit", "Write", "NotebookEdit")
PLAN_CALLS = ("EnterPlanMode", "ExitPlanMode")


def rendered_turns(blocks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, text, n_calls, edit_calls, edits_before_text, plan_mode of each turn, from its blocks in order.

    blocks: keys, order, kind (said, called or returned), name (of the tool), body. What was said and called is a line
    each, what came back an indented one on which line ends are spaces; blank texts are left out.
    """
    kind, body = F.col("kind"), F.trim(F.coalesce("body", F.lit("")))
    line = F.when((kind == "said") & (body != ""), F.concat(F.lit("ASSISTANT: "), body)).when(kind == "called", F.concat(F.lit("TOOL "), F.coalesce("name", F.lit("")), F.lit(": "), body)).when(kind == "returned", F.concat(F.lit("  -> "), F.replace(body, F.lit("\n"), F.lit(" "))))
    first = F.min(F.when((kind == "said") & (body != ""), F.col(order)))
    edit = (kind == "called") & F.col("name").isin(*EDIT_CALLS)
    rows = blocks.withColumns({"__line": line, "__first": first.over(W.partitionBy(*keys))})
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("__line").isNotNull(), F.struct(order, "__line")))), lambda s: s["__line"])  # one turn's
    early = edit & (F.col("__first").isNull() | (F.col(order) < F.col("__first")))
    plan = (kind == "called") & F.col("name").isin(*PLAN_CALLS)
    return rows.groupBy(*keys).agg(F.array_join(lines, "\n").alias("text"), F.count_if(kind == "called").alias("n_calls"), F.count_if(edit).alias("edit_calls"), F.count_if(early).alias("edits_before_text"), F.coalesce(F.bool_or(plan), F.lit(False)).alias("plan_mode"))


def stub_answer(labels: list[str]) -> Callable[[DataFrame], DataFrame]:
    """An offline stand-in: a label by the hash of the prompt."""

    def answer(asked: DataFrame) -> DataFrame:
        pick = F.pmod(F.conv(F.substring("prompt_hash", 1, 8), 16, 10).cast("long"), F.lit(len(labels))) + 1
        return asked.withColumn("answer", F.element_at(F.array(*map(F.lit, labels)), pick.cast("int")))

    return answer


def invalid_reason(label: Column, axis: Column, evidence: Column, n_axes: int, one_sided: list[int]) -> Column:
    """Why a judgment of one axis does not hold; null if it does."""
    return (
        F.when(axis.isNull() | (axis < 0) | (axis >= n_axes), "unknown axis")
        .when(~F.coalesce(label.isin("high", "low", "na"), F.lit(False)), "unknown label")
        .when(axis.isin(*one_sided) & (label == "low"), "no low side")
        .when((label != "na") & (F.coalesce(F.trim(evidence), F.lit("")) == ""), "no evidence")
        .when((label == "na") & (F.coalesce(F.trim(evidence), F.lit("")) != ""), "evidence without label")
    )


def complete_judgments(df: DataFrame, keys: list[str], axis: str, n_axes: int) -> DataFrame:
    """keys, missing, repeated: axes without a judgment, and with more than one."""
    return df.groupBy(*keys).agg((F.lit(n_axes) - F.countDistinct(axis)).alias("missing"), (F.count(axis) - F.countDistinct(axis)).alias("repeated"))


def verdict(text: Column) -> Column:
    """The verdict named in an answer: in a JSON field, or as a line of its own; null without one."""
    field = F.lower(F.get_json_object(F.regexp_extract(text, r"(?s)(\{.*\})", 1), "$.verdict"))
    line = F.lower(F.regexp_extract(text, r"(?im)^\s*verdict\s*[:=]\s*(\w+)", 1))
    found = F.coalesce(field, F.nullif(line, F.lit("")))
    return F.when(found.isin("pass", "success", "yes", "true"), "pass").when(found.isin("fail", "failure", "no", "false"), "fail")


def correction_score(corrections: Column, nudges: Column) -> Column:
    return corrections + 0.2 * nudges


def change_percent(before: Column, after: Column) -> Column:
    """Null where there was nothing before."""
    return F.try_divide((after - before) * 100.0, before)


def unfenced(text: Column) -> Column:
    """The body of a fenced block, or the text itself."""
    body = F.regexp_extract(text, r"(?s)^\s*```[^\n]*\n(.*?)\n```\s*$", 1)
    return F.when(body != "", body).otherwise(text)


def missing_headings(text: Column, headings: list[str]) -> Column:
    """The required headings of which no line is made."""
    return F.filter(F.array(*map(F.lit, headings)), lambda h: ~F.exists(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "^#+", "")) == h))


def unnumbered(text: Column) -> Column:
    """Without line number prefixes, where most of the first 20 lines have one."""
    lines = F.split(text, "\n")
    pattern = r"^\s*[0-9]+(\t|→|: )"
    first = F.slice(lines, 1, 20)
    numbered = F.size(F.filter(first, lambda x: x.rlike(pattern))) * 2 > F.size(first)
    return F.when(numbered, F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, pattern, "")), "\n")).otherwise(text)


def audited_runs(plan: DataFrame, attempts: DataFrame, keys: list[str], skill: str, condition: str) -> DataFrame:
    """keys, attempt, status, reward, faults of every planned run: a row for each attempt, so that a failure which was tried
    again stays seen, and one with status `missing` where there is none. status is valid where nothing is at fault.

    plan: keys and the skill's SHA-256 that is to be installed; attempts: keys, attempt, and the texts result, install and
    invocations, JSON objects each; null and unreadable ones count as empty.
    """
    read = lambda c: F.coalesce(F.try_parse_json(c), F.parse_json(F.lit("{}")))
    rows = plan.join(attempts, keys, "left").withColumns({"__r": read("result"), "__i": read("install"), "__v": read("invocations")})
    rewards = F.coalesce(F.try_variant_get("__r", "$.verifier_result.rewards", "map<string, variant>"), F.create_map().cast("map<string, variant>"))
    text = lambda c, path: F.try_variant_get(c, path, "string")
    unchanged = (F.schema_of_variant(F.try_variant_get("__i", "$.agents_unchanged", "variant")) == "BOOLEAN") & F.try_variant_get("__i", "$.agents_unchanged", "boolean")
    fine = {
        "exception": text("__r", "$.exception_info").isNull(),
        "no reward": F.map_contains_key(rewards, F.lit("reward")),
        "other condition": text("__i", "$.condition") == condition,
        "agents changed": unchanged,
        "other skill": text("__i", "$.skill_sha256") == F.col(skill),
        "no invocation": F.size(F.try_variant_get("__v", "$", "map<string, variant>")) > 0,
    }
    faults = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in fine.items()]))
    there = F.col("attempt").isNotNull()
    out = rows.withColumns({"__f": F.when(there, faults).otherwise(F.array(F.lit("no result"))), "reward": F.when(F.map_contains_key(rewards, F.lit("reward")), F.try_variant_get("__r", "$.verifier_result.rewards.reward", "double"))})
    return out.select(*keys, "attempt", F.when(~there, "missing").when(F.size("__f") == 0, "valid").otherwise("failed").alias("status"), "reward", F.col("__f").alias("faults"))
