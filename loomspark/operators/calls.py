"""Outside calls under load: bounded in flight, tried again with waiting, logged, and resumed from the log."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LOG = "id string, answer string, failed boolean, error string, attempts int, round int, position long"


def _tried(call: Callable[[str, int], str], prompt: str, attempts: int, wait: float) -> tuple[str | None, str | None, int]:
    """answer, error, attempts made; between attempts it waits, twice as long each time."""
    error = None
    for k in range(attempts):
        try:
            return call(prompt, k), None, k + 1
        except Exception as e:  # whatever a service throws is a failed call, and has its row
            error = f"{type(e).__name__}: {e}"
            if k + 1 < attempts:
                time.sleep(wait * 2**k)
    return None, error, attempts


def answers(prompts, call: Callable[[str, int], str], in_flight: int, attempts: int, wait: float):
    """What each prompt gives, in their order, with `in_flight` calls at most under way or waiting for their turn."""
    with ThreadPoolExecutor(in_flight) as pool:
        under_way: deque = deque()
        for prompt in prompts:
            if len(under_way) == in_flight:
                yield under_way.popleft().result()
            under_way.append(pool.submit(_tried, call, prompt, attempts, wait))
        while under_way:
            yield under_way.popleft().result()


def called(requests: DataFrame, id: str, prompt: str, call: Callable[[str, int], str], log: str, tasks: int = 4, in_flight: int = 8, attempts: int = 3, wait: float = 1.0, per_round: int = 10_000) -> DataFrame:
    """id, answer, failed, error, attempts of every request, whose ids are distinct texts; null prompts are empty ones.

    call(prompt, attempt) answers or throws. Requests go in rounds of about `per_round`, dealt by a hash of the id to `tasks`
    tasks of `in_flight` calls each: tasks * in_flight calls at most are under way at any time. A round's rows are added to
    the table `log` when it ends, failures among them. Only what the log has no good answer to is asked, so a run after one
    that was cut short, or an executor that is lost, repeats calls of the unfinished round alone; failures are tried anew.
    """
    spark = requests.sparkSession
    asked = requests.select(F.col(id).cast("string").alias("id"), F.coalesce(F.col(prompt).cast("string"), F.lit("")).alias("prompt"))
    spark.createDataFrame([], LOG).write.mode("append").parquet(log)

    def run(batches):
        for batch in batches:
            rows = list(answers(batch.column("prompt").to_pylist(), call, in_flight, attempts, wait))
            answer, error, tries = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])
            ids = batch.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(answer, pa.string()), pa.array([e is not None for e in error], pa.bool_()), pa.array(error, pa.string()), pa.array(tries, pa.int32()), *[batch.column(c) for c in ("round", "position")]], names=["id", "answer", "failed", "error", "attempts", "round", "position"])

    def known() -> DataFrame:
        return spark.read.schema(LOG).parquet(log)

    todo = asked.join(known().where("not failed").select("id"), "id", "left_anti")
    rounds = -(-todo.count() // per_round)
    done = known().agg(F.coalesce(F.max("round"), F.lit(0))).first()[0]
    for k in range(rounds):
        # Of the requests as they were at the start: what an earlier round has logged is not in this one.
        own = todo.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == k)
        own = own.withColumns({"round": F.lit(done + k + 1), "position": F.xxhash64("id")}).repartition(tasks, "id").sortWithinPartitions("position")
        own.mapInArrow(run, LOG).write.mode("append").parquet(log)
    last = W.partitionBy("id").orderBy(F.col("failed"), F.col("round").desc())
    best = known().withColumn("__n", F.row_number().over(last)).where("__n = 1")
    return asked.select("id").join(best.select("id", "answer", "failed", "error", "attempts"), "id", "left")
