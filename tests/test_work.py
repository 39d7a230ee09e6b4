"""Calls under load, edits carried as state, exact filters before likenesses."""

import difflib
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from loomspark.operators import calls as CA
from loomspark.operators import diffs as D


def test_calls_in_flight_are_bounded_and_in_order():
    lock, now, most = threading.Lock(), [0], [0]

    def call(prompt, attempt):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.03 if int(prompt) % 7 else 0.1)
        with lock:
            now[0] -= 1
        if int(prompt) % 5 == 0 and attempt == 0:
            raise TimeoutError("slow")
        return f"a{prompt}"

    got = list(CA.answers(map(str, range(40)), call, 6, 2, 0.01))
    assert [g[0] for g in got] == [f"a{k}" for k in range(40)] and most[0] == 6
    assert [g[2] for g in got] == [2 if k % 5 == 0 else 1 for k in range(40)]


def test_retries_wait_twice_as_long_each_time(monkeypatch):
    waits = []
    monkeypatch.setattr(CA.time, "sleep", waits.append)
    assert CA._tried(lambda p, k: 1 / 0, "x", 4, 0.5) == (None, "ZeroDivisionError: division by zero", 4) and waits == [0.5, 1.0, 2.0]


def test_calls_resume_from_the_log(spark, tmp_path):
    """Some fail for good, one round is cut short: the next run asks only what has no good answer yet."""
    folder, log = str(tmp_path / "asked"), str(tmp_path / "log")
    os.mkdir(folder)
    stop = str(tmp_path / "stop")
    open(stop, "w").close()

    def call(prompt, attempt):
        with open(f"{folder}/{prompt}", "a") as f:
            f.write("x")
        if len(os.listdir(folder)) > 25 and os.path.exists(stop):
            os._exit(1)  # the worker is lost, and so is the job
        if prompt.endswith("7"):
            raise ValueError("no")
        return prompt.upper()

    df = spark.createDataFrame([(f"i{k}", f"p{k}") for k in range(60)], "i string, p string")
    with pytest.raises(Exception):
        CA.called(df, "i", "p", call, log, tasks=2, in_flight=3, attempts=2, wait=0.01, per_round=8)
    first = spark.read.parquet(log).where("not failed")
    before = {r.id for r in first.collect()}
    asked = {k: os.path.getsize(f"{folder}/p{k}") for k in range(60) if os.path.exists(f"{folder}/p{k}")}
    assert 0 < len(before) < 54
    os.remove(stop)
    got = {r.id: r for r in CA.called(df, "i", "p", call, log, tasks=2, in_flight=3, attempts=2, wait=0.01, per_round=8).collect()}
    assert len(got) == 60
    for k in range(60):
        r = got[f"i{k}"]
        assert (r.answer, r.failed, r.attempts) == ((None, True, 2) if k % 10 == 7 else (f"P{k}", False, 1))
        if f"i{k}" in before:
            assert os.path.getsize(f"{folder}/p{k}") == asked[k]  # not asked again
    good = {k: os.path.getsize(f"{folder}/p{k}") for k in range(60) if k % 10 != 7}
    again = CA.called(df, "i", "p", call, log, tasks=2, in_flight=3, attempts=2, wait=0.01, per_round=8)
    assert again.where("failed").count() == 6 and good == {k: os.path.getsize(f"{folder}/p{k}") for k in good}


def fold(edits):
    content, misses, seeded = "", 0, False
    for kind, old, new in edits:
        if kind == "seed" and not seeded:
            content, seeded = new, True
        elif kind == "edit":
            if seeded and old and old in content:
                content = content.replace(old, new, 1)
            else:
                misses += 1
    return content, misses


def some_edits(r, n):
    return [(r.choice(["edit"] * 8 + ["seed", "other"]), r.choice(["", "a", "ab", "b", "é"]), r.choice(["", "b", "aé", "ba"])) for _ in range(n)]


def test_replay_equals_the_fold(spark):
    r = random.Random(3)
    files = {(u, p): [("seed", "", "ab" * r.randint(0, 9))] * (p % 3 > 0) + some_edits(r, r.randint(1, 50)) for u in range(4) for p in range(6)}
    rows = [(u, p, k, *e) for (u, p), es in files.items() for k, e in enumerate(es)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "u int, p long, o int, k string, a string, b string")
    assert {(x.u, x.p): (x.content, x.misses) for x in D.replay(df, ["u", "p"], "o", "k", "a", "b").collect()} == {key: fold(es) for key, es in files.items()}


def test_replay_of_very_many_edits_of_one_file(spark):
    n = 100_000
    df = spark.range(n + 1).selectExpr("'f' as p", "id as o", "if(id = 0, 'seed', 'edit') as k", "if(id % 2 = 1, 'x', 'y') as a", "if(id = 0, 'x...', if(id % 2 = 1, 'y', 'x')) as b")
    assert [tuple(r) for r in D.replay(df, ["p"], "o", "k", "a", "b").collect()] == [("f", "x...", 0)]


def test_replay_of_a_stream_goes_on_after_a_restart(spark, tmp_path):
    r = random.Random(5)
    files = {p: [("seed", "", "abab")] + some_edits(r, 30) for p in ("x", "y")}
    rows = [(p, k, *e) for p, es in files.items() for k, e in enumerate(es)]
    schema = "p string, o int, k string, a string, b string"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    seen = {}

    def run():
        edits = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = D.replay_stream(edits, ["p"], "o", "k", "a", "b").writeStream.outputMode("update").foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/{k}")).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        for k in sorted(map(int, os.listdir(out))):
            seen.update({x.p: (x.content, x.misses, x.late) for x in spark.read.parquet(f"{out}/{k}").collect()})

    spark.createDataFrame([x for x in rows if x[1] < 12], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert {p: v[:2] for p, v in seen.items()} == {p: fold(es[:12]) for p, es in files.items()}
    spark.createDataFrame([x for x in rows if x[1] >= 12], schema).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([("x", 3, "edit", "a", "Z")], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert seen == {"x": (*fold(files["x"]), 1), "y": (*fold(files["y"]), 0)}


def plain_recall(a, b):
    free, total = list(b), 0.0
    for x in a:
        if not free:
            break
        likeness = [difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for y in free]
        best = max(likeness)
        free.pop(likeness.index(best))
        total += best if best >= D.ALIKE else 0.0
    return total / len(a) if a else 1.0


def pooled(a, b):
    pool, total = D.Pool(b), 0.0
    for x in a:
        if not pool.left:
            break
        likeness = pool.take(x)
        total += likeness if likeness >= D.ALIKE else 0.0
    return (total / len(a) if a else 1.0), pool.ratios


def test_recall_with_filters_equals_all_ratios():
    for seed in range(150):
        r = random.Random(seed)
        word = lambda: "".join(r.choice("abc é") for _ in range(r.choice([0, 1, 3, 8, 20])))
        lines = [word() for _ in range(12)]
        a, b = ([r.choice([r.choice(lines), word()]) for _ in range(r.randint(0, 14))] for _ in range(2))
        assert pooled(a, b)[0] == plain_recall(a, b), seed


def test_few_ratios_on_long_patches():
    """2 000 lines of code, a tenth of them changed a little: a hundredth of the ratios that trying all would take."""
    r = random.Random(9)
    names = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz_") for _ in range(r.randint(3, 12))) for _ in range(400)]
    b = [f"{r.choice(names)} = {r.choice(names)}({r.choice(names)}, {r.choice(names)})" for _ in range(2000)]
    a = [x.replace("(", "[", 1) if k % 10 == 0 else x for k, x in enumerate(b)]
    r.shuffle(a)
    recall, ratios = pooled(a, b)
    assert recall > 0.98 and ratios * 10 < 200 * 2000
    few = [x.replace(" = ", "=") for x in b[:60]]
    assert pooled(few, b[:300])[0] == plain_recall(few, b[:300])
