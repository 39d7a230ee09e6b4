"""Table functions called from SQL text, against the DataFrame forms."""

import json

from pyspark.sql import functions as F

from loomspark.functions.tables import register
from loomspark.operators import diffs as D
from loomspark.operators import evidence as E

PATCH = "*** Begin Patch\n*** Update File: a b.py \n@@\n-old  one\n+new\tone\n+\n kept\r\n*** Add File: c.py\n+x\n*** Delete File: d.py\n*** End Patch"
PAYLOADS = [
    ("Edit", {"file_path": "a", "old_string": "x\ny", "new_string": "x\nz"}, None),
    ("edit", {"path": "a", "edits": [{"oldString": "a", "newString": None}, 7, {"new_text": "c"}, {"content": "d\nd"}]}, None),
    ("Write", {"content": "n"}, "given"),
    ("Write", {"content": "n"}, None),
    ("apply-patch", {"patchText": PATCH}, None),
    ("apply_patch", {"patch": ""}, None),
    ("Read", {"file_path": "a"}, None),
    ("edit", [1], None),
]


def test_write_actions(spark):
    register(spark)
    rows = [(k, tool, json.dumps(body), path) for k, (tool, body, path) in enumerate(PAYLOADS)] + [(90, "edit", "{", None), (91, None, None, None)]
    df = spark.createDataFrame(rows, "k int, tool string, payload string, f string")
    want = E.write_actions(df, ["k"], "tool", "payload", "f")
    got = spark.sql("SELECT d.k, a.* FROM {d} d, LATERAL write_actions(d.tool, d.payload, d.f) a", d=df)
    key = lambda df: sorted(map(repr, map(tuple, df.select("k", "action", "path", "operation", "added", "deleted").collect())))
    assert key(got) == key(want) and got.count() == 8


def test_patch_files_and_lines(spark):
    register(spark)
    df = spark.createDataFrame([(1, PATCH), (2, ""), (3, None), (4, "*** Add File: z\n+q")], "k int, x string")
    got = spark.sql("SELECT d.k, f.* FROM {d} d, LATERAL patch_files(d.x) f", d=df)
    want = df.select("k", F.posexplode(D.patch_sections(F.col("x"))).alias("position", "s")).select("k", "position", "s.operation", "s.path", "s.added", "s.deleted")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r)) for r in want.collect()) and got.count() == 4
    text = "3\t1\ta.py\n-\t-\tb.bin\nnoise\n\n2,0,c d.py"
    spark.createDataFrame([(text,)], "t string").createOrReplaceTempView("listings")
    lines = spark.sql("SELECT f.* FROM listings d, LATERAL numstat_lines(d.t) f")
    assert sorted(map(tuple, lines.collect())) == [("a.py", 3, 1, False), ("b.bin", 0, 0, True), ("c d.py", 2, 0, False)]
    assert [r.line for r in spark.sql("SELECT * FROM meaningful_lines(' a  b \r\n\n c')").orderBy("position").collect()] == ["a b", "c"]
