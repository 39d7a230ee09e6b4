"""Small cases whose results are worked out by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from loomspark.functions import stats as ST
from loomspark.functions import text as X
from loomspark.functions import vectors as V
from loomspark.operators import aggregates as A
from loomspark.operators import diffs as D
from loomspark.operators import evidence as E
from loomspark.operators import geometry as G
from loomspark.operators import joins as J
from loomspark.operators import preferences as P
from loomspark.operators import resampling as R
from loomspark.operators import sequences as Q
from loomspark.operators import statistics as S
from loomspark.operators import tiles
from loomspark.sources import tables as T


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_multiset_recall_counts_repeats(spark):
    x = F.array(F.lit("x"), F.lit("x"))
    got = one(spark, X.multiset_recall(x, F.array(F.lit("x"))), X.multiset_recall(F.array().cast("array<string>"), x))
    assert tuple(got) == (0.5, 1.0)


def test_first_line_of_empty_text(spark):
    assert tuple(one(spark, X.first_line(F.lit("")), X.first_line(F.lit("a\nb")))) == ("", "a")


def test_json_list(spark):
    got = one(spark, X.json_list(F.lit('["a","b"]')), X.json_list(F.lit("c")), X.json_list(F.lit(None).cast("string")))
    assert tuple(got) == (["a", "b"], ["c"], [])


def test_vectors_ternary_ties(spark):
    rows = [("u", "s", 1, 0, 1), ("u", "s", 2, 0, -1), ("u", "s", 3, 0, 0), ("u", "s", 1, 1, 0)]
    got = {r.axis: r for r in P.vectors(spark.createDataFrame(rows, "user_id string, session string, turn_number int, axis int, score int"), ["user_id", "session"]).collect()}
    assert (got[0].support, got[0].mean, got[0].majority, got[0].recent, got[0].revised) == (2, 0.0, -1, -1, True)
    assert (got[1].support, got[1].mean, got[1].majority) == (0, 0.0, 0)


def test_equal_session_weight(spark):
    rows = [("u", 0, 2, 1), ("u", 0, 1, -1), ("u", 0, 0, 0)]
    got = P.user_vectors(spark.createDataFrame(rows, "user_id string, axis int, support long, majority int")).first()
    assert (got.supported, got.mean, got.majority) == (2, 0.0, 0)


def test_laplace(spark):
    assert one(spark, ST.laplace_confidence(F.lit(2), F.lit(1)))[0] == pytest.approx(0.6)


def test_profile_needs_a_direction(spark):
    rows = [("u", "s1", 1, 0, 1), ("u", "s2", 2, 0, -1), ("u", "s1", 1, 1, 1), ("u", "s2", 2, 1, 1)]
    got = P.profiles(spark.createDataFrame(rows, "user_id string, session string, turn_number int, axis int, score int"), 0.6, 2).collect()
    assert [(r.axis, r.direction, r.confidence) for r in got] == [(1, "high", 0.75)]


def test_split_keeps_minimum_past(spark):
    df = spark.createDataFrame([("u", k) for k in range(5)] + [("v", 0)], "u string, k int")
    got = {(r.u, r.k): r.part for r in Q.chronological_split(df, ["u"], ["k"], 0.7, upwards=True, least=3).collect()}
    assert [got["u", k] for k in range(5)] == ["past"] * 3 + ["future"] * 2
    assert got["v", 0] is None


def test_stable_from(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", 4, True), ("b", 1, False), ("c", 1, None)], "u string, k int, g boolean")
    got = {r.u: r.stable_from for r in Q.first_stable(df, ["u"], "k", F.col("g")).collect()}
    assert got == {"a": 3, "b": None, "c": None}


def test_step_up(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,)], "p double")
    got = {r.p: r.q for r in Q.step_up(df, "p").collect()}
    assert [round(got[p], 4) for p in (0.01, 0.03, 0.04, 0.5)] == [0.04, 0.0533, 0.0533, 0.5]


def test_asof_both_ways(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 2)], "k string, t int")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("a", 9, "z")], "k string, t int, v string")
    back = {(r.k, r.t): r.v for r in J.asof_backward(left, right, ["k"], "t", ["v"]).collect()}
    assert back == {("a", 5): "y", ("a", 1): "x", ("b", 2): None}
    strict = {(r.k, r.t): r.v for r in J.asof_backward(left, right, ["k"], "t", ["v"], strict=True).collect()}
    assert strict == {("a", 5): "x", ("a", 1): None, ("b", 2): None}
    ahead = {(r.k, r.t): (r.v, r.next_at) for r in J.asof_forward(left, right, ["k"], "t", ["v"]).collect()}
    assert ahead == {("a", 5): ("y", 5), ("a", 1): ("x", 1), ("b", 2): (None, None)}


def test_overlaps_count_each_pair_once(spark):
    import datetime as dt

    day = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    a = spark.createDataFrame([("k", 1, day(0), day(50))], "g string, a int, la timestamp, ha timestamp")
    b = spark.createDataFrame([("k", 1, day(50), day(60)), ("k", 2, day(51), day(60)), ("k", 3, day(-90), day(90)), ("j", 4, day(0), day(9))], "g string, b int, lb timestamp, hb timestamp")
    assert sorted(r.b for r in J.overlaps(a, b, "g", ("la", "ha"), ("lb", "hb"), 3600).collect()) == [1, 3]


def test_suffix_match_ambiguity(spark):
    left = spark.createDataFrame([(1, "/w/src/a/f.py"), (2, "f.py"), (3, "/w/g.py"), (4, "/w/none.py")], "id int, p string").withColumn("k", F.lit(1))
    right = spark.createDataFrame([("src/a/f.py",), ("src/b/f.py",), ("lib/g.py",)], "c string").withColumn("k", F.lit(1))
    got = {r.id: r.matched for r in J.suffix_match(left, right, ["k"], "p", "c", ["id"]).collect()}
    assert got == {1: "src/a/f.py", 2: None, 3: "lib/g.py", 4: None}


def test_incomplete_pairs_fail(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 1.0)], "k string, c string, v double")
    with pytest.raises(Exception, match="incomplete"):
        J.complete_pairs(df, ["k"], "c", ["x", "y"], F.col("v")).collect()


def test_icc_of_separate_and_of_equal_groups(spark):
    rows = [("a", 1.0), ("a", 1.0), ("b", 3.0), ("b", 3.0)]
    got = S.icc(S.group_moments(spark.createDataFrame(rows, "g string, v double"), [], "g", "v"), []).first()
    assert got.icc == pytest.approx(1.0) and got.reason == "ok"
    flat = S.icc(S.group_moments(spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, v double"), [], "g", "v"), []).first()
    assert flat.icc is None and flat.reason == "no variance"
    assert S.icc(S.group_moments(spark.createDataFrame([("a", 1.0)], "g string, v double"), [], "g", "v"), []).first().reason == "few groups"


def test_phi_and_wilson_edges(spark):
    low, high = ST.wilson(F.lit(0), F.lit(10))
    none, _ = ST.wilson(F.lit(0), F.lit(0))
    got = one(spark, ST.phi(*[F.lit(25)] * 4), ST.phi(F.lit(5), F.lit(0), F.lit(0), F.lit(5)), ST.phi(F.lit(5), F.lit(0), F.lit(5), F.lit(0)), low, high, none)
    assert got[0] == 0 and got[1] == pytest.approx(1) and got[2] is None and got[3] == 0 and 0.2 < got[4] < 0.35 and got[5] is None


def test_fisher_and_binomial(spark):
    df = spark.createDataFrame([(3, 1, 1, 3)], "a int, b int, c int, d int")
    assert df.select(S.fisher_two_sided("a", "b", "c", "d")).first()[0] == pytest.approx(0.485714, abs=1e-6)
    got = one(spark, ST.binomial_survival(F.lit(8), F.lit(10), F.lit(0.5)), ST.binomial_survival(F.lit(0), F.lit(10), F.lit(0.5)))
    assert got[0] == pytest.approx(56 / 1024) and got[1] == 1


def test_bootstrap_depends_on_the_seed_alone(spark):
    df = spark.createDataFrame([(k,) for k in range(20)], "k int")
    draw = lambda d, seed: sorted(map(tuple, R.bootstrap_weights(d, "k", 3, seed).collect()))
    assert draw(df, 1) == draw(df.repartition(3), 1) != draw(df, 2)
    assert sum(w for _, _, w in draw(df, 1)) == 60


def test_permutation_keeps_labels(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(30)], "k int, l int")
    got = R.permuted(df, "k", "l", 2, 5)
    assert {(r.replicate, r.l): r.n for r in got.groupBy("replicate", "l").agg(F.count("*").alias("n")).collect()} == {(r, x): 10 for r in range(2) for x in range(3)}


def test_edit_delta_and_fuzzy_recall(spark):
    got = one(spark, D.edit_delta(F.lit("a\nb\nc"), F.lit("a\nx\nc")), D.edit_delta(F.lit("a  b\n\nc"), F.lit(" a b\nc")), D.changed_lines(F.lit("a  b\n\nc"), F.lit("a b\nc")))
    assert (got[0].added, got[0].deleted, got[1].added, got[1].deleted, got[2]) == (["x"], ["b"], [], [], 3)
    words = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    recall = lambda a, b: one(spark, D.fuzzy_recall(words(*a), words(*b)), D.text_recall(words(*a), words(*b)))
    assert recall(["abcdefghij"], ["abcdefghiX"]) == pytest.approx((0.9, 0.9))
    assert recall(["hello world", "hello world"], ["hello worlds"]) == pytest.approx((22 / 23 / 2, 22 / 23 / 2))
    assert recall(["zzzz", "abcd"], ["abcd"]) == (0.0, 0.5)  # the first takes the only line though it is unlike
    assert recall([], ["x"]) == (1.0, 1.0) and recall(["x"], []) == (0.0, 0.0)
    assert one(spark, X.multiset_recall(words("a", "a"), words("a")))[0] == 0.5


def test_patch_sections(spark):
    text = "*** Begin Patch\n*** Update File: a.py\n@@ x\n-old  one\n+new\n same\n+\n*** Delete File: b.py\r\n*** Update File: a.py\n+again\n*** End Patch"
    got = one(spark, D.patch_sections(F.lit(text)), D.patch_sections(F.lit(None).cast("string")))
    assert [(x.operation, x.path, x.added, x.deleted) for x in got[0]] == [("update", "a.py", ["new"], ["old one"]), ("delete", "b.py", [], []), ("update", "a.py", ["again"], [])] and got[1] == []


def test_write_actions(spark):
    edit = lambda **x: json.dumps(x)
    rows = [
        (1, "edit", edit(filePath="a", oldString="x\ny\nz", newString="x\nY\nz"), None),
        (2, "multi-edit", edit(file_path="a", edits=[{"old_text": "p", "new_text": "q"}, "none", {"newText": "r"}]), None),
        (3, "Write", edit(path="in", content="n"), "given"),
        (4, "write_file", edit(content="n"), None),
        (5, "Read", edit(file_path="a", content="n"), None),
        (6, "apply_patch", edit(patchText="*** Add File: b\n+x"), None),
        (7, "edit", "no json", None),
        (8, None, edit(file_path="a"), None),
        (9, "edit", edit(filePath="a", old_string=None, oldString="x", newString="x"), None),
    ]
    df = spark.createDataFrame(rows, "id int, tool string, payload string, file string")
    got = sorted(tuple(r) for r in E.write_actions(df, ["id"], "tool", "payload", "file").collect())
    assert got == [(1, 0, "a", "edit", ["Y"], ["y"]), (2, 0, "a", "edit", ["q"], ["p"]), (2, 2, "a", "write", ["r"], []), (3, 0, "given", "write", ["n"], []), (6, 0, "b", "add", ["x"], []), (9, 0, "a", "write", ["x"], [])]


def test_edges_of_actions_and_commits(spark):
    lines = lambda *x: list(x)
    actions = spark.createDataFrame([("s", 1, "/w/src/a.py", lines("new"), lines("gone")), ("s", 2, "a.py", lines("new"), lines()), ("s", 3, "/w/lib/g.py", lines(), lines("old")), ("t", 4, "/w/src/a.py", lines("new"), lines())], "s string, id int, path string, added array<string>, deleted array<string>")
    patch = "--- a/src/a.py\n+++ b/src/a.py\n@@\n+new\n--- a/tests/a.py\n+++ b/tests/a.py\n@@\n+else\n--- a/g.py\n+++ /dev/null\n@@\n-old\n"
    commits = spark.createDataFrame([("s", "c1", patch, '{"src/a.py": {"attribution": "mixed"}, "g.py": "agent"}'), ("s", "c2", None, None)], "s string, c string, patch string, share string")
    got = {r.id: r for r in E.matched_edges(actions, commits, ["s"], ["id"], "c", "patch", "share").collect()}
    assert set(got) == {1, 3}  # a bare name that two files have is no match
    assert (got[1].commit_path, got[1].added_recall, got[1].deleted_recall, got[1].survival_recall, got[1].changed_text_recall, got[1].confidence, got[1].share) == ("src/a.py", 1.0, 0.0, 1.0, 0.5, "exact", "mixed")
    assert (got[3].commit_path, got[3].survival_recall, got[3].confidence, got[3].share) == ("g.py", 1.0, "exact", "agent")


def test_prompt_of_action(spark):
    df = spark.createDataFrame([("c", 1, "a"), ("c", 2, "user"), ("c", 3, "t"), ("c", 5, "user"), ("c", 6, "t")], "c string, turn int, role string")
    assert {r.turn: r.user_turn for r in E.prompt_of_action(df, ["c"], "turn", F.col("role") == "user").collect()} == {1: None, 2: 2, 3: 2, 5: 5, 6: 5}


def test_tool_families(spark):
    names = ["TodoWrite", "multi_edit", "Bash", "mcp_contextMode_Execute", "Glob", "Agent", "Skill", "web-search", "x-Chrome-y", None]
    got = one(spark, *[E.tool_family(F.lit(n).cast("string")) for n in names])
    assert [x.family for x in got] == ["orchestration", "code_write", "shell", "shell", "local_research", "subagent", "planning", "external_or_browser", "external_or_browser", "generic"]


def test_credentials_are_redacted(spark):
    secrets = ["sk-proj-" + "a" * 24, "AIza" + "b" * 35, "AKIA" + "C" * 16, "ghs_" + "d" * 24, "github_pat_" + "e" * 44, "xoxp-" + "1" * 12]
    text, n = X.redacted(F.lit("one " + " and ".join(secrets) + " end. sk-short AKIA12"))
    got = one(spark, text, n, *X.redacted(F.lit("\0" + secrets[0])))
    assert got[1] == 6 and not any(s in got[0] for s in secrets) and got[0].endswith("end. sk-short AKIA12") and got[0].count("[REDACTED_GITHUB_TOKEN]") == 2
    assert got[2] == "\0" + secrets[0] and got[3] == 0


def test_snapshot_files(spark):
    docs = ['{"snapshot": {"files": {"a": "x"}}, "files": {"no": "y"}}', '{"trackedFileBackups": {"a": "ref", "b": {"text": "t"}}, "fileContents": {"c": {"content": 3, "text": "u"}, "d": {}}}', "[1]", None]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, j string")
    assert sorted(map(tuple, E.snapshot_files(df, ["id"], "j").collect())) == [(0, "a", "x"), (1, "b", "t"), (1, "c", "u")]


def test_nested_records_and_their_depth(spark):
    df = spark.createDataFrame([(1, '{"a": [{"b": {"c": {"d": {"e": {"f": {"g": {"id": 7}}}}}}}]}')], "id int, j string")
    assert [r.record for r in E.found_nested(df, ["id"], "j", ["id"]).collect()] == ['{"id":7}']
    with pytest.raises(Exception, match="levels"):
        E.found_nested(df, ["id"], "j", ["id"], 4).collect()


def test_tails_of_distributions(spark):
    tail = lambda f, *x: one(spark, f(*[F.lit(float(v)) for v in x]))[0]
    for x, n in ((0.5, 1), (3.84, 1), (7.0, 2), (30.0, 12), (5.0, 12), (600.0, 400)):
        if n % 2 == 0:  # a sum of Poisson terms
            want = sum(math.exp(j * math.log(x / 2) - x / 2 - math.lgamma(j + 1)) for j in range(n // 2))
        else:
            want = math.erfc(math.sqrt(x / 2))
        assert tail(ST.chi_square_tail, x, n) == pytest.approx(want, rel=1e-9)
    for f, b in ((0.3, 7), (4.0, 9), (250.0, 30), (1.0, 5000)):  # with two degrees above there is a closed form
        assert tail(ST.f_tail, f, 2, b) == pytest.approx((1 + 2 * f / b) ** (-b / 2), rel=1e-9)
    for t in (0.5, 2.0, 40.0):  # F(1, 1) is a squared Cauchy variable
        assert tail(ST.f_tail, t, 1, 1) == pytest.approx(1 - 2 / math.pi * math.atan(math.sqrt(t)), rel=1e-9)


def test_kmeans_by_hand(spark):
    import numpy as np

    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(c, 0.3, size=(40, 2)) for c in ((0, 0), (5, 5), (0, 5), (9, 0))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(999, None)], "k int, v array<double>")
    got, model = G.kmeans(df, "k", "v", 4, seed=1, starts=10)
    rows = {p.k: (p.cluster, p.distance) for p in got.collect()}
    labels, centers = np.array([rows[k][0] for k in range(len(x))]), np.array(model["centers"])
    assert len(rows) == 160 and [len(set(labels[k : k + 40])) for k in range(0, 160, 40)] == [1] * 4 and len(set(labels)) == 4
    d = np.linalg.norm(x[:, None] - centers[None], axis=2)
    assert (d.argmin(axis=1) == labels).all() and model["inertia"] == pytest.approx((d.min(axis=1) ** 2).sum()) and [rows[k][1] for k in range(160)] == pytest.approx(d.min(axis=1))
    assert all(np.allclose(centers[c], x[labels == c].mean(axis=0), atol=1e-4) for c in range(4))
    alike, model = G.kmeans(spark.createDataFrame([(k, [1.0]) for k in range(5)], "k int, v array<double>"), "k", "v", 3, starts=2)
    assert model["inertia"] == 0 and {p.cluster for p in alike.collect()} == {0}  # empty clusters do no harm
    assert G.kmeans(df.where("k = 999"), "k", "v", 2)[0].count() == 0


def test_masked_kmeans(spark):
    rows = [(0, [0.0, None]), (1, [None, 0.1]), (2, [0.1, 0.0]), (3, [5.0, None]), (4, [None, 5.0]), (5, [5.1, 5.0])]
    got, model = G.kmeans(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v", 2, starts=20, masked=True)
    label = {p.k: p.cluster for p in got.collect()}
    assert label[0] == label[1] == label[2] != label[3] == label[4] == label[5] and sorted(map(tuple, model["centers"])) == [pytest.approx((0.05, 0.05)), pytest.approx((5.05, 5.0))]


def test_tiles_do_not_matter(spark, monkeypatch):
    df = spark.createDataFrame([(k, [float(k % 7), float(k % 3)], k % 4) for k in range(60)], "k int, v array<double>, l int")
    whole = sorted(map(tuple, G.silhouette(df, "k", "v", "l").collect()))
    monkeypatch.setattr(tiles, "TILE", 9)
    assert sorted(map(tuple, G.silhouette(df, "k", "v", "l").collect())) == [(k, pytest.approx(v)) for k, v in whole]
    assert sorted(r.k for r in G.silhouette(df, "k", "v", "l", df.where("k < 5")).collect()) == [0, 1, 2, 3, 4]


def test_prediction_strength_of_clear_clusters(spark):
    df = spark.createDataFrame([(k, [10.0 * (k % 3) + (k % 5) / 9]) for k in range(90)], "k int, v array<double>")
    half = lambda h: df.where(F.floor(F.col("k") / 3) % 2 == h)
    assert G.prediction_strength(half(0), half(1), "k", "v", 3, starts=5).first().strength == 1.0


def test_numbers_in_hash_order(spark):
    df = spark.createDataFrame([(k, k % 2) for k in range(500)], "k int, g int")
    got = R.numbered(df, ["k"], 3, ["g"]).collect()
    import hashlib

    for g in (0, 1):
        own = sorted((r.place, r.k) for r in got if r.g == g)
        want = sorted((k for k in range(500) if k % 2 == g), key=lambda k: hashlib.sha256(f"3:{g}:{k}".encode()).hexdigest())
        assert own == list(enumerate(want, 1))
    parts = R.random_parts(df, ["k"], 1, 2, 0.3).collect()
    assert {(x, p): sum(r.replicate == x and r.part == p for r in parts) for x in (0, 1) for p in ("first", "rest")} == {(0, "first"): 150, (0, "rest"): 350, (1, "first"): 150, (1, "rest"): 350}


def test_step_up_by_hand(spark):
    import random as rnd

    r = rnd.Random(2)
    p = [round(r.random() ** 2, 2) for _ in range(300)] + [1.0] * 40 + [0.0] * 5
    df = spark.createDataFrame([(k, x) for k, x in enumerate(p)] + [(-1, None)], "k int, p double")
    order, best, want = sorted(range(len(p)), key=lambda k: p[k]), 1.0, {-1: None}
    for rank in range(len(p), 0, -1):
        k = order[rank - 1]
        best = min(best, p[k] * len(p) / rank)
        want[k] = best
    got = {r.k: r.q for r in Q.step_up(df, "p").collect()}
    assert got.keys() == want.keys() and all(got[k] == (pytest.approx(v) if v is not None else None) for k, v in want.items())


def test_crossed_refuses_a_large_side(spark):
    assert J.crossed(spark.range(3), spark.range(4).withColumnRenamed("id", "b"), 4).count() == 12
    with pytest.raises(ValueError, match="more than"):
        J.crossed(spark.range(3), spark.range(5).withColumnRenamed("id", "b"), 4)


def test_retrieval_leaves_out_who_has_no_own_profile(spark):
    from loomspark.operators import statistics as S2

    a = spark.createDataFrame([(1, "x", 1.0), (2, "x", 5.0), (3, "x", 9.0), (4, "y", 1.0)], "u int, axis string, v double")
    b = spark.createDataFrame([(1, "x", 1.0), (2, "x", 9.0), (3, "x", 4.0)], "u int, axis string, v double")
    got = {r.u: (r["rank"], round(r.nearest, 3)) for r in S2.retrieval(a, b, "u", "axis", "v", F.col("u") > 0).collect()}
    assert got == {1: (1, 0.75), 2: (3, 0.25), 3: (2, 0.0)}  # a tie goes to the smaller user


def test_patch_of_a_deleted_file(spark):
    df = spark.createDataFrame([(1, "--- a/x.py\n+++ /dev/null\n@@\n-gone  now\n-\n")], "id int, p string")
    got = D.unified_patch(df, ["id"], "p").first()
    assert (got.path, got.added, got.deleted) == ("x.py", [], ["gone now"])


def test_tolerant_jsonl_modes(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n[1]\n\n{"a": 2}\n')
    where = f"file://{tmp_path}/x.jsonl"
    assert sorted(r.a for r in T.read_jsonl(spark, where, "a int").collect()) == [1, 2]
    assert sum(r.bad_line is not None for r in T.read_jsonl(spark, where, "a int", "keep").collect()) == 2
    with pytest.raises(Exception, match="bad line"):
        T.read_jsonl(spark, where, "a int", "fail").collect()


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="b, c"):
        T.require_columns(spark.range(1).select(F.lit(1).alias("a")), ["a", "b", "c"])


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,), (3.0,)], "v double")
    assert [r.n for r in A.histogram(df, "v", [0, 1, 2]).collect()] == [1, 2]


def test_mode_tie_is_the_smallest(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", None)], "g string, v string")
    assert A.mode(df, ["g"], "v").first().mode == "a"


def test_cosine_of_zero_vector(spark):
    z, a = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    got = one(spark, V.cosine(z, a), V.cosine(a, a), V.masked_rms(F.array(F.lit(None).cast("double"), F.lit(1.0)), a))
    assert got[0] is None and got[1] == pytest.approx(1) and got[2] == pytest.approx(3.0)
    assert math.isclose(one(spark, V.euclidean(z, a))[0], 5)


def test_row_order_does_not_matter(spark):
    rows = [("u", f"s{k % 3}", k, k % 2, (k % 3) - 1) for k in range(30)]
    schema = "user_id string, session string, turn_number int, axis int, score int"
    a = P.vectors(spark.createDataFrame(rows, schema), ["user_id", "session"])
    b = P.vectors(spark.createDataFrame(rows[::-1], schema).repartition(5), ["user_id", "session"])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_session_windows_of_a_stream(spark, tmp_path):
    from loomspark.streaming.counts import sessions

    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (1, "2024-01-01 03:00:00")], "u int, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(f"file://{tmp_path}/in")
    stream = sessions(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"), "u", "at", "10 minutes", "1 minute")
    q = stream.writeStream.format("memory").queryName("s").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.awaitTermination()
    assert sorted(r.n_events for r in spark.table("s").collect()) == [1, 2]


def test_matching_of_centers_is_exact():
    import numpy as np

    from loomspark.operators import models as M

    r = np.random.default_rng(1)
    for n in (3, 8):
        x = r.normal(size=(n, 4))
        turn = r.permutation(n)
        match, total = M.matched_centers(x, x[turn])
        assert [turn[j] for j in match] == list(range(n)) and total == pytest.approx(0)


def test_leaf_order_keeps_neighbours_together():
    import numpy as np

    from loomspark.operators import models as M

    assert M.leaf_order(np.array([[0.0], [10.0], [0.1], [10.2]])) in ([0, 2, 1, 3], [1, 3, 0, 2])
    assert M.leaf_order(np.zeros((0, 1))) == []


def test_leaf_order_merges_the_nearest_pair_first():
    """Against a scan over all pairs of groups at every merge, ties included; 2 000 rows in seconds."""
    import time

    import numpy as np

    from loomspark.operators import models as M

    def scanned(x):
        groups, d = [[k] for k in range(len(x))], np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        while len(groups) > 1:
            _, i, j = min((d[np.ix_(a, b)].sum() / len(a) / len(b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
            groups[i] = groups[i] + groups.pop(j)
        return groups[0]

    r = np.random.default_rng(1)
    for case in range(40):
        x = r.integers(0, 4, size=(r.integers(2, 25), 1)).astype(float) if case % 2 else r.random((r.integers(2, 25), 3))
        assert M.leaf_order(x) == scanned(x), case
    began = time.perf_counter()
    assert sorted(M.leaf_order(r.random((2000, 8)))) == list(range(2000)) and time.perf_counter() - began < 10


def test_covariance(spark):
    import numpy as np

    from loomspark.operators import models as M

    x = np.random.default_rng(2).random((50, 4))
    mean, cov = M.covariance(spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "v array<double>").repartition(7), "v")
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, ddof=0))


def test_multiset_recall_merges(spark):
    import random
    from collections import Counter

    r = random.Random(6)
    rows = [(k, [r.choice(["a", "b", "é", "", None, "ab"]) for _ in range(r.randint(0, 9))], [r.choice(["a", "b", "é", "", None]) for _ in range(r.randint(0, 9))]) for k in range(200)]
    got = {x.k: x.r for x in spark.createDataFrame(rows, "k int, a array<string>, b array<string>").select("k", X.multiset_recall(F.col("a"), F.col("b")).alias("r")).collect()}
    for k, a, b in rows:
        have = Counter(y for y in b if y is not None)
        assert got[k] == (pytest.approx(sum(min(n, have[y]) for y, n in Counter(a).items() if y is not None) / len(a)) if a else 1.0)


def test_principal_axes(spark):
    from loomspark.operators import models as M

    df = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)], "k int, v array<double>")
    scores, shares = M.principal_axes(df, "k", "v")
    assert shares[0] == pytest.approx(1) and [round(r.scores[0], 4) for r in scores.orderBy("k").collect()][2] == 0


def test_cache_decides_what_is_asked(spark):
    from loomspark.operators import judging as L

    asks = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "id int, prompt_hash string")
    cache = spark.createDataFrame([(1, "p", "old", False, 1), (1, "p", "new", False, 2), (1, "p", "bad", True, 3), (2, "other", "x", False, 1), (3, "r", "bad", True, 1)], "id int, prompt_hash string, answer string, failed boolean, position int")
    seen = []

    def answer(df):
        seen.extend(r.id for r in df.collect())
        return df.withColumn("answer", F.lit("asked"))

    assert {r.id: (r.answer, r.cached) for r in L.judged(asks, cache, ["id"], answer).collect()} == {1: ("new", True), 2: ("asked", False), 3: ("asked", False)}
    assert sorted(seen) == [2, 3]


def test_two_stage_scores(spark):
    from loomspark.operators import judging as L

    turns = spark.createDataFrame([(k,) for k in range(1, 6)], "id int")
    screened = {1: (["a", "zz", "b"], False), 2: (["a", "b", "c", "d", "e"], False), 3: ([], True), 4: (["c"], None), 5: (["e", "e"], False)}
    table = spark.createDataFrame([(k, *v) for k, v in screened.items()], "id int, triggered array<string>, failed boolean")
    seen = []

    def direct(asked):
        seen.extend((r.id, r.axis) for r in asked.collect())
        return asked.withColumns({"direction": F.when(F.col("axis") == "b", -1.0).when(F.col("axis") == "c", 3.0).otherwise(1.0), "evidence": F.lit("x"), "failed": (F.col("id") == 1) & (F.col("axis") == "b")})

    got = {(r.id, r.axis): (r.score, r.evidence, r.failed) for r in L.two_stage_scores(turns, ["id"], list("abcde"), lambda df: df.join(table, "id"), direct).collect()}
    assert set(seen) == {(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (2, "d"), (4, "c"), (5, "e")} and len(got) == 25
    assert got[1, "a"] == (1, "x", True) and got[1, "b"] == (0, "", True) and got[2, "b"] == (-1, "x", False) and got[2, "c"] == (0, "", False) and got[2, "e"] == (0, "", False)
    assert got[3, "a"] == (0, "", True) and got[4, "c"] == (0, "", False) and got[5, "e"] == (1, "x", False)


def test_rendered_turn(spark):
    from loomspark.operators import judging as L

    rows = [(1, 1, "called", "Edit", "f"), (1, 2, "returned", None, "a\nb"), (1, 3, "said", None, "  "), (1, 4, "said", None, "done "), (1, 5, "called", "ExitPlanMode", None), (2, 1, "returned", None, None)]
    got = {r.id: r for r in L.rendered_turns(spark.createDataFrame(rows, "id int, i int, kind string, name string, body string"), ["id"], "i").collect()}
    assert got[1].text == "TOOL Edit: f\n  -> a b\nASSISTANT: done\nTOOL ExitPlanMode: " and tuple(got[1])[2:] == (2, 1, 1, True)
    assert tuple(got[2])[1:] == ("  -> ", 0, 0, 0, False)


def test_settings_lines(spark):
    text = "# c\nA = \"x y\"\nB='q'\nA=second\n=no\nplain\nC=\nD=a=b"
    got = {r.name: r.value for r in T.env_lines(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), ["id"], "t").collect()}
    assert got == {"A": "x y", "B": "q", "C": "", "D": "a=b"}


def test_profiles_with_evidence(spark):
    rows = [("u", 1, "s1", 1, "high", "a"), ("u", 1, "s2", 2, "high", "  b  c"), ("u", 1, "s2", 3, "low", ""), ("u", 2, "s1", 4, "high", "d"), ("u", 2, "s1", 5, "low", "e"), ("u", 3, "s1", 6, "na", "f")]
    df = spark.createDataFrame(rows, "user_id string, axis int, session string, turn_number int, label string, said string")
    got = {r.axis: tuple(r)[2:] for r in P.evidence_profiles(df, 0.6, 2).collect()}
    assert got == {1: ("high", 0.6, True, 2, 1, 2, 1), 2: (None, 0.0, False, 1, 1, 0, 0), 3: (None, 0.0, False, 0, 0, 0, 0)}
    assert [(r.axis, r.place, r.message) for r in P.ordered_evidence(df, F.col("said")).orderBy("axis", "place").collect()] == [(1, 1, "a"), (1, 2, "b c"), (2, 1, "d"), (2, 2, "e")]


def test_trust_by_hand(spark):
    train = spark.createDataFrame([("u", "a", 1), ("u", "a", 1), ("v", "a", -1), ("w", "a", 1)], "user string, axis string, score int")
    test = spark.createDataFrame([("u", "a", 1), ("v", "a", 1), ("x", "a", 1), ("v", "b", -1)], "user string, axis string, score int")
    seen, profiles = S.future_observations(train, test, "user", "axis", "score", 10.0)
    rows = {(r.user, r.axis): r for r in seen.collect()}
    assert set(rows) == {("u", "a"), ("v", "a"), ("v", "b")}  # only users of both times, who alone make the population
    assert rows["u", "a"].population_p == pytest.approx(0.5 / 2) and rows["u", "a"].user_p == pytest.approx((2.5 + 2) / 12) and rows["u", "a"].minority
    assert rows["v", "a"].population_p == pytest.approx(2.5 / 3) and rows["v", "b"].population_p == 0.5 and not rows["v", "a"].minority
    gates = {r.method: r for r in S.trust_gates(seen, "user", [2], [(1, 0.9)], [3]).collect()}
    assert (gates["always"].personalized, gates["support>=2"].personalized, gates["support>=1,consistency>=0.9"].personalized, gates["continuous 3"].personalized) == (3, 1, 2, 2)
    loss = -(math.log(4.5 / 12) + math.log(2.5 / 3) + math.log(0.5)) / 3
    assert gates["support>=2"].log_loss == pytest.approx(loss) and gates["support>=2"].improvement == pytest.approx(-(math.log(0.25) + math.log(2.5 / 3) + math.log(0.5)) / 3 - loss)
    soft = 2 / 5 * (4.5 / 12) + 3 / 5 * 0.25
    base = -math.log(0.25)
    assert gates["continuous 3"].mean_user_gain == pytest.approx(((base + math.log(soft)) + (math.log((1 / 4) * (10 * 2.5 / 3) / 11 + (3 / 4) * 2.5 / 3) - math.log(2.5 / 3)) / 2) / 2)
    assert {(r.user, r.axis) for r in profiles.collect()} == {(u, a) for u in "uv" for a in "ab"}
