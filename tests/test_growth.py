"""What must not grow with pairs, and what must stay exact at larger sizes."""

from pyspark.sql import functions as F

from loomspark.operators import joins as J
from loomspark.operators import resampling as R
from loomspark.operators import sequences as Q


def test_shares_are_decimals(spark):
    """0.7 of 90 rows are 63; the double next to 0.7 is smaller, and its product with 90 is below 63."""
    df = spark.range(90).withColumnRenamed("id", "k")
    assert R.random_parts(df, ["k"], 1, 1, 0.7).where("part = 'first'").count() == 63
    split = Q.chronological_split(df.withColumn("g", F.lit(1)), ["g"], ["k"], 0.7)
    assert split.where("part = 'past'").count() == 63


def test_paths_meet_base_names_only(spark):
    """Paths of a session meet the commits that have a file of their name; no join is on the session alone."""
    left = spark.createDataFrame([("s", 1, "/w/a/x.py"), ("s", 2, "y.py"), ("s", 3, "none.py"), ("t", 4, "/w/a/x.py"), ("s", 5, None)], "s string, id int, path string")
    right = spark.createDataFrame([("s", "c1", "a/x.py"), ("s", "c1", "x.py"), ("s", "c2", "b/x.py"), ("s", "c3", "a/y.py"), ("s", "c3", "b/y.py"), ("s", "c4", "q/y.py"), ("s", "c4", "q/y.py")], "s string, c string, f string")
    got = J.suffix_meetings(left, right, ["s"], "path", "f", ["id"], ["c"])
    assert sorted(tuple(r) for r in got.collect()) == [("s", 1, "c1", "a/x.py"), ("s", 1, "c2", "b/x.py"), ("s", 2, "c4", "q/y.py")]
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and all("__b" in x for x in joins)


def test_links_that_close_a_circle_are_dropped_by_the_task(spark):
    """Of all 19 900 links of 200 nodes a task hands on 199, and components are the same."""
    import pyarrow as pa

    from loomspark.llm import components as K

    pairs = [(j, i) for i in range(200) for j in range(i + 1, 200)]
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs]), pa.array([y for _, y in pairs])], names=["a", "b"])
    assert sum(b.num_rows for b in K.forest(iter([batch, batch.slice(0, 0), batch]))) == 199
    links = spark.createDataFrame([*pairs, (300, 301), (301, 302), (303, 302), (7, 7)], "a long, b long").repartition(3)
    got = {r.node: r.root for r in K.components(links).collect()}
    assert got == {**{k: 0 for k in range(200)}, **{k: 300 for k in (300, 301, 302, 303)}}


def test_tiles_meet_without_a_shuffle_of_copies(spark):
    """What is exchanged are sums of a part, never tiles or runs of distances."""
    import random

    from loomspark.operators import geometry as G
    from loomspark.operators import tiles

    r = random.Random(4)
    df = spark.createDataFrame([(k, [r.gauss(0, 1) for _ in range(3)], k % 3) for k in range(300)], "k long, v array<double>, l int")
    for got in (G.silhouette(df, "k", "v", "l"), tiles.discriminability(df, "k", "v", "l")):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert "collect_list" not in plan


def test_a_rank_by_squares_is_the_rank_by_rounded_distances():
    """Equal rows, ties to nine digits and rows far from zero count as in a plain comparison."""
    import numpy as np

    from loomspark.operators import tiles

    r = np.random.default_rng(1)
    for shift in (0.0, 1000.0):
        b = np.round(r.normal(size=(300, 4)), 1) + shift
        a = np.vstack([b[:40], np.round(r.normal(size=(40, 4)), 1) + shift])
        plain = np.round(np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2) / 4), 9)
        own = plain[np.arange(80), np.arange(80) + 7]
        place, mine = np.arange(80) + 7, (np.arange(80), np.arange(80) + 7)
        n, some, best = tiles._counted(a, b, own, place, mine, tiles.masked_rms, 9)
        plain[mine] = np.inf
        assert n.tolist() == ((plain < own[:, None]) | ((plain == own[:, None]) & (np.arange(300) < place[:, None]))).sum(axis=1).tolist()
        assert best.tolist() == plain.argmin(axis=1).tolist() and some.tolist() == plain.min(axis=1).tolist()


def test_binomial_tail_of_many_draws(spark):
    """The sum over all draws takes n * n steps; at a million draws it would not end."""
    from loomspark.functions import stats as ST

    df = spark.createDataFrame([(3, 20, 0.1), (0, 5, 0.5), (5, 5, 0.5), (500_000, 1_000_000, 0.5), (6, 5, 0.5)], "k long, n long, p double")
    got = [x.t for x in df.select(ST.binomial_tail("k", "n", "p").alias("t")).collect()]
    assert [round(x, 6) for x in got] == [0.323073, 1.0, 0.03125, 0.500399, 0.0]


def test_overlaps_are_counted_without_pairs(spark):
    """Against all pairs by hand, with touching ends and points; the plan joins no interval with another."""
    import random

    r = random.Random(3)
    rows = [(k, k % 3, lo, lo + r.choice([0, 1, 5, 40]), r.sample(["a", "b", "c"], r.randint(1, 2))) for k in range(120) for lo in [r.randint(0, 60)]]
    df = spark.createDataFrame(rows, "k int, g int, lo int, hi int, kinds array<string>")
    got = {x.k: (x.concurrent, x.colliding) for x in J.overlap_counts(df, "g", ["k"], ("lo", "hi"), "kinds").collect()}
    meets = lambda a, b: a[0] != b[0] and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]
    assert got == {a[0]: (sum(meets(a, b) for b in rows), sum(meets(a, b) and bool(set(a[4]) & set(b[4])) for b in rows)) for a in rows}


def _odd_spans(seed, n):
    """Keys with several intervals, points, equal starts, touching ends, long ones, reversed ones and nulls."""
    import datetime as dt
    import random

    r = random.Random(seed)
    at = lambda m: dt.datetime(1969, 12, 31) + dt.timedelta(minutes=m)
    rows = [(r.choice([0, 1, None]), r.randrange(n // 2), lo, lo + r.choice([0, 0, 5, 60, 90, 4000, -1])) for _ in range(n) for lo in [r.randrange(0, 3000, 5)]]
    return [(g, k, at(lo), at(hi)) for g, k, lo, hi in rows] + [(0, None, at(9), at(99)), (0, 1, None, at(9)), (0, 1, at(9), None)]


def _met(a, b):
    whole = None not in (a[0], a[2], a[3], b[0], b[2], b[3]) and a[2] <= a[3] and b[2] <= b[3]
    return whole and a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3]


def test_overlaps_are_whole_in_any_tiles(spark, monkeypatch):
    """Of one table and of two, against all pairs by hand, where a bucket has many tiles and where it has one."""
    from collections import Counter

    one, two = _odd_spans(1, 90), _odd_spans(2, 60)
    schema = "g int, {0}k int, {0}lo timestamp_ntz, {0}hi timestamp_ntz".format
    own = Counter((a[1], a[2], b[1], b[2]) for a in one for b in one if _met(a, b) and None not in (a[1], b[1]) and a[1] < b[1])
    both = Counter((a[1], a[2], b[1], b[2]) for a in one for b in two if _met(a, b))
    for tile in (3, 1024):
        monkeypatch.setattr(J, "TILE", tile)
        got = J.self_overlaps(spark.createDataFrame(one, schema("")), "g", "k", ("lo", "hi"), 3600).select("k_a", "lo_a", "k_b", "lo_b")
        assert Counter(map(tuple, got.collect())) == own
        got = J.overlaps(spark.createDataFrame(one, schema("a")), spark.createDataFrame(two, schema("b")), "g", ("alo", "ahi"), ("blo", "bhi"), 3600).select("ak", "alo", "bk", "blo")
        assert Counter(map(tuple, got.collect())) == both


def test_intervals_of_a_group_meet_by_tiles(spark):
    """No join lets all intervals of a group and day meet: rows seek tiles by the tiles' first and last starts, and go to them."""
    from loomspark.plans import catalogue

    got = catalogue.QUERIES["j13_interval_overlap"](spark, "/root/testdata/sf0.001")
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and all("__tile" in x or ("__first" in x and "__last" in x) for x in joins)


def test_costly_rows_of_a_small_file_are_many_tasks(spark, tmp_path):
    """A few hundred kilobytes are one task's by size; each row's likenesses take a quarter of a millisecond."""
    from loomspark.plans import catalogue

    spark.range(400).selectExpr("id as p_partkey", "'n' as p_name", "'b' as p_brand", "'t' as p_type").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for name in ("e910_fuzzy_edges", "e8_actions_from_sql"):
        assert catalogue.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() > 1


def test_different_texts_leave_nothing_however_many_shingles(spark, monkeypatch):
    """Shingles are counted exactly: no filter of a fixed size fills up, so that texts without a like are handed on."""
    import random

    from loomspark.llm import common as C
    from loomspark.llm import simhash
    from loomspark.llm import windows as V

    r, written, own = random.Random(8), {}, C.materialise
    monkeypatch.setattr(V, "FEWEST", 10)
    monkeypatch.setattr(V, "MOST", 10)
    monkeypatch.setattr(C, "materialise", lambda df, label: (out := own(df, label), written.update({label: out.count()}))[0])
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(120)) for _ in range(150)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, texts[3] + " more"])], "doc_id long, text string")
    assert simhash.keep_one_of_near(df).count() == 150
    assert written["posts"] <= 2 * 25 and "filed" not in written and written.get("survivors", 0) <= 2


def test_rarest_shingles_join_all_that_are_alike(spark, monkeypatch):
    """Short texts, whose even shingles are too few, long ones, copies and empty ones, against all pairs by hand."""
    import hashlib
    import random

    from loomspark.llm import components as K
    from loomspark.llm import simhash

    r = random.Random(5)
    texts = ["", " "]
    for k in range(60):
        w = [f"w{r.randrange(40)}" for _ in range(r.choice([3, 5, 6, 9, 14, 25, 80]))]
        texts += [" ".join(w), " ".join(w), " ".join([*w, "x"]), " ".join([f"y{k}", *w])][: r.randint(1, 4)]
    texts += ["common words that all of these have " + " ".join(f"u{r.randrange(10**6)}" for _ in range(30)) for _ in range(40)]
    for gathered, dense in ((400_000, 16), (300, 1)):
        monkeypatch.setattr(simhash, "GATHERED", gathered)
        monkeypatch.setattr(simhash, "DENSE", dense)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        different = sorted(set(texts))
        nodes = spark.createDataFrame([(bytearray(hashlib.sha256(t.encode()).digest()), k) for k, t in enumerate(different)], "hash binary, node long")
        links = simhash._rare_candidates(docs, nodes, 5, 0.8)
        root = {x.node: x.root for x in K.components(links.selectExpr("x as a", "y as b")).collect()}
        sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in different]
        alike = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
        assert len(alike) > 25 and all(root.get(i, -1) == root.get(j, -2) for i, j in alike)
        assert len(root) < len(different) - 30  # texts that only share a common passage are no candidates


def test_keys_that_come_once_fill_no_sketch(spark):
    """30 000 different keys in a sketch of 8 192 bits: only those that two documents have are in it."""
    import numpy as np

    from loomspark.llm import common as C
    from loomspark.llm import windows as V

    def keys(piece):
        found = [C.mixed(np.arange(int(t) * 100, int(t) * 100 + 100, dtype=np.uint64) + np.uint64(1)) for t in C.raw(piece)]
        return np.sort(np.concatenate([*found, *[C.mixed(np.arange(50, 60, dtype=np.uint64))] * (len(found) > 0)]))

    docs = spark.range(300).selectExpr("cast(id as string) as text").repartition(6)
    cells, _ = V.repeated_cells(docs, keys, 12)
    every = C.mixed(np.arange(30_000, dtype=np.uint64) + np.uint64(1))
    found = V.Sketch.repeated(cells, 12, every)
    assert found[49:59].all() and found.sum() < 30


def test_a_small_share_of_a_shard_is_read_back_whole():
    import numpy as np

    from loomspark.llm import suffixes

    r = np.random.default_rng(2)
    for n, m, d in ((1, 1, 1), (3, 9, 4), (200, 700, 50)):
        length, stretch, row, pos = r.integers(50, 90, n), r.integers(0, n, m), r.integers(0, d, m), r.integers(0, 2**31, m)
        docs, keys = r.integers(-(2**62), 2**62, d), r.integers(-(2**31), 2**31, d)
        got = suffixes._unpacked_numbers(suffixes._packed_numbers(length, stretch, row, pos, docs, keys), n)
        assert all((x == y).all() for x, y in zip(got, (length, stretch, pos, docs[row], keys[row]), strict=True))


def test_distances_are_taken_once_for_all_labels(spark):
    """The same figures as for each column of labels alone, from one product of the tiles."""
    import random

    from loomspark.operators import geometry as G

    r = random.Random(6)
    df = spark.createDataFrame([(k, [r.gauss(k % 3, 1) for _ in range(4)], k % 3, k % 5) for k in range(90)], "k long, v array<double>, l int, m int")
    got = G.silhouettes(df, "k", "v", ["l", "m"])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join Cross") == 1
    both = {(x.k, x.by): x.silhouette for x in got.collect()}
    for by, label in enumerate(("l", "m")):
        for x in G.silhouette(df, "k", "v", label).collect():
            assert abs(both.pop((x.k, by)) - x.silhouette) < 1e-12
    assert not both


def test_a_crowded_day_is_few_tiles(spark, monkeypatch):
    """An interval is copied to each tile that it meets; 12 000 of a group's day are no more than two tiles a task."""
    tiles, own = [], J.stored
    monkeypatch.setattr(J, "stored", lambda df: (out := own(df), tiles.append(out.count() if "__rows" in out.columns else 0))[0])
    df = spark.range(12_000).selectExpr("1 as g", "id as k", "timestamp_ntz '2024-01-05 00:00:00' + make_dt_interval(0, 0, 0, id * 5) as lo").withColumn("hi", F.col("lo"))
    got = J.self_overlaps(df.unionAll(df.where("k < 9").withColumn("k", F.col("k") - 100)), "g", "k", ("lo", "hi"), 86400)
    assert got.count() == 9 and 0 < sum(tiles) <= 8
