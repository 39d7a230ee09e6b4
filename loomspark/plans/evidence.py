"""Queries over tool calls, nested records, edges and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as ST
from ..operators import evidence as E
from ..sources.tables import spread
from .catalogue import query


_TOOLS = (
    ("Multi-Edit", "code_write", "full"), ("read_file", "local_research", "compact"), ("Grep!", "local_research", "compact"), ("Bash ", "shell", "full"), ("mcp__context-mode__execute", "shell", "full"),
    ("TodoWrite", "orchestration", "marker"), ("ExitPlanMode", "planning", "full"), ("Task", "subagent", "full"), ("WebFetch", "external_or_browser", "compact"), ("unheard of", "generic", "compact"),
)


@query(f"SELECT n_nationkey, family, shown FROM nation JOIN (VALUES {', '.join(f'({k}, {chr(39)}{f}{chr(39)}, {chr(39)}{s}{chr(39)})' for k, (_, f, s) in enumerate(_TOOLS))}) v(k, family, shown) ON k = n_nationkey % 10")
def x7_tool_families(t):
    names = F.array(*[F.lit(n) for n, _, _ in _TOOLS])
    return t.nation.select("n_nationkey", E.tool_family(F.get(names, (F.col("n_nationkey") % 10).cast("int"))).alias("f")).select("n_nationkey", "f.family", "f.shown")


_ACTIONS = """SELECT p_partkey, CAST(0 AS INTEGER) AS action, 'f' || CAST(p_partkey AS VARCHAR) AS path, CASE p_partkey % 5 WHEN 0 THEN 'edit' WHEN 1 THEN 'edit' WHEN 2 THEN 'write' ELSE 'update' END AS operation,
CASE WHEN p_partkey % 5 = 2 THEN p_name || '|' || p_brand ELSE p_name END AS added, CASE WHEN p_partkey % 5 IN (0, 1) THEN 'a' WHEN p_partkey % 5 = 2 THEN '' ELSE p_brand END AS deleted FROM part WHERE p_partkey % 5 < 4
UNION ALL SELECT p_partkey, 2, 'f' || CAST(p_partkey AS VARCHAR), 'write', 'c', '' FROM part WHERE p_partkey % 5 = 1
UNION ALL SELECT p_partkey, 1, 'g.py', 'add', p_type, '' FROM part WHERE p_partkey % 5 = 3"""


def _calls(t):
    """One edit, a list of edits with an entry that is none, a new file, a patch of two files, and a tool that only reads."""
    k, path = F.col("p_partkey") % 5, F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    one = F.to_json(F.struct(path.alias("filePath"), F.lit("a\nkept").alias("oldText"), F.concat("p_name", F.lit("\n kept ")).alias("newText")))
    many = F.concat(F.lit('{"path":"'), path, F.lit('","edits":[{"oldString":"a","newString":"'), "p_name", F.lit('"},7,{"new_text":"c"}]}'))
    new = F.to_json(F.struct(path.alias("file_path"), F.concat("p_name", F.lit("\n\n"), "p_brand").alias("content")))
    patch = F.to_json(F.struct(F.concat(F.lit("*** Begin Patch\n*** Update File: "), path, F.lit("\n@@\n-"), "p_brand", F.lit("\n+"), "p_name", F.lit("\n kept\n*** Add File: g.py\n+"), "p_type", F.lit("\n*** End Patch")).alias("patchText")))
    tool = F.get(F.array(*map(F.lit, ("edit", "MultiEdit", "Write", "apply-patch", "Read"))), k.cast("int"))
    part = spread(t.part.select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey")
    rows = part.select("p_partkey", tool.alias("tool"), F.when(k == 0, one).when(k == 1, many).when(k == 2, new).when(k == 3, patch).otherwise(one).alias("payload"))
    return rows


@query(_ACTIONS)
def e8_write_actions(t):
    got = E.write_actions(_calls(t), ["p_partkey"], "tool", "payload")
    return got.select("p_partkey", "action", "path", "operation", F.array_join("added", "|").alias("added"), F.array_join("deleted", "|").alias("deleted"))


@query(_ACTIONS)
def e8_actions_from_sql(t):
    """The same from SQL text, by a table function."""
    from ..functions.tables import register

    register(t.spark)
    return t.spark.sql("SELECT c.p_partkey, a.action, a.path, a.operation, array_join(a.added, '|') AS added, array_join(a.deleted, '|') AS deleted FROM {calls} c, LATERAL write_actions(c.tool, c.payload, CAST(NULL AS STRING)) a", calls=_calls(t))


@query("""SELECT p_size AS session, p_partkey, 'c' || CAST(p_partkey AS VARCHAR) AS com, 'src/f' || CAST(p_partkey AS VARCHAR) || '.py' AS commit_path, round(s / 4.0, 4) AS added_recall,
1.0::DOUBLE AS deleted_recall, round((s / 4.0 + 1) / 2, 4) AS changed_text_recall, round(s / 4.0, 4) AS survival_recall, CASE WHEN s = 4 THEN 'exact' WHEN s >= 2.8 THEN 'strong' WHEN s >= 1.2 THEN 'moderate' ELSE 'weak' END AS confidence,
CASE p_partkey % 3 WHEN 0 THEN 'mixed' WHEN 1 THEN 'agent' ELSE '' END AS share
FROM (SELECT *, least(4, p_partkey % 5 + CASE WHEN p_partkey % 5 < 4 AND p_partkey % 3 = 0 THEN 0.96875 ELSE 0 END) AS s FROM part)""")
def e10_turn_commit_map(t):
    """Edits of files matched to the commits of their session, by path and by what of their text is there."""
    key = F.col("p_partkey").cast("string")
    line = lambda n: F.md5(F.concat(key, F.lit(f":{n}")))
    payload = F.to_json(F.struct(F.concat(F.lit("/home/w/src/f"), key, F.lit(".py")).alias("file_path"), F.lit("old one").alias("old_string"), F.concat_ws("\n", *map(line, (3, 0, 1, 2))).alias("new_string")))
    calls = t.part.select(F.col("p_size").alias("session"), "p_partkey", F.lit("Edit").alias("tool"), payload.alias("payload"))
    there = [F.when(F.col("p_partkey") % 5 > n, F.concat(F.lit("+"), line(n))) for n in range(4)]
    near = F.when((F.col("p_partkey") % 5 < 4) & (F.col("p_partkey") % 3 == 0), F.concat(F.lit("+"), F.left(line(3), F.lit(31)), F.lit("X")))
    file = F.concat(F.lit("src/f"), key, F.lit(".py"))
    patch = F.concat_ws("\n", F.concat(F.lit("--- a/"), file), F.concat(F.lit("+++ b/"), file), F.lit("@@ -1 +1 @@"), F.lit("-old  one"), *there, near)
    share = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('{"'), file, F.lit('":{"attribution":"mixed"}}'))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('{"'), file, F.lit('":"agent"}')))
    commits = t.part.select(F.col("p_size").alias("session"), F.concat(F.lit("c"), key).alias("com"), patch.alias("patch"), share.alias("attribution"))
    actions = E.write_actions(calls, ["session", "p_partkey"], "tool", "payload")
    return E.matched_edges(actions, commits, ["session"], ["p_partkey", "action"], "com", "patch", "attribution").drop("action")


@query("SELECT conv_id, turn, max(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS user_turn FROM conversations")
def e8_prompt_of_action(t):
    return E.prompt_of_action(t.conversations, ["conv_id"], "turn", F.col("role") == "user").select("conv_id", "turn", "user_turn")


@query("SELECT n_nationkey, path, content FROM (SELECT n_nationkey, 'a.py' AS path, n_name AS content FROM nation WHERE n_nationkey % 3 < 2 UNION ALL SELECT n_nationkey, 'b.py', 'kept' FROM nation WHERE n_nationkey % 3 = 1 UNION ALL SELECT n_nationkey, 'd.py', n_name FROM nation WHERE n_nationkey % 3 = 2)")
def g6_snapshot_files(t):
    """Contents as texts or in records, within a snapshot or not; backups' names are not contents."""
    k = F.col("n_nationkey") % 3
    plain = F.concat(F.lit('{"files":{"a.py":"'), "n_name", F.lit('","n.py":3}}'))
    nested = F.concat(F.lit('{"snapshot":{"trackedFiles":{"a.py":{"contents":"'), "n_name", F.lit('"},"e.py":{}},"fileContents":{"b.py":"kept"}}}'))
    backups = F.concat(F.lit('{"trackedFileBackups":{"c.py":"c@v1","d.py":{"text":"'), "n_name", F.lit('"}}}'))
    rows = t.nation.select("n_nationkey", F.when(k == 0, plain).when(k == 1, nested).otherwise(backups).alias("j"))
    return E.snapshot_files(rows, ["n_nationkey"], "j")


@query("SELECT n_nationkey, '{\"id\":' || CAST(n_nationkey AS VARCHAR) || ',\"name\":\"x\"}' AS record FROM nation WHERE n_nationkey % 2 = 0")
def g4_nested_records(t):
    inner = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('{"id":'), F.col("n_nationkey").cast("string"), F.lit(',"name":"x"}'))).otherwise(F.lit('{"id":1}'))
    doc = F.concat(F.lit('{"a":[1,{"b":'), inner, F.lit('}],"name":"top"}'))
    return E.found_nested(t.nation.select("n_nationkey", doc.alias("j")), ["n_nationkey"], "j", ["id", "name"])


@query("SELECT n_nationkey, path, share, complete FROM (SELECT n_nationkey, 'a.py' AS path, 'mixed' AS share, n_nationkey % 2 = 0 AS complete FROM nation UNION ALL SELECT n_nationkey, 'b.py', 'agent', false FROM nation)")
def g5_attributions(t):
    more = F.when(F.col("n_nationkey") % 2 == 0, F.lit(',"committed_version":"z"')).otherwise(F.lit(""))
    doc = F.concat(F.lit('{"a.py":{"attribution":"mixed","agent_version":"y"'), more, F.lit('},"b.py":"agent","__aggregate__":{"attribution":"all"}}'))
    return E.attributions(t.nation.select("n_nationkey", doc.alias("j")), ["n_nationkey"], "j")


@query("SELECT CASE WHEN user_id % 9 = 0 THEN NULL ELSE user_id END AS user_id, CAST(count(*) AS BIGINT) AS n_edges, CASE max(CASE WHEN value >= 99.9 THEN 4 WHEN value >= 70 THEN 3 WHEN value >= 30 THEN 2 ELSE 1 END) WHEN 4 THEN 'exact' WHEN 3 THEN 'strong' WHEN 2 THEN 'moderate' ELSE 'weak' END AS best, round(avg(value), 6) AS mean_recall FROM events GROUP BY 1")
def e10_edge_summary(t):
    v = F.col("value")
    label = F.when(v >= 99.9, "exact").when(v >= 70, "strong").when(v >= 30, "moderate").otherwise("weak")
    edges = t.events.select(F.when(F.col("user_id") % 9 != 0, F.col("user_id")).alias("user_id"), label.alias("confidence"), "value")
    return E.best_edges(edges, ["user_id"], "confidence", "value").withColumn("mean_recall", F.round("mean_recall", 6))


@query("SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'gone' WHEN arg_max(event_type, event_id) = 'view' THEN 'same' ELSE 'changed' END AS state FROM events GROUP BY user_id")
def e13_state_check(t):
    rows = t.events.select("user_id", "event_id", F.lit("seen").alias("kind"), "event_type", F.when(F.col("user_id") % 5 != 0, F.lit("view")).alias("now"))
    return E.changed_after_last_seen(rows, ["user_id"], "event_id", "kind", "event_type", "now")


@query("SELECT n_nationkey AS case_id, g AS gate, CASE WHEN g = 'build' THEN n_nationkey % 2 = 0 WHEN n_nationkey % 3 = 0 THEN false END AS passed FROM nation, (SELECT unnest(['build', 'tests']) AS g)")
def m6_reward_gates(t):
    gates = t.nation.select(F.col("n_nationkey").alias("case_id"), F.explode(F.array(F.lit("build"), F.lit("tests"))).alias("gate"))
    build = t.nation.select(F.col("n_nationkey").alias("case_id"), F.lit("build").alias("gate"), F.when(F.col("n_nationkey") % 2 == 0, " PASSED").otherwise("error").alias("outcome"))
    tests = t.nation.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("case_id"), F.lit("tests").alias("gate"), F.lit("0").alias("outcome"))
    return E.reward_gates(build.unionByName(tests), gates, "case_id", "gate", "outcome")


@query("SELECT n_nationkey, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j31_required_match(t):
    return E.required_match(t.nation.select("n_nationkey", "n_regionkey"), t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), ["n_regionkey"])


@query("WITH c AS (SELECT DISTINCT o_custkey % 50 AS band, l_partkey % 40 AS path FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1), f AS (SELECT DISTINCT l_orderkey % 50 AS band, l_suppkey AS com, l_partkey % 40 AS path FROM lineitem WHERE l_linenumber = 2), n AS (SELECT band, count(*) AS n FROM c GROUP BY 1) SELECT c.band, com, CAST(count(*) AS BIGINT) AS shared, round(count(*) / any_value(n), 6) AS share FROM c JOIN f USING (band, path) JOIN n ON c.band = n.band GROUP BY 1, 2")
def a39_band_overlap(t):
    calls = t.lineitem.where("l_linenumber = 1").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") % 50).alias("band"), (F.col("l_partkey") % 40).alias("path"))
    files = t.lineitem.where("l_linenumber = 2").select((F.col("l_orderkey") % 50).alias("band"), F.col("l_suppkey").alias("com"), (F.col("l_partkey") % 40).alias("path"))
    return E.band_overlap(calls, files, "band", "com", "path").withColumn("share", F.round("share", 6))


@query("SELECT o_custkey, o_orderkey, NOT strict AS backfill FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY strict DESC, o_orderdate DESC, o_orderkey) AS n FROM (SELECT *, o_totalprice > 300000 AS strict FROM orders)) WHERE n <= 4")
def f12_strict_then_backfill(t):
    return E.kept_for_strict(t.orders, ["o_custkey"], F.col("o_totalprice") > 300000, [F.desc("o_orderdate"), F.col("o_orderkey")], 4).select("o_custkey", "o_orderkey", "backfill")


@query("SELECT event_id, strpos(',' || ids || ',', ',7,') > 0 AS has_seven FROM (SELECT event_id, CAST(user_id % 9 AS VARCHAR) || ',' || CAST(event_id % 9 AS VARCHAR) AS ids FROM events)")
def f10_id_in_list(t):
    ids = F.from_json(F.concat(F.lit("["), (F.col("user_id") % 9).cast("string"), F.lit(","), (F.col("event_id") % 9).cast("string"), F.lit("]")), "array<long>")
    return t.events.select("event_id", F.array_contains(ids, F.lit(7).cast("long")).alias("has_seven"))


@query("SELECT event_id, replace(replace(p, '\\home\\u\\w', '<cwd>'), '/home/u/w', '<cwd>') AS path FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '/home/u/w/f' ELSE '\\home\\u\\w\\f' END || CAST(event_id AS VARCHAR) AS p FROM events)")
def x14_rewritten_paths(t):
    p = F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("/home/u/w/f")).otherwise(F.lit("\\home\\u\\w\\f")), F.col("event_id").cast("string"))
    return t.events.select("event_id", F.regexp_replace(p, r"[/\\]home[/\\]u[/\\]w", "<cwd>").alias("path"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{}' ELSE '{\"v\":1.5}' END AS j FROM events")
def p10_json_safe(t):
    """Not-a-number becomes null, and null fields are left out."""
    v = F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.lit(1.5))
    return t.events.select("event_id", F.to_json(F.struct(F.when(~F.isnan(v), v).alias("v"))).alias("j"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS steps, CAST(count(*) FILTER (WHERE i = 1) AS BIGINT) AS messages, bool_or(contains(text, 'the')) AS reads FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i FROM conversations) GROUP BY 1")
def a45_turn_steps(t):
    """Repeated message ids (here: roles) count once."""
    from pyspark.sql import Window as W

    i = F.row_number().over(W.partitionBy("conv_id", "role").orderBy("turn"))
    return t.conversations.withColumn("i", i).groupBy("conv_id").agg(F.count("*").alias("steps"), F.count_if(F.col("i") == 1).alias("messages"), F.bool_or(F.contains("text", F.lit("the"))).alias("reads"))


@query("WITH p AS (SELECT a.event_type AS a, b.event_type AS b, count(*) FILTER (WHERE a.n > 12 AND b.n > 12) AS x, count(*) FILTER (WHERE a.n > 12 AND b.n <= 12) AS y, count(*) FILTER (WHERE a.n <= 12 AND b.n > 12) AS z, count(*) FILTER (WHERE a.n <= 12 AND b.n <= 12) AS w FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) a JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2) SELECT a, b, round((x * w - y * z) / sqrt((x + y)::DOUBLE * (z + w) * (x + z) * (y + w)), 6) AS phi FROM p WHERE x >= 5 AND x + y + z + w >= 50")
def t11_meaningful_pairs(t):
    from ..operators.statistics import cell_counts

    n = t.events.groupBy("user_id", "event_type").agg((F.count("*") > 12).alias("often"))
    pairs = n.select("user_id", F.col("event_type").alias("a"), F.col("often").alias("p")).join(n.select("user_id", F.col("event_type").alias("b"), F.col("often").alias("q")), "user_id").where("a < b")
    cells = cell_counts(pairs, ["a", "b"], F.col("p"), F.col("q"))
    c = [F.col(x) for x in ("n11", "n10", "n01", "n00")]
    return cells.where((c[0] >= 5) & (c[0] + c[1] + c[2] + c[3] >= 50)).select("a", "b", F.round(ST.phi(*c), 6).alias("phi"))


@query("SELECT user_id, label, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY event_id DESC) AS n FROM (SELECT user_id, event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS label FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90))) WHERE n = 1")
def l12_seeded_cache(t):
    from ..sources.tables import latest_record

    members = t.events.where("event_type = 'purchase' and value > 90").select("user_id").distinct()
    rows = t.events.join(members, "user_id", "left_semi").select("user_id", "event_id", F.when(F.col("value") > 50, "high").otherwise("low").alias("label"))
    return latest_record(rows, ["user_id", "label"], "event_id").select("user_id", "label", "event_id")
