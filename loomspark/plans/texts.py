"""Queries over scalar functions on text, time and JSON, and over patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import multiset_recall
from ..operators import diffs as D
from ..sources.tables import spread
from .catalogue import query


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents")
def x1_squeezed(t):
    return t.documents.select("doc_id", F.md5(X.squeezed(F.col("text"))).alias("h"))


@query(r"SELECT doc_id, CAST(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')) AS BIGINT) AS n FROM documents")
def x2_meaningful_lines(t):
    return t.documents.select("doc_id", F.size(X.meaningful_lines(F.col("text"))).cast("long").alias("n"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 35) || ' [...] ' || right(text, 18) ELSE text END AS excerpt, CASE WHEN length(text) > 40 THEN left(text, 37) || '...' ELSE text END AS clip FROM documents")
def x34_excerpts(t):
    x = F.col("text")
    return t.documents.select("doc_id", X.head_and_tail(x, 60).alias("excerpt"), X.clipped(x, 40).alias("clip"))


@query("SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents")
def x5_first_line(t):
    return t.documents.select("doc_id", X.first_line(F.col("text")).alias("line"))


@query("SELECT page_id, list_last(string_split(url, '/')) AS base, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS plain, regexp_replace(url, '[^A-Za-z0-9]', '-', 'g') AS slug FROM pages")
def x6715_names(t):
    u = F.col("url")
    return t.pages.select("page_id", X.basename(u).alias("base"), X.plain_name(u).alias("plain"), X.slug(u).alias("slug"))


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' ELSE 'S' END || CAST(turn AS VARCHAR) AS tag FROM conversations")
def x8_tags(t):
    r = F.col("role")
    return t.conversations.select("conv_id", "turn", F.concat(F.when(r == "user", "U").when(r == "assistant", "A").otherwise("S"), F.col("turn").cast("string")).alias("tag"))


@query(r"SELECT conv_id, turn, array_to_string(list_slice(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), 1, 25), ' ') AS short, CAST(CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS BIGINT) AS words, CAST((length(text) + 3) // 4 AS BIGINT) AS tokens FROM conversations")
def x910_words(t):
    x = F.col("text")
    return t.conversations.select("conv_id", "turn", X.first_words(x, 25).alias("short"), X.word_count(x).alias("words"), F.expr("cast((length(text) + 3) div 4 as bigint)").alias("tokens"))


@query("SELECT conv_id, turn, substr(text, strpos(text, ' the ') + 5) AS rest FROM conversations WHERE contains(text, ' the ')")
def x11_after_marker(t):
    return t.conversations.where(F.contains("text", F.lit(" the "))).select("conv_id", "turn", F.regexp_extract("text", "(?s)^.*? the (.*)", 1).alias("rest"))


def _redaction_sql() -> str:
    """The replacements one after the other, with the number of each counted before it is made."""
    text, counts = "x", []
    for pattern, marker in X.SECRETS:
        counts.append(f"len(regexp_extract_all({text}, '{pattern}'))")
        text = f"regexp_replace({text}, '{pattern}', '{marker}', 'g')"
    return f"SELECT doc_id, CAST({' + '.join(counts)} AS BIGINT) AS n, md5({text}) AS h"


@query(f"{_redaction_sql()} FROM (SELECT doc_id, text AS x FROM documents)")
def x16_redacted(t):
    text, n = X.redacted(F.col("text"))
    return t.documents.select("doc_id", n.alias("n"), F.md5(text).alias("h"))


_KEYS = ("sk-proj-", "AIza", "AKIA", "gho_", "github_pat_", "xoxb-", "ghx_", "sk_")


@query(f"{_redaction_sql()} FROM (SELECT event_id AS doc_id, 'key: ' || ['{"', '".join(_KEYS)}'][event_id % 8 + 1] || upper(md5(CAST(event_id AS VARCHAR))) || upper(md5('b' || CAST(event_id AS VARCHAR))) || ' end' AS x FROM events)")
def x16_redacted_kinds(t):
    """Every kind of credential, and forms that are none."""
    kind = F.get(F.array(*map(F.lit, _KEYS)), (F.col("event_id") % 8).cast("int"))
    secret = F.upper(F.concat(F.md5(F.col("event_id").cast("string")), F.md5(F.concat(F.lit("b"), F.col("event_id").cast("string")))))
    text, n = X.redacted(F.concat(F.lit("key: "), kind, secret, F.lit(" end")))
    return t.events.select(F.col("event_id").alias("doc_id"), n.alias("n"), F.md5(text).alias("h"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 90 MINUTE AS until, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS BIGINT) AS days, strftime(o_orderdate, '%Y-%m') AS month, CAST(epoch(o_orderdate) // 60 AS BIGINT) AS minutes FROM orders")
def d123_times(t):
    at = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.expr("o_orderdate + INTERVAL 90 MINUTE").alias("until"), F.datediff(F.lit("2002-01-01").cast("date"), at).cast("long").alias("days"), F.date_format(at, "yyyy-MM").alias("month"), F.expr("unix_seconds(cast(o_orderdate as timestamp)) div 60").alias("minutes"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN ts END AS parsed FROM events")
def d14_tolerant_times(t):
    said = F.when(F.col("event_id") % 5 == 0, F.lit("no time")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return t.events.select("event_id", F.try_to_timestamp(said).cast("timestamp_ntz").alias("parsed"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def g123_json_paths(t):
    """Bad JSON gives null; the first present of several paths counts."""
    text = F.when(F.col("event_id") % 3 == 0, F.lit("{broken")).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.concat(F.lit('{"repo":'), "props", F.lit("}")))
    v = F.try_parse_json(text)
    return t.events.select("event_id", F.coalesce(F.try_variant_get(v, "$.k", "long"), F.try_variant_get(v, "$.repo.k", "long")).alias("k"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, 'user_' || substr(sha256('salt' || chr(0) || CAST(c_custkey AS VARCHAR)), 1, 12) AS name, sha256(c_name || chr(0) || c_mktsegment) AS h FROM customer")
def h12_pseudonyms(t):
    k = F.col("c_custkey").cast("string")
    return t.customer.select(k.alias("id"), X.pseudonym(k, "salt").alias("name"), X.joined_hash(F.col("c_name"), F.col("c_mktsegment")).alias("h"))


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY sha256('7:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), conv_id, turn) AS place FROM conversations")
def h3_seeded_shuffle(t):
    from ..operators.resampling import shuffled

    return shuffled(t.conversations, ["conv_id", "turn"], 7).select("conv_id", "turn", F.col("place").cast("long").alias("place"))


@query("WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS x, generate_subscripts(string_split(text, ' '), 1) AS i, len(string_split(text, ' ')) AS n FROM documents), c AS (SELECT doc_id, x, count(*) FILTER (WHERE i <= n // 2) AS a, count(*) FILTER (WHERE i > n // 2) AS b FROM w GROUP BY 1, 2) SELECT doc_id, round(CASE WHEN sum(a) = 0 THEN 1.0 ELSE sum(least(a, b)) / sum(a) END, 6) AS recall FROM c GROUP BY 1")
def r2_multiset_recall(t):
    """How much of a text's first half comes again in the second, by words."""
    w = F.split("text", " ")
    rows = t.documents.select("doc_id", w.alias("w"), F.floor(F.size(w) / 2).cast("int").alias("half"))
    first, rest = F.slice("w", F.lit(1), F.col("half")), F.slice("w", F.col("half") + 1, F.size("w"))
    return rows.select("doc_id", F.round(multiset_recall(first, rest), 6).alias("recall"))


@query("SELECT event_id, CAST(len(list_intersect([user_id % 4, user_id % 6], [event_id % 4, event_id % 6])) AS BIGINT) AS common, CAST(len(list_distinct([user_id % 4, user_id % 6, event_id % 4])) AS BIGINT) AS distinct_n FROM events")
def r13_lists(t):
    u, e = F.col("user_id"), F.col("event_id")
    return t.events.select("event_id", F.size(F.array_intersect(F.array(u % 4, u % 6), F.array(e % 4, e % 6))).cast("long").alias("common"), F.size(F.array_distinct(F.array(u % 4, u % 6, e % 4))).cast("long").alias("distinct_n"))


def _patches(t):
    old, new = F.format_string("src/m%d/f%d.py", F.col("p_size") % 3, F.col("p_partkey")), F.col("p_partkey") % 4
    lines = [F.concat(F.lit("--- a/"), old), F.when(new == 0, F.lit("+++ /dev/null")).otherwise(F.concat(F.lit("+++ b/"), old)), F.lit("@@ -1,3 +1,3 @@"), F.lit(" kept"), F.concat(F.lit("-"), "p_brand"), F.concat(F.lit("+  "), "p_name", F.lit("  x")), F.lit("+"), F.lit("--- a/second.txt"), F.lit("+++ b/second.txt"), F.concat(F.lit("+"), "p_type")]
    return t.part.select("p_partkey", F.concat_ws("\n", *lines).alias("patch"), "p_brand", "p_name", "p_type")


@query(r"SELECT p_partkey, 'src/m' || CAST(p_size % 3 AS VARCHAR) || '/f' || CAST(p_partkey AS VARCHAR) || '.py' AS path, trim(regexp_replace(p_name || '  x', '\s+', ' ', 'g')) AS added, p_brand AS deleted FROM part UNION ALL SELECT p_partkey, 'second.txt', p_type, '' FROM part")
def e12_unified_patches(t):
    d = D.unified_patch(_patches(t), ["p_partkey"], "patch")
    return d.select("p_partkey", "path", F.array_join("added", "|").alias("added"), F.array_join("deleted", "|").alias("deleted"))


@query("SELECT p_partkey, 'f' || CAST(p_partkey AS VARCHAR) AS path, CAST(p_size AS BIGINT) AS added, CAST(p_size % 5 AS BIGINT) AS deleted, false AS \"binary\" FROM part UNION ALL SELECT p_partkey, 'logo.png', 0, 0, true FROM part WHERE p_partkey % 2 = 0")
def e3_numstat(t):
    first = F.concat(F.col("p_size").cast("string"), F.lit("\t"), (F.col("p_size") % 5).cast("string"), F.lit("\tf"), F.col("p_partkey").cast("string"))
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(first, F.lit("\n-,-,logo.png\n"))).otherwise(F.replace(first, F.lit("\t"), F.lit(" ")))
    return D.numstat(t.part.select("p_partkey", text.alias("n")), ["p_partkey"], "n")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'M' ELSE 'R' END AS status, CASE WHEN p_size % 2 = 0 THEN 'a.py' ELSE 'new.py' END AS path FROM part")
def e4_name_status(t):
    text = F.when(F.col("p_size") % 2 == 0, F.lit("M\ta.py\n")).otherwise(F.lit("R100\told.py\tnew.py"))
    return D.name_status(t.part.select("p_partkey", text.alias("n")), ["p_partkey"], "n")


_FILES = "SELECT p_partkey, 'update' AS kind, 'f' || CAST(p_size AS VARCHAR) || '.py' AS path, p_name AS added, p_brand AS deleted FROM part UNION ALL SELECT p_partkey, 'add', 'g.py', p_type, '' FROM part"


def _patch_texts(t):
    text = F.concat_ws("\n", F.lit("*** Begin Patch"), F.concat(F.lit("*** Update File: f"), F.col("p_size").cast("string"), F.lit(".py")), F.lit("@@"), F.concat(F.lit("-"), "p_brand"), F.concat(F.lit("+"), "p_name"), F.lit("*** Add File: g.py"), F.concat(F.lit("+"), "p_type"), F.lit("*** End Patch"))
    return t.part.select("p_partkey", text.alias("x"))


@query(_FILES)
def e5_patch_actions(t):
    d = D.patch_actions(_patch_texts(t), ["p_partkey"], "x")
    return d.select("p_partkey", "kind", "path", F.array_join("added", "|").alias("added"), F.array_join("deleted", "|").alias("deleted"))


@query(_FILES)
def e5_files_from_sql(t):
    """The same from SQL text, by a table function that Catalyst inlines."""
    from ..functions.tables import register

    register(t.spark)
    return t.spark.sql("SELECT p.p_partkey, f.operation AS kind, f.path, array_join(f.added, '|') AS added, array_join(f.deleted, '|') AS deleted FROM {patches} p, LATERAL patch_files(p.x) f", patches=_patch_texts(t))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN '' WHEN 2 THEN p_name || '|' || p_brand ELSE '' END AS added,
CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN '' WHEN 2 THEN '' ELSE p_brand END AS deleted, CAST(CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS BIGINT) AS n FROM part""")
def e67_edit_delta(t):
    """A line replaced, white space changed, lines inserted, a line taken out."""
    k = F.col("p_partkey") % 4
    old = F.when(k == 0, F.concat(F.lit("first\n"), "p_brand", F.lit("\nlast"))).when(k == 1, F.lit("a  b\n\nc")).when(k == 2, F.lit("first\nlast")).otherwise(F.concat(F.lit("first\n"), "p_brand", F.lit("\nlast")))
    new = F.when(k == 0, F.concat(F.lit("first\n"), "p_name", F.lit("\nlast"))).when(k == 1, F.lit("a b\nc")).when(k == 2, F.concat(F.lit("first\n"), "p_name", F.lit("\n"), "p_brand", F.lit("\nlast"))).otherwise(F.lit("first\nlast"))
    d = D.edit_delta(old, new)
    return t.part.select("p_partkey", d.alias("d"), D.changed_lines(old, new).alias("n")).select("p_partkey", F.array_join("d.added", "|").alias("added"), F.array_join("d.deleted", "|").alias("deleted"), "n")


@query("""SELECT p_partkey, round((p_partkey % 4 + CASE WHEN p_partkey % 3 = 0 THEN 0.96875 ELSE 0 END) / 4.0, 6) AS recall,
CASE WHEN p_partkey % 4 + CASE WHEN p_partkey % 3 = 0 THEN 0.96875 ELSE 0 END >= 2.8 THEN 'strong' WHEN p_partkey % 4 + CASE WHEN p_partkey % 3 = 0 THEN 0.96875 ELSE 0 END >= 1.2 THEN 'moderate' ELSE 'weak' END AS confidence FROM part""")
def e910_fuzzy_edges(t):
    """Four needle lines of 32 digits: perhaps the first with one character changed, and as many others as the key says."""
    line = lambda n: F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit(f":{n}")))
    needle = F.array(*map(line, (3, 0, 1, 2)))
    there = F.slice(needle, F.lit(2), (F.col("p_partkey") % 4).cast("int"))
    near = F.when(F.col("p_partkey") % 3 == 0, F.array(F.concat(F.left(line(3), F.lit(31)), F.lit("X")))).otherwise(F.array().cast("array<string>"))
    d = spread(t.part.select("p_partkey"), "p_partkey").select("p_partkey", D.text_recall(needle, F.concat(there, near)).alias("recall"))
    return d.select("p_partkey", F.round("recall", 6).alias("recall"), D.edge_confidence(F.lit(True), F.col("recall"), F.lit(True)).alias("confidence"))


@query("SELECT p_partkey, 0.5::DOUBLE AS survival FROM part WHERE p_name <> p_brand")
def e11_line_survival(t):
    rows = t.part.where("p_name <> p_brand")
    return rows.select("p_partkey", D.line_survival(F.array("p_name", "p_brand"), F.concat(F.lit("x\n  "), "p_name", F.lit("  \ny"))).alias("survival"))


@query("SELECT p_partkey, 'a ' || p_brand || ' c' AS content, CAST(1 AS BIGINT) AS misses FROM part")
def e12_replay(t):
    steps = F.array(
        F.struct(F.lit(1).alias("o"), F.lit("seed").alias("kind"), F.lit("").alias("old"), F.lit("a b c").alias("new")),
        F.struct(F.lit(2).alias("o"), F.lit("edit").alias("kind"), F.lit("b").alias("old"), F.col("p_brand").alias("new")),
        F.struct(F.lit(3).alias("o"), F.lit("edit").alias("kind"), F.lit("not there").alias("old"), F.lit("z").alias("new")),
    )
    return D.replay(t.part.select("p_partkey", F.explode(steps).alias("s")).select("p_partkey", "s.*"), ["p_partkey"], "o", "kind", "old", "new")
