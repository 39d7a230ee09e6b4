"""Queries over sources and sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import tables as S
from .catalogue import query

EVENT_CSV = "event_id long, user_id long, event_type string, value double"


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s1_full_scan(t):
    return t.nation.select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def s2_projected_scan(t):
    return t.lineitem.select("l_orderkey", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 37")
def s3_equality_scan(t):
    return t.orders.where("o_custkey = 37").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 5, 9, 37) AND o_orderstatus IN ('F', 'O')")
def s4_list_scan(t):
    return t.orders.where(F.col("o_custkey").isin(1, 5, 9, 37) & F.col("o_orderstatus").isin("F", "O")).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount >= 0.05 AND l_quantity < 10 AND l_shipdate >= TIMESTAMP '2000-01-01'")
def s5_expression_scan(t):
    return t.lineitem.where("l_discount >= 0.05 AND l_quantity < 10 AND l_shipdate >= TIMESTAMP_NTZ '2000-01-01 00:00:00'").select("l_orderkey", "l_linenumber")


@query("SELECT substr(c_name, 10, 8) AS prefix, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1")
def s6_prefix_key(t):
    return t.customer.groupBy(F.substring("c_name", 10, 8).alias("prefix")).agg(F.count("*").alias("n"))


@query("SELECT 'nation' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(3 AS BIGINT) AS n_columns FROM nation UNION ALL SELECT 'region', count(*), 2 FROM region UNION ALL SELECT 'events', count(*), 6 FROM events")
def s7_discovery(t):
    found = S.discover(t.spark, t.sf_dir, ["nation", "region", "events", "session_logs"])
    return S.inventory({name: t.spark.read.parquet(path) for name, path in found.items()})


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id % 2 = 1 AND role = 'user'")
def s8_one_split(t):
    """A data set of two splits, of which one is read with a predicate."""
    where = S.workspace(t.spark)
    t.conversations.withColumn("split", F.when(F.col("conv_id") % 2 == 0, "train").otherwise("test")).write.partitionBy("split").parquet(where)
    return S.read_split(t.spark, where, "test", F.col("role") == "user").select("conv_id", "turn", "role")


@query("SELECT n_nationkey, 'NAME' AS name, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'REGION', CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'EMPTY', '' FROM nation")
def x17_env_lines(t):
    more = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("\r\nREGION="), F.col("n_regionkey").cast("string"))).otherwise(F.lit("\n#REGION=9"))
    text = F.concat(F.lit('# settings\n\n NAME = "'), "n_name", F.lit('"\nno setting\n=nameless'), more, F.lit("\nNAME=later\nEMPTY=''\n"))
    return S.env_lines(t.nation.select("n_nationkey", text.alias("text")), ["n_nationkey"], "text")


def _columns_sql() -> str:
    """A row for each column of two tables: its kind, the name it is known by, rows and distinct values."""
    known = {"n_name": "'name'", "n_regionkey": "'region'", "r_name": "'name'", "r_regionkey": "'region'"}
    kinds = {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int", "r_regionkey": "int", "r_name": "string"}
    return " UNION ALL ".join(f"SELECT '{'nation' if c[0] == 'n' else 'region'}' AS table_name, '{c}' AS column_name, '{kind}' AS dtype, CAST({known.get(c, 'NULL')} AS VARCHAR) AS logical, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM {'nation' if c[0] == 'n' else 'region'}" for c, kind in kinds.items())


@query(_columns_sql())
def a41_schema_report(t):
    return S.schema_report({"nation": t.nation, "region": t.region}, {"name": ["label", "n_name", "r_name"], "region": ["r_regionkey", "n_regionkey"]})


@query("SELECT 'nations.n' || CAST(n_nationkey AS VARCHAR) || '.name' AS key, n_name AS value FROM nation UNION ALL SELECT 'nations.n' || CAST(n_nationkey AS VARCHAR) || '.even', CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END FROM nation")
def s19_settings(t):
    """A settings file of nested tables, written and read back."""
    where = S.workspace(t.spark)
    entry = F.concat(F.lit("[nations.n"), F.col("n_nationkey").cast("string"), F.lit(']\nname = "'), "n_name", F.lit('"\neven = '), (F.col("n_nationkey") % 2 == 0).cast("string"))
    t.nation.agg(F.array_join(F.sort_array(F.collect_list(entry)), "\n").alias("value")).coalesce(1).write.text(where)  # 25 rows
    return S.read_toml(t.spark, where)


@query("SELECT event_id, user_id, event_type, value FROM events")
def s10_csv_round_trip(t):
    where = S.workspace(t.spark)
    S.write_csv(t.events.select("event_id", "user_id", "event_type", "value"), where)
    return S.read_csv(t.spark, where, EVENT_CSV)


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')")
def s11_many_csv(t):
    where, kinds = S.workspace(t.spark), ["click", "error"]
    for k in kinds:
        S.write_csv(t.events.where(F.col("event_type") == k).select("event_id", "user_id", "event_type", "value"), f"{where}/{k}")
    return S.read_csv(t.spark, [f"{where}/{k}" for k in kinds], EVENT_CSV, ["event_id", "event_type"])


@query("SELECT event_id, event_type FROM events WHERE event_id % 10 <> 3 AND event_id % 10 <> 4")
def s12_tolerant_jsonl(t):
    where = S.workspace(t.spark)
    line = F.when(F.col("event_id") % 10 == 3, F.lit('{"event_id": 1, "broken')).when(F.col("event_id") % 10 == 4, F.lit("[1, 2]")).otherwise(F.to_json(F.struct("event_id", "event_type")))
    t.events.select(line.alias("value")).write.text(where)
    return S.read_jsonl(t.spark, where, "event_id long, event_type string")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events WHERE value >= 5) WHERE n = 1")
def s13_log_cache(t):
    return S.latest_record(t.events, ["user_id", "event_type"], "event_id", F.col("value") >= 5).select("user_id", "event_type", "event_id", "value")


@query("SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def s14_json_column(t):
    return t.events.groupBy(F.from_json("props", "k int")["k"].alias("k")).agg(F.count("*").alias("n"))


@query("SELECT CAST(e.user_id % 7 AS BIGINT) AS run, CAST(count(*) AS BIGINT) AS corrections, CASE WHEN e.user_id % 7 < 5 THEN 'c' || CAST(e.user_id % 7 % 2 AS VARCHAR) END AS condition FROM events e WHERE event_type = 'error' GROUP BY e.user_id % 7")
def s15_runs_with_metadata(t):
    where = S.workspace(t.spark)
    run = (F.col("user_id") % 7).alias("run")
    t.events.where("event_type = 'error'").groupBy(run).agg(F.count("*").alias("corrections")).write.partitionBy("run").json(f"{where}/metrics")
    t.spark.range(5).select(F.col("id").alias("run"), F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("condition")).write.partitionBy("run").json(f"{where}/metadata")
    metrics = t.spark.read.schema("corrections long, run long").json(f"{where}/metrics")
    return metrics.join(t.spark.read.schema("condition string, run long").json(f"{where}/metadata"), "run", "left").select("run", "corrections", "condition")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'signup'")
def s16_embedded_json(t):
    page = F.concat(F.lit('<html><script>var a;</script><script id="data" type="application/json">'), "props", F.lit("</script></html>"))
    return t.events.where("event_type = 'signup'").select("event_id", S.embedded_json(page, "k int")["k"].alias("k"))


@query("SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def s17_markdown_table(t):
    lines = t.nation.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_regionkey").cast("string"), F.lit(" |")))), "\n").alias("rows"))
    return S.pipe_table(lines.select(F.concat(F.lit("# Nations\n\n| name | region |\n| --- | :-: |\n"), "rows", F.lit("\n\nend")).alias("doc")), "doc", ["name", "region"])


@query("SELECT CAST(doc_id AS VARCHAR) || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS sha256 FROM documents")
def s18_manifest(t):
    return S.manifest(t.documents.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), "text"), "file", "text")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def s9_streamed_counts(t):
    """The table as a stream of files, counted with kept state until all files are read."""
    from ..streaming.counts import counted_stream

    return counted_stream(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema, ["event_type"])


@query("SELECT '{\"a_key\":' || CAST(n_nationkey AS VARCHAR) || ',\"b_name\":\"' || n_name || '\"}' AS record FROM nation")
def k2_sorted_json(t):
    return t.nation.select(F.col("n_name").alias("b_name"), F.col("n_nationkey").alias("a_key")).select(S.sorted_json(["b_name", "a_key"]).alias("record"))


@query("SELECT event_id, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, value FROM events WHERE event_id % 2 = 1")
def k3_appended_jsonl(t):
    where = S.workspace(t.spark)
    for k in range(2):
        S.append_jsonl(t.events.where(F.col("event_id") % 2 == k).select("event_id", "value"), where)
    return S.read_jsonl(t.spark, where, "event_id long, value double")


@query("SELECT '## Events' || chr(10) || string_agg('- ' || event_type || ': ' || CAST(n AS VARCHAR), chr(10) ORDER BY event_type) AS report FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def k4_report(t):
    lines = t.events.groupBy("event_type").agg(F.count("*").alias("n")).select(F.struct("event_type", F.concat(F.lit("- "), "event_type", F.lit(": "), F.col("n").cast("string")).alias("line")).alias("s"))
    return lines.agg(F.concat(F.lit("## Events\n"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n")).alias("report"))


@query("SELECT conv_id, string_agg('[' || CAST(turn AS VARCHAR) || '] ' || role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def k7_transcripts(t):
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), "role", F.lit(": "), "text")
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda s: s["line"]), "\n").alias("transcript"))


@query("SELECT n_nationkey AS id, n_name AS name, CAST(NULL AS VARCHAR) AS language FROM nation")
def p4_resolved_names(t):
    return S.resolve(S.require_columns(t.nation, ["n_name"]), {"id": ["nation_id", "n_nationkey"], "name": ["n_name", "name"], "language": ["lang"]})


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END, TIMESTAMP '1990-01-01') AS best_date, upper(trim(o_orderpriority)) AS priority FROM orders")
def p123_computed_columns(t):
    return t.orders.select("o_orderkey", F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")), F.expr("TIMESTAMP_NTZ '1990-01-01 00:00:00'")).alias("best_date"), F.upper(F.trim("o_orderpriority")).alias("priority"))


@query("SELECT event_type, CASE event_type WHEN 'click' THEN 'touch' WHEN 'view' THEN 'look' ELSE coalesce(trim(event_type), 'unknown') END AS family, CASE WHEN value >= 99.9 THEN 'exact' WHEN value >= 70 THEN 'strong' WHEN value >= 30 THEN 'moderate' ELSE 'weak' END AS band, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2, 3")
def p567_maps_and_ladders(t):
    names = F.create_map(F.lit("click"), F.lit("touch"), F.lit("view"), F.lit("look"))
    family = F.coalesce(F.try_element_at(names, F.lower(F.trim("event_type"))), F.trim("event_type"), F.lit("unknown"))
    band = F.when(F.col("value") >= 99.9, "exact").when(F.col("value") >= 70, "strong").when(F.col("value") >= 30, "moderate").otherwise("weak")
    return t.events.groupBy("event_type", family.alias("family"), band.alias("band")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, axis, value FROM (SELECT l_orderkey, l_linenumber, 'quantity' AS axis, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'discount', l_discount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem) WHERE value > 0")
def p8_wide_to_long(t):
    wide = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return wide.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "axis", "value").where("value > 0")


@query("SELECT o_orderkey, o_custkey AS c, CAST(o_totalprice AS DOUBLE) AS p FROM orders WHERE o_orderpriority = '1-URGENT'")
def p9_nested_projection(t):
    return t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.struct(F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("p"), F.col("o_orderstatus").alias("s")).alias("e")).select("o_orderkey", "e.c", "e.p")


@query("SELECT doc_id, key AS path, value AS mark FROM (SELECT doc_id, 'quality' AS key, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) WHERE value <> 0")
def p11_exploded_map(t):
    m = F.create_map(F.lit("quality"), F.nullif(F.col("quality"), F.lit(0)), F.lit("toxic"), F.nullif(F.col("toxic"), F.lit(0)), F.lit("__aggregate__"), F.lit(1))
    return t.labels.select("doc_id", F.explode(m).alias("path", "mark")).where("mark is not null and path <> '__aggregate__'")


@query("SELECT c_custkey, best_key, best_price, CAST(base_price AS DOUBLE) AS base_price FROM (SELECT o_custkey AS c_custkey, o_orderkey AS best_key, o_totalprice AS best_price, first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS base_price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def p12_best_against_incumbent(t):
    from pyspark.sql import Window as W

    base = F.first("o_totalprice").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    best = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t.orders.withColumns({"base_price": base, "n": best}).where("n = 1").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("best_key"), F.col("o_totalprice").alias("best_price"), "base_price")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_custkey AS VARCHAR) = '37'")
def p13_optional_match(t):
    from ..operators.filters import matching

    return matching(t.orders, {"o_custkey": "37", "o_orderstatus": None}).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND trim(text) <> '' AND lang IN ('en', 'fr') AND NOT source IN ('src1', 'src2') AND n_chars BETWEEN 100 AND 5000")
def f124_predicates(t):
    from ..operators.filters import present

    return t.documents.where(present("text") & F.col("lang").isin("en", "fr") & ~F.coalesce(F.col("source").isin("src1", "src2"), F.lit(False)) & F.col("n_chars").between(100, 5000)).select("doc_id")


@query("SELECT CAST(count(*) FILTER (WHERE event_type IN ('error')) AS BIGINT) AS listed, CAST(count(*) FILTER (WHERE event_type IS NOT NULL AND event_type NOT IN ('view', 'click')) AS BIGINT) AS not_excluded FROM events")
def f3_two_definitions(t):
    return t.events.agg(F.count_if(F.col("event_type") == "error").alias("listed"), F.count_if(F.col("event_type").isNotNull() & ~F.col("event_type").isin("view", "click")).alias("not_excluded"))


@query("SELECT doc_id FROM labels WHERE greatest(abs(quality), abs(toxic)) > 0")
def f5_any_nonzero(t):
    from ..operators.filters import any_nonzero

    return t.labels.where(any_nonzero(["quality", "toxic"])).select("doc_id")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM conversations WHERE coalesce(CASE role WHEN 'user' THEN true WHEN 'assistant' THEN false END, false)")
def f7_nullable_flag(t):
    flag = F.when(F.col("role") == "user", True).when(F.col("role") == "assistant", False)
    return t.conversations.where(F.coalesce(flag, F.lit(False))).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn FROM conversations WHERE role NOT IN ('system') AND starts_with(text, 'T')")
def f89_exclusion_and_prefix(t):
    return t.conversations.where(~F.col("role").isin("system") & F.col("text").startswith("T")).select("conv_id", "turn")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(split_part(text, chr(10), 1), '\d') OR contains(text, chr(10) || '* ')")
def f11_regex(t):
    return t.documents.where(X.first_line(F.col("text")).rlike(r"[0-9]") | F.contains("text", F.lit("\n* "))).select("doc_id")


@query("SELECT step, n FROM (SELECT 1 AS step, CAST(count(*) AS BIGINT) AS n FROM orders UNION ALL SELECT 2, count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 3, count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 UNION ALL SELECT 4, count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderpriority = '1-URGENT')")
def f13_cascade(t):
    from ..operators.filters import cascade

    return cascade(t.orders, [F.lit(True), F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000, F.col("o_orderpriority") == "1-URGENT"])


@query("SELECT k, CAST(count(*) FILTER (WHERE n >= k) AS BIGINT) AS users FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), (SELECT unnest([1, 5, 10, 15, 20, 30]) AS k) GROUP BY k")
def f14_threshold_curve(t):
    from ..operators.filters import threshold_curve

    return threshold_curve(t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")), "n", [1, 5, 10, 15, 20, 30]).withColumnRenamed("entities", "users")


@query("SELECT lo, hi, CAST(count(*) FILTER (WHERE n >= 3) AS BIGINT) AS users FROM (SELECT lo, hi, o_custkey, count(*) AS n FROM orders JOIN (VALUES (0, 100000), (50000, 200000), (200000, 500000)) b(lo, hi) ON o_totalprice BETWEEN lo AND hi GROUP BY 1, 2, 3) GROUP BY 1, 2")
def f15_band_grid(t):
    from ..operators.filters import bands

    per = bands(t.orders, "o_totalprice", [(0, 100000), (50000, 200000), (200000, 500000)]).groupBy("lo", "hi", "o_custkey").agg(F.count("*").alias("n"))
    return per.groupBy("lo", "hi").agg(F.count_if(F.col("n") >= 3).alias("users"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def f17_not_done_yet(t):
    """Customers without a large order so far."""
    done = t.orders.where("o_totalprice > 400000").select("o_custkey")
    return t.customer.join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
