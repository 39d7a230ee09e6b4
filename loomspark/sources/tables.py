"""Reading and writing: table discovery, tolerant parsers, log caches, sinks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def workspace(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which executors share; a temporary one only where that is unset and one
    machine does all the work."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomspark-")
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to a fresh folder and read from there: for what is read more than once."""
    where = workspace(df.sparkSession)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to all tasks, for rows whose work is far larger than their bytes: a small file is one task's."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def discover(spark: SparkSession, folder: str, names: list[str]) -> dict[str, str]:
    """The place of each table: a flat file, a folder of that name, or one below data/. Missing tables are left out.

    Asks the file system of the path, so that any store works.
    """
    jvm = spark._jvm
    found = {}
    for name in names:
        for place in (f"{folder}/{name}.parquet", f"{folder}/{name}", f"{folder}/data/{name}.parquet", f"{folder}/data/{name}"):
            path = jvm.org.apache.hadoop.fs.Path(place)
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                found[name] = place
                break
    return found


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df itself; an error that names the missing columns otherwise."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def resolve(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Selects, under its logical name, the first present candidate of each column; absent ones become null."""
    out = []
    for name, candidates in wanted.items():
        have = next((c for c in candidates if c in df.columns), None)
        out.append((F.col(have) if have else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows, n_columns of each table, as one plan."""
    rows = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def schema_report(tables: dict[str, DataFrame], logical: dict[str, list[str]]) -> DataFrame:
    """table_name, column_name, dtype, logical, n_rows, n_distinct of every column; logical is the name under which
    `logical` knows it (the first of its candidates that the table has), null for other columns. One pass a table."""
    out = None
    for name, df in tables.items():
        known = {next((c for c in cs if c in df.columns), None): k for k, cs in logical.items()}
        counts = df.agg(F.count("*").alias("__rows"), *[F.countDistinct(c).alias(c) for c in df.columns])
        cells = [F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("dtype"), F.lit(known.get(c)).cast("string").alias("logical"), F.col("__rows").alias("n_rows"), F.col(c).alias("n_distinct")) for c, kind in df.dtypes]
        one = counts.select(F.lit(name).alias("table_name"), F.inline(F.array(*cells)))
        out = one if out is None else out.unionByName(one)
    return out


def read_split(spark: SparkSession, folder: str, split: str, keep: Column | None = None) -> DataFrame:
    """One split of a data set laid out as folder/split=name, with a row predicate that reaches the scan."""
    rows = spark.read.parquet(folder).where(F.col("split") == split).drop("split")
    return rows if keep is None else rows.where(keep)


def env_lines(files: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, name, value of KEY=VALUE lines; blank lines, comments and lines without a name are left out, quotes around a
    value go, and of a name that comes again the first line counts."""
    lines = files.select(*keys, F.posexplode(F.split(text, r"\r?\n")).alias("no", "line")).withColumn("line", F.trim("line"))
    parts = F.regexp_extract("line", r"^([^=]*)=(.*)$", 1), F.regexp_extract("line", r"^([^=]*)=(.*)$", 2)
    bare = F.regexp_replace(F.regexp_replace(F.trim(parts[1]), r'^"+|"+$', ""), r"^'+|'+$", "")
    rows = lines.where("line <> '' and not startswith(line, '#')").select(*keys, "no", F.trim(parts[0]).alias("name"), bare.alias("value")).where("name <> ''")
    return rows.groupBy(*keys, "name").agg(F.min_by("value", "no").alias("value"))


def read_toml(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a TOML file's entries; keys of tables are joined by dots, lists and dates are text. A small file, read
    through Spark so that any store works."""
    import tomllib

    flat: list[tuple[str, str]] = []

    def walk(prefix: str, x) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                walk(f"{prefix}.{k}" if prefix else k, v)
        else:
            flat.append((prefix, str(x).lower() if isinstance(x, bool) else str(x)))

    walk("", tomllib.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())))
    return spark.createDataFrame(flat, "key string, value string")


def read_csv(spark: SparkSession, paths: list[str] | str, schema: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.csv(paths, header=True, schema=schema)
    return df.select(*columns) if columns else df


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "skip") -> DataFrame:
    """Records of a JSON-lines file that are objects. mode: skip leaves bad lines out, keep shows them in `bad_line`,
    fail stops at the first one."""
    struct = T._parse_datatype_string(schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("is_object", F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")).withColumn("record", F.when(F.col("is_object"), F.from_json("value", struct)))
    if mode == "keep":
        return parsed.select("record.*", F.when(~F.col("is_object"), F.col("value")).alias("bad_line"))
    if mode == "fail":
        return parsed.select(F.when(F.col("is_object"), F.col("record")).otherwise(F.raise_error(F.concat(F.lit("bad line: "), "value"))).alias("record")).select("record.*")
    return parsed.where("is_object").select("record.*")


def latest_record(log: DataFrame, keys: list[str], position: Column | str, ok: Column | None = None) -> DataFrame:
    """Log as cache: of each key the last record by position, among successful ones."""
    rows = log if ok is None else log.where(ok)
    order = F.col(position) if isinstance(position, str) else position
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(order.desc()))).where("__n = 1").drop("__n")


def embedded_json(html: Column, schema: str, element_id: str = "data") -> Column:
    """The JSON of a script element, parsed."""
    return F.from_json(F.regexp_extract(html, rf'(?s)<script id="{element_id}"[^>]*>(.*?)</script>', 1), schema)


def pipe_table(text: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows of Markdown pipe tables: lines of as many cells as names, the header and rule lines left out."""
    line = text.select(F.posexplode(F.split(column, r"\r?\n")).alias("line_no", "line")).where(F.trim("line").rlike(r"^\|.*\|$"))
    cells = line.withColumn("cells", F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")))
    rows = cells.where((F.size("cells") == len(names)) & ~F.forall("cells", lambda c: c.rlike("^:?-+:?$"))).where(F.element_at("cells", 1) != names[0])
    return rows.select(*[F.element_at("cells", k + 1).alias(n) for k, n in enumerate(names)])


def manifest(files: DataFrame, path: str, content: str) -> DataFrame:
    """path, n_bytes, sha256 of the files of a binaryFile frame, or of any frame with a path and a content."""
    body = F.col(content).cast("binary")
    return files.select(F.col(path).alias("path"), F.length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("sha256"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def sorted_json(columns: list[str]) -> Column:
    """A JSON object with keys in order of name."""
    return F.to_json(F.struct(*sorted(columns)))
