"""Structured Streaming over tables that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import workspace


def counted_stream(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """Counts per key of a folder, or one file, of Parquet read as a stream; all that is there now is read.

    The running counts live in the state store; each trigger's full result replaces the last in the shared folder.
    """
    where = workspace(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_file = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    source = spark.readStream.schema(schema).parquet(path.rsplit("/", 1)[0] + "/{" + path.rsplit("/", 1)[1] + "}" if is_file else path)

    def save(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(f"{where}/counts")

    stream = source.groupBy(*keys).agg(F.count("*").alias("n")).writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{where}/counts")


def sessions(events: DataFrame, user: str, at: str, gap: str, late: str) -> DataFrame:
    """Session windows of a stream (or a batch) of events: closed by a gap, with a watermark for late rows."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(at, late)
    return timed.groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n_events")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")
