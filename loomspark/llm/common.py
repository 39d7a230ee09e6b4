"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import itertools
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; a longer text makes a step of its own.
STEP_BYTES = 4 << 20
STEP_ROWS = 50_000
#: Bytes of one Arrow batch between Spark and a worker; a longer row makes a batch of its own.
BATCH_BYTES = 1 << 20
#: Rows that Spark decodes of a Parquet file at once.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what Spark reads of a Parquet file, and hands to a worker, at once: rows here are whole texts or files, so
    that thousands of them are no small batch. Smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", BATCH_ROWS)):
        if int(str(spark.conf.get(key)).rstrip("bB")) > most:
            spark.conf.set(key, most)


def texts(docs: DataFrame) -> DataFrame:
    """The two columns that operators read; other columns, whatever their names, stay behind."""
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset and one machine does all the work, one of
    our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete_on_exit(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later steps neither repeat it nor depend on its executors."""
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/loomspark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    delete_on_exit(spark, where)
    out = spark.read.schema(df.schema).parquet(where)
    out.__dict__["_written"] = where
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `materialise` that nothing will read any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.__dict__["_written"])
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that df has no column of, in any case of letters."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_fold(doc_id, folds: int):
    """crc32 of the id as text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def slices(batch: pa.RecordBatch, most: int = STEP_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each piece holds `most` bytes of text at most, or one row."""
    col = batch.column(column)
    if not len(col):
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def pieces(batches: Iterator[pa.RecordBatch], most: int = STEP_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of all batches in pieces of `most` bytes of text, or one row, and of about STEP_ROWS rows at most."""
    held, size, rows = [], 0, 0
    for batch in batches:
        for piece in slices(batch, most, column):
            n = pc.sum(pc.binary_length(piece.column(column))).as_py() or 0
            if held and (size + n > most or rows > STEP_ROWS):
                yield joined_batches(held)
                held, size, rows = [], 0, 0
            held.append(piece)
            size, rows = size + n, rows + piece.num_rows
    if held:
        yield joined_batches(held)


def joined_batches(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def ids(batch: pa.RecordBatch) -> list[int | None]:
    return batch.column("doc_id").to_pylist()


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def tidy() -> None:
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], give_back: bool = True):
    """run, whose batches leave in pieces of about BATCH_BYTES at most, or one row, and after which a worker gives back
    what it no longer needs: workers live on and serve other stages."""

    def whole(batches):
        try:
            for out in run(batches):
                rows = out.num_rows
                step = max(1, rows * BATCH_BYTES // max(out.nbytes, 1))
                for k in range(0, rows, step):
                    yield out.slice(k, step)
        finally:
            if give_back:
                tidy()

    return whole


def map_slices(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most: int = STEP_BYTES) -> DataFrame:
    """mapInArrow over bounded pieces; f makes one batch, or None, of each."""

    def run(batches):
        for piece in pieces(batches, most):
            out = f(piece)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(tidied(run), schema)


def joined(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and the n + 1 offsets of the chunks."""
    off = np.zeros(len(chunks) + 1, dtype=np.int64)
    np.cumsum([len(c) for c in chunks], out=off[1:])
    return np.frombuffer(b"".join(chunks), dtype=np.uint8), off


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of range(start, start + len) of all pairs."""
    total = int(lens.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


class Remembered:
    """What a worker keeps of earlier batches: key to bytes, at most `most` bytes with what Python adds to each.

    `new` has all keys of the batch at hand. When it fills up, it becomes the older half and the half before it goes, so
    keys that come again and again stay.
    """

    #: Bytes that a key and its value take besides their characters.
    EACH = 180

    def __init__(self, most: int = 32 << 20):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size, self.most = 0, most

    def missing(self, keys: set[str]) -> list[str]:
        """Those of keys that are not known, after the others have been moved to `new`."""
        if self.size > self.most // 2:
            self.old, self.new, self.size = self.new, {}, 0
        keys = keys - self.new.keys()
        again = keys & self.old.keys()
        self.learn({k: self.old.pop(k) for k in again})
        return list(keys - again)

    def learn(self, found: dict[str, bytes]) -> None:
        self.new.update(found)
        self.size += sum(map(len, found)) + sum(map(len, found.values())) + self.EACH * len(found)


def batch_of(schema_names: list[str], columns: list, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=schema_names)


def task_key() -> int:
    """Differs between the tasks of a stage and is the same when a task runs again."""
    from pyspark import TaskContext

    c = TaskContext.get()
    return c.partitionId() if c else 0


def counter() -> Iterator[int]:
    return itertools.count(task_key() << 32)


def vocabulary_path(name: str) -> str:
    """Place of a public tokenizer's file: a path is taken as it is, a bare name is looked up."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
