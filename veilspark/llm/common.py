"""What the operators of this subpackage share: tables, durable cuts, text batches, hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in runs of about so many bytes, so that numpy's arrays stay small.
CHUNK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors share: the session's spark.checkpoint.dir.

    Only a session in local mode may leave it unset; a folder below its warehouse is taken then.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (own or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints").rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/veilspark-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """`df` cut from its lineage by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


#: Spark's switch by which a query's shuffle files go when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str, by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """`df` written as a Parquet table, in folders by some columns, and read again. The shuffle files that made it are dropped at once."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.options(**options).partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two longs by which a document's row is found again: its id (a null id has a fixed stand-in) and a hash of its text.

    Rows that agree in both are copies of one row and get the same result.
    """
    return [F.coalesce(doc_id.cast("long"), F.lit(-(2**63) + 1)).alias("d"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("k")]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n + 1 places where its rows begin. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    off = np.frombuffer(places, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    size = int(off[-1] - off[0])
    data = np.frombuffer(data, np.uint8, size, int(off[0])) if size else np.zeros(0, np.uint8)
    return data, off - off[0]


def runs(starts: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes, or one longer row."""
    n, i = len(starts) - 1, 0
    while i < n:
        j = int(np.searchsorted(starts, starts[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words, in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mixed(np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
_STEP = [np.uint64(int(x) | 1) for x in mixed(np.arange(1, 41, dtype=np.uint64))]


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` values, by joining the hashes of shorter runs; out[i] covers values[i : i + size]."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have = _BYTES[values] if values.dtype == np.uint8 else mixed(values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    level, length, out, done = 0, 1, None, 0
    while True:
        if size & length:
            part = have[done : done + n]
            out = part.copy() if out is None else out * _STEP[20 + level] + part
            done += length
        if done == size:
            return mixed(out)
        m = len(have) - length
        wide = have[:m] * _STEP[level]
        wide += have[length : length + m]
        have, level, length = wide, level + 1, length * 2


def rows_like(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)


#: The bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of some texts begin and end, and the n + 1 places among them where each text's words begin."""
    space = (data == 0x20) | (data - np.uint8(0x09) < 5)
    rim = np.ones(len(data) + 1, bool)  # rim[i]: byte i - 1 isn't part of the word at byte i
    rim[1:] = space
    rim[starts] = True
    begin = np.flatnonzero(~space & rim[:-1])
    rim[:-1] = space
    rim[starts] = True
    rim[-1] = True
    end = np.flatnonzero(~space & rim[1:]) + 1
    return begin, end, np.searchsorted(begin, starts)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of its blocks of 8 bytes, each mixed with its place, and its length."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    at_byte = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = end - begin
    blocks = (size + 7) >> 3
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(first[-1] + blocks[-1])) - np.repeat(first, blocks)
    left = np.repeat(size, blocks) - 8 * place
    value = at_byte[np.repeat(begin, blocks) + 8 * place]
    value &= np.uint64(2**64 - 1) >> (8 * np.maximum(8 - left, 0)).astype(np.uint64)
    value = mixed(value + mixed(np.arange(1, blocks.max() + 1).astype(np.uint64))[place])
    return mixed(np.add.reduceat(value, first) + size.astype(np.uint64))
