"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Documents that a task holds as Python objects at one time.
BATCH_DOCS = 1024
#: Bytes of text that a task works on at one time, where what it makes of them takes many times that.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is absent, local sessions get a temporary folder; a cluster without it is an error.
    """
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if known:
        return known
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-checkpoints-")
    context.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that a lost executor costs no more than what follows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_file(path: str, data: bytes) -> None:
    fs, own = place(path)
    fs.create_dir(own.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(own, compression=None) as sink:
        sink.write(data)


def read_file(path: str) -> bytes:
    fs, own = place(path)
    with fs.open_input_file(own) as source:
        return source.read()


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def string_ends(batch: pa.RecordBatch) -> np.ndarray:
    """For each row, the bytes of all strings up to its end."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return np.cumsum(sizes)


def pieces(batches: Iterable[pa.RecordBatch], size: int = BATCH_DOCS, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most size and, if most is given, so many bytes of strings; a row beyond goes alone."""
    for batch in batches:
        ends = None if most is None else string_ends(batch)
        start = 0
        while start < batch.num_rows:
            stop = start + size
            if ends is not None:
                within = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right"))
                stop = min(stop, max(within, start + 1))
            yield batch.slice(start, stop - start)
            start = stop


def release() -> None:
    """Gives memory that this process has freed back to the system: idle Python workers are kept, with all they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def released(run: Batches) -> Batches:
    """run, with what it has freed given back when its task is over."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, size: int = BATCH_DOCS, most: int | None = None) -> DataFrame:
    """fn over each piece of df; None adds no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, size, most):
            out = fn(piece)
            if out is not None:
                yield out

    return df.mapInArrow(released(run), schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; bytes.lower and bytes.split do just that."""
    return text.lower().split()


def fold(column: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


#: Hashes of ids lie below this.
HASHES = 1 << 32


def id_hash(column: str) -> Column:
    """A number below HASHES from the md5 of an id as text; a null id hashes as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def hash_bounds(counts: DataFrame, sample: int) -> DataFrame:
    """counts(.., count) with bound: hashes below it belong to about sample rows of the group, and six deviations more."""
    wanted = sample + 6 * sample**0.5 + 10
    return counts.withColumn("bound", F.when(F.col("count") <= wanted, F.lit(float(HASHES))).otherwise(wanted / F.col("count") * HASHES))


def fold_of(doc_id: int | None, parts: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts
