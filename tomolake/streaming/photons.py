"""Streams of photons: running sums per frame, and tables kept current batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tomolake.sources.versions import Versioned


def photon_stream(spark: SparkSession, path: str, schema: str, most_files: int = 64) -> DataFrame:
    """A stream of the Parquet files that arrive at path, at most most_files in a batch, however many are waiting."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def running_sums(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window, key, ksum, n of a stream (ts, key, k), final once the watermark has passed a window."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("window"), "key").agg(F.sum("k").alias("ksum"), F.count("*").alias("n"))


def keep_current(stream: DataFrame, path: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """Appends each batch to a partition of its own, batch=N, so that a repeated batch overwrites itself; latest() reads
    the newest row of each key."""

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_slices(stream: DataFrame, store: Versioned, key: str, name: str, checkpoint: str) -> StreamingQuery:
    """Puts each batch in place of the range of keys that it covers, from its least to its largest, in one new version of
    the table; the stream's name and the batch's number in the manifest make a repeated batch change nothing."""

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        first, last = batch.agg(F.min(key), F.max(key)).first()
        if first is not None:
            store.upsert(batch, key, first, last + 1, (name, number))
        batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows(batch, ...) the newest for each key."""
    others = [c for c in rows.columns if c not in key]
    newest = rows.groupBy(*key).agg(F.max(F.struct("batch", *[c for c in others if c != "batch"])).alias("x"))
    return newest.select(*key, *[F.col(f"x.{c}").alias(c) for c in others if c != "batch"])
