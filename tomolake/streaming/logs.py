"""The run log as a stream: open starts are state, by process and message."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tomolake.sources.tables import shared_dir
from tomolake.sources.versions import Versioned
from tomolake.streaming.photons import latest

INTERVAL = "pid {pid}, msg string, number long, start double, stop double, fault string"


def in_order(marks: DataFrame, path: str, files: int = 4, most: int = 1_000_000) -> None:
    """Writes marks(pid, msg, t, kind) as a log writer would: one file after another, each a stretch of time; at least
    `files`, and as many more as keep a file to about `most` marks."""
    files = max(files, -(-marks.count() // most))
    cuts = marks.approxQuantile("t", [k / files for k in range(1, files)], 0.001)
    stretch = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("t") >= c)) if cuts else F.lit(0)
    aside = f"{shared_dir(marks.sparkSession)}/stretches-{uuid.uuid4().hex}"  # dealt once, however many files there are
    marks.where("t is not null").withColumn("_stretch", stretch).repartition(files, "_stretch").write.partitionBy("_stretch").parquet(aside)
    dealt = marks.sparkSession.read.schema(T.StructType([*marks.schema.fields, T.StructField("_stretch", T.IntegerType())])).parquet(aside)
    for k in range(files):
        dealt.where(F.col("_stretch") == k).drop("_stretch").repartition(1).sortWithinPartitions("t").write.mode("append").parquet(path)


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one process and message: intervals that the batch closed, and the one that is open after it.

    The state is the number of starts so far, and start and stop of the last; a batch's marks are taken in order of
    time, starts after stops of the same time, as a start makes the interval before it final.
    """
    number, start, stop = state.get if state.exists else (0, math.nan, math.nan)
    rows, marks = {}, [(b["t"].to_numpy(), (b["kind"] == "start").to_numpy()) for b in batches]
    times, starts = (np.concatenate(c) for c in zip(*marks, strict=True))
    order = np.lexsort((starts, times))

    def told(last: bool) -> tuple:
        fault = "stop without start" if number == 0 else "start while open" if math.isnan(stop) and not last else None
        return number, start, stop, fault

    for t, begins in zip(times[order].tolist(), starts[order].tolist(), strict=True):
        if begins:
            if number or not math.isnan(stop):
                rows[number] = told(False)
            number, start, stop = number + 1, t, math.nan
        else:
            stop = t if math.isnan(stop) else max(stop, t)
        rows[number] = told(True)
    state.update((number, start, stop))
    n = len(rows)
    number, start, stop, fault = zip(*rows.values(), strict=True)
    yield pd.DataFrame({"pid": [key[0]] * n, "msg": [key[1]] * n, "number": np.array(number, np.int64), "start": np.array(start), "stop": np.array(stop), "fault": np.array(fault, object)}, copy=False)


def interval_updates(stream: DataFrame) -> DataFrame:
    """pid, msg, number, start, stop, fault whenever they change, of a stream of marks(pid, msg, t, kind).

    Batches follow each other in time; inside a batch any order is right. State is one row for each process and message,
    however long the log.
    """
    kinds = INTERVAL.format(pid=stream.schema["pid"].dataType.simpleString())
    rows = stream.select("pid", "msg", "t", "kind").groupBy("pid", "msg")
    return rows.applyInPandasWithState(_advance, kinds, "number long, start double, stop double", "update", GroupStateTimeout.NoTimeout)


def keep_intervals(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Puts each batch's updates to a versioned table, a partition for each batch; a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        Versioned(batch.sparkSession, path).put(batch, batch=number)

    updates = interval_updates(stream).writeStream.outputMode("update")
    return updates.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def intervals(spark: SparkSession, path: str) -> DataFrame:
    """The intervals as the last batch that told of each left them."""
    known = latest(Versioned(spark, path).read(), ["pid", "msg", "number"])
    return known.select("pid", "msg", "number", "start", "stop", "fault")
